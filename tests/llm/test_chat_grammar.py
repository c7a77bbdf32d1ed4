import hashlib
import random

from pyspark.sql import functions as F

from pageloom.llm import chat_grammar, queries
from tests.helpers import plan

CHATS = "conv_id long, turn long, role string, text string"
PARTS = ["### User:", "### Assistant: ", "### System:", "### =41:", "### =:", "</turn>", "\n</turn>\n", "\\", "\\\\", "#", "###", " ", "\n", "<", "</turn", "x", "é日", "=", ":", "$1", "\r\n", "\u2028"]


def results(frame):
    """``conv_id`` to the turns, the learned text and the string, all read from the string."""
    read = frame.select("conv_id", "formatted", "loss", chat_grammar.parsed(F.col("formatted")).alias("turns"), chat_grammar.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["learned"], r["formatted"], r["loss"]) for r in read.collect()}


def check(spark, rows):
    chats = spark.createDataFrame(rows, CHATS)
    got = results(chat_grammar.assemble(chat_grammar.format_turns(chats)))
    assert len(got) == len({r[0] for r in rows})
    for number, (turns, learned, formatted, loss) in got.items():
        own = sorted((r for r in rows if r[0] == number), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert turns == [(r[2] or "", r[3] or "") for r in own]
        assert learned == "".join(r[3] or "" for r in own if r[2] == "assistant")
        spans = [formatted[e["start"] + e["loss_from"] :][: e["loss_length"]] for e in loss]
        assert len(spans) == len(own)
        assert all((span == "") == (r[2] != "assistant" or not r[3]) for span, r in zip(spans, own, strict=True))
    return got


def test_texts_made_of_control_strings(spark):
    choose = random.Random(3)
    rows = [
        (conv, turn, choose.choice(["user", "assistant", "system"]), "".join(choose.choices(PARTS, k=choose.randrange(9))))
        for conv in range(150)
        for turn in range(choose.randrange(1, 6))
    ]
    check(spark, rows)


def test_hard_rows(spark):
    long = "word </turn> ### User: " * 20_000
    rows = [
        (1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (1, 2, "Assistant", "capital"), (1, 3, "ro:le\n### User: ", "y"),
        (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "user", "tie"), (2, 0, "assistant", "a tie"),
        (None, 0, "user", "no id"), (None, 1, "assistant", ""), (3, 0, "assistant", long), (3, 1, "user", "\\" * 50_000), (3, 2, "assistant", "é" * 10_000),
        (4, 0, "", ""), (5, 0, "日本", "\\### Assistant: </turn> ok"),
    ]
    got = check(spark, rows)
    assert got[2][1] == "a tie" + "same" * 2
    assert got[4][2] == "### =: \n</turn>\n"


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain \\ text # with </turn and ### user:"), (1, 1, "assistant", "a </turn> b ### User: c ### =0F: \\### System:")]
    got = check(spark, rows)
    assert got[1][2] == (
        "### User: plain \\ text # with </turn and ### user:\n</turn>\n"
        "### Assistant: a \\</turn> b \\### User: c \\### =0F: \\\\### System:\n</turn>\n"
    )


def test_the_parser_refuses_what_is_no_turn(spark):
    wrong = ["x", "### User: a", "### User:a\n</turn>\n", "### User: a\n</turn>\nb\n</turn>\n", "### User: a </turn> b\n</turn>\n", "### user: a\n</turn>\n", "### User: a\n\\</turn>\n"]
    frame = spark.createDataFrame([(w,) for w in wrong], "w string")
    for row in frame.select("w", chat_grammar.parsed(F.col("w")).alias("turns")).collect():
        assert any(turn["text"] is None for turn in row["turns"]) or not row["turns"], row


def test_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: r for r in queries.QUERIES["op12_chat_grammar"](spark, sf).collect()}
    for number, (turns, learned, formatted, _) in check(spark, rows).items():
        row = got.pop(number)
        assert row["n_turns"] == len(turns) and row["formatted_chars"] == len(formatted) and row["loss_chars"] == len(learned)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert not got


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], CHATS)
    assert chat_grammar.assemble(chat_grammar.format_turns(empty)).count() == 0
    named = spark.createDataFrame([(1, 0, "assistant", "hi")], CHATS).withColumns({n: F.lit("clash") for n in ("piece", "formatted", "role_", "text_", "number", "loss_from", "start", "pieces")})
    turns = chat_grammar.format_turns(named)
    assert set(named.columns) <= set(turns.columns)
    assert results(chat_grammar.assemble(turns))[1][:2] == ([("assistant", "hi")], "hi")


def test_no_python_in_the_plan(spark, sf):
    text = plan(queries.QUERIES["op12_chat_grammar"](spark, sf))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text and "ExistingRDD" not in text
    assert text.count("Exchange hashpartitioning") <= 1
