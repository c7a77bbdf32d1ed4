r"""Operator 12: chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered by this grammar:

    conversation = turn*
    turn    = header " " body "\n</turn>\n"
    header  = "### User:" | "### Assistant:" | "### System:" | "### =" hex ":"

A role other than the three is written as the upper-case hex of its UTF-8 bytes. A header and
``</turn>`` are control strings. The parser is deterministic: a control string counts unless a
backslash stands right before it, and of every control string with backslashes
before it in a body, one backslash is dropped.

Every turn is rendered as it is and parsed again; if the turns that come back are not exactly the one
that went in, its control strings get a backslash each, and it is parsed again. A
turn that still differs would be an error (none can: a body ends with a line end,
so nothing before ``</turn>`` escapes it). Texts without conflicts stay as they are.

Turns are rendered and compared row by row, without a shuffle. Only the assembled string of a
conversation needs its turns together; it is one value, so a conversation must
have less than 2 GB of text.

Null texts and roles count as empty. Turns are ordered by their number (null first), then role and
text; repeated rows are repeated turns. A null conversation id is an id of its own. Empty
tables give no rows. Long texts are rendered whole. Further columns of the input are kept by
``format_turns`` (older ones of its own names go) and not looked at by ``assemble``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import let

ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
HEADER = f"### (?:{'|'.join(ROLES.values())}|=[0-9A-F]*):"
END = "</turn>"
TAIL = f"\n{END}\n"
CONTROL = f"(?:{HEADER}|{END})"


def header(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.concat(F.lit("### "), F.coalesce(known[role], F.concat(F.lit("="), F.hex(F.encode(role, "utf-8")))), F.lit(":"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescaped(body: Column) -> Column:
    return F.regexp_replace(body, rf"\\({CONTROL})", "$1")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(header(role), F.lit(" "), body, F.lit(TAIL))


def pieces(text: Column) -> Column:
    """A rendering cut before every header that counts."""
    return F.filter(F.split(text, rf"(?<!\\)(?={HEADER} )"), lambda piece: piece != "")


def parsed_piece(piece: Column) -> Column:
    """``struct<role, text>`` of a piece; both are null if it is not one whole turn."""
    name = F.regexp_extract(piece, f"^({HEADER}) ", 1)
    literal = F.create_map(*[F.lit(x) for role, shown in ROLES.items() for x in (f"### {shown}:", role)])
    role = F.coalesce(literal[name], F.decode(F.unhex(F.substring(name, 6, F.char_length(name) - 6)), "utf-8"))
    body = F.substring(piece, F.char_length(name) + 2, F.char_length(piece) - F.char_length(name) - 1 - len(TAIL))
    whole = (name != "") & piece.endswith(TAIL) & (F.size(F.split(piece, rf"(?<!\\){END}")) == 2)
    return F.struct(F.when(whole, role).alias("role"), F.when(whole, unescaped(body)).alias("text"))


def parsed(text: Column) -> Column:
    """The turns of a rendering, ``array<struct<role, text>>``."""
    return F.transform(pieces(text), parsed_piece)


def body(role: Column, text: Column) -> Column:
    """The text as it stands in the rendering: escaped if the parser does not return it otherwise."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))

    def survives(tried: Column) -> Column:
        return parsed(rendered(role, tried)).eqNullSafe(source)

    changed = let(
        escaped(text),
        lambda tried: F.when(survives(tried), tried).otherwise(F.raise_error(F.lit("a turn does not survive its rendering"))),
    )
    return F.when(survives(text), text).otherwise(changed)


def format_turns(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """Every turn with its rendering and the part of it that is learned.

    Adds ``role_`` and ``text_`` (without nulls), ``formatted`` and, in code points of it,
    ``loss_from`` and ``loss_length`` (0 for turns of other roles than ``learn``).
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = ("role_", "text_", "formatted", "loss_from", "loss_length")
    plain = conversations.drop(*made).withColumns({"role_": role, "text_": text})
    learned = F.col("role_") == learn
    chars = lambda column: F.char_length(column).cast("long")
    return (
        plain.withColumn("formatted", rendered(F.col("role_"), body(F.col("role_"), F.col("text_"))))
        .withColumn("loss_from", F.when(learned, chars(header(F.col("role_"))) + 1).otherwise(0).cast("long"))
        .withColumn(
            "loss_length",
            F.when(learned, chars(F.col("formatted")) - F.col("loss_from") - len(TAIL)).otherwise(0).cast("long"),
        )
    )


def assemble(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)``: one string per conversation and its loss mask.

    ``loss`` has an entry per turn: ``start`` is where the turn begins in the string,
    ``loss_from`` and ``loss_length`` tell which part of the turn is learned, all in code points.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role_", "text_")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("number"),
            "formatted",
            F.coalesce(F.sum(F.char_length("formatted").cast("long")).over(before), F.lit(0)).alias("start"),
            "loss_from",
            "loss_length",
        ).alias("piece"),
    )
    done = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return done.select(
        "conv_id",
        F.array_join("pieces.formatted", "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(p["start"].alias("start"), p["loss_from"].alias("loss_from"), p["loss_length"].alias("loss_length"))).alias("loss"),
    )


def learned_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, read from the string.

    The string is cut into turns once; each is read by its own entry, so the work grows with the text.
    """

    def under(piece: Column, entry: Column) -> Column:
        return unescaped(F.substring(piece, (entry["loss_from"] + 1).cast("int"), entry["loss_length"].cast("int")))

    return F.array_join(F.zip_with(pieces(formatted), loss, under), "")
