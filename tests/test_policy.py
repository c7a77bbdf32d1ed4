import pytest
from pyspark.sql import functions as F

from helpers import values
from pageloom.config import ContentPolicy, Thresholds
from pageloom.functions import policy

CDK = "/docs/cdk/docs.aws.amazon.com/cdk/a.html"


def text_of(chars, lines, words):
    """A text of so many stripped characters, lines and words."""
    per_line = [words // lines + (i < words % lines) for i in range(lines)]
    parts = [" ".join(["w"] * n) for n in per_line]
    missing = chars - len("\n".join(parts))
    assert missing >= 0
    return "\n".join([parts[0] + "x" * missing, *parts[1:]])


def judge(spark, text, path="/a", **settings):
    column = policy.is_meaningful_for(F.col("path"), F.col("text"), ContentPolicy(**settings))
    return values(spark, [(path, text)], "path string, text string", column)[0]


@pytest.mark.parametrize(
    "path, chars, lines, words, expected",
    [
        ("/a", 400, 10, 50, True),
        ("/a", 400, 9, 50, False),
        ("/a", 400, 10, 49, False),
        ("/a", 259, 10, 50, True),  # 250 characters in 10 lines, and 9 line breaks
        ("/a", 258, 10, 50, False),
        (CDK, 200, 6, 35, True),
        (CDK, 200, 5, 35, False),
        (CDK, 200, 6, 34, False),
        (CDK, 120, 6, 35, True),
        (CDK, 119, 6, 35, False),
        (CDK.upper(), 200, 6, 35, False),  # the domain is case-sensitive
        (CDK.replace("/cdk/", "/CDK/"), 200, 6, 35, True),
        (CDK.replace("/cdk/", "/sdk/"), 200, 6, 35, False),
    ],
)
def test_thresholds(spark, path, chars, lines, words, expected):
    assert judge(spark, text_of(chars, lines, words), path) is expected


def test_character_threshold(spark):
    column = policy.is_meaningful(F.col("text"), Thresholds(chars=200, lines=1, mean_line=0, words=1))
    rows = [(" " * 9 + "a" * 199 + "\n",), (" " * 9 + "é" * 200 + "\n",)]
    assert values(spark, rows, "text string", column) == [False, True]


@pytest.mark.parametrize("text", [None, "", " \n ", "\n" * 300])
def test_no_text_is_never_meaningful(spark, text):
    assert judge(spark, text) is False
    assert judge(spark, text, CDK) is False


def test_settings(spark):
    text = text_of(130, 6, 40)
    assert judge(spark, text, "/docs/example.org/cdk/a") is False
    assert judge(spark, text, "/docs/example.org/cdk/a", relaxed_domain="example.org") is True


def test_stats_of_blank_lines(spark):
    stats = values(spark, [(" a b \n\n\t\n\xa0ccc\n",)], "text string", policy.text_stats(F.col("text")))[0]
    assert stats.asDict() == {"chars": 12, "lines": 2, "line_chars": 6, "words": 3}


def test_document_checks(spark):
    rows = [("/a", "t", "c"), ("", "t", "c"), ("/a", "", "c"), ("/a", "t", ""), (None, "t", "c")]
    valid = policy.is_valid(F.col("path"), F.col("text"), F.col("category"))
    ddl = "path string, text string, category string"
    assert values(spark, rows, ddl, valid) == [True, False, False, False, False]
    content = policy.has_content(F.col("text"), 3)
    assert values(spark, [(" abc ",), (" ab ",), (None,)], "text string", content) == [True, False, False]
