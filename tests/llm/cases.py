"""Small tables with the cases every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hard_documents(spark, extra=True):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven.", "en", "s", 3),
        (2, "One two three four five six seven.", "en", "s", 3),
        (2, "One two three four five six seven.", "en", "s", 3),
        (3, "", "en", "s", 0),
        (4, None, None, None, None),
        (None, "no id", "en", None, 5),
        (None, None, None, None, None),
        (5, long, "fr", "s", len(long)),
        (6, " \n\t ", "de", "s", 4),
        (7, "é" * 3000, "fr", "s", 3000),
        (8, "日本語のテキスト。漢字と仮名。", "ja", "t", 10),
        (9, "<|endoftext|> it's 12,5 <|ENDOFTEXT|> Ǉ İ ǰ ﬁ", "en", "s", 1),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    if not extra:
        return frame
    from pyspark.sql import functions as F

    named = {name: F.lit("clash") for name in ("ids", "size", "component_id", "_row", "anchors", "kept", "hash", "a", "rows")}
    return frame.withColumns(named)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
