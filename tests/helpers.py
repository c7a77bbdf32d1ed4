import contextlib
import io


def values(spark, rows, ddl, column):
    """The value of a column for each of the rows, in their order."""
    numbered = [(i, *row) for i, row in enumerate(rows)]
    frame = spark.createDataFrame(numbered, f"_i long, {ddl}")
    found = frame.select("_i", column.alias("_v")).collect()
    return [row["_v"] for row in sorted(found, key=lambda row: row["_i"])]


def plan(frame):
    """The physical plan as text."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


def rows(frame):
    return sorted(tuple(row) for row in frame.collect())
