"""Operator 4: document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into units (words, single signs, single ideographs; words of over
16 characters in parts). Of every run of ``K`` units the inner runs of ``S`` units are
hashed; the run is a closed syncmer, and an anchor of the text, if the smallest
of these hashes is the first or the last one. The choice depends on the run
alone, so an edit changes only the anchors that overlap it.

A text with fewer than ``K`` units has one anchor, the hash of the text; an empty one
none. A null text counts as empty. Null ids come first; rows that share an id
follow each other by the hash of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import let

K, S = 7, 2
INNER = K - S + 1  # inner runs of a run: 6
# Word characters, at most 16 at once; ideographs and kana one by one; other signs one by one.
UNITS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]{1,16}|[^\s\p{L}\p{M}\p{N}_]"
MOST_RANGES = 4096


def _pairs(values: Column, apart: int, body) -> Column:
    """``body`` of every value and the one ``apart`` places behind it."""
    return let(
        values,
        lambda v: F.zip_with(
            F.slice(v, 1, F.size(v) - apart), F.slice(v, F.lit(apart + 1), F.size(v) - apart), body
        ),
    )


def anchors(text: Column) -> Column:
    """``array<struct<position, hash>>``, by position (the first unit of the run)."""

    def of_units(units: Column) -> Column:
        inner = _pairs(F.transform(units, lambda u: F.xxhash64(u)), 1, lambda a, b: F.xxhash64(a, b))

        def of_inner(h: Column) -> Column:
            four = _pairs(_pairs(h, 1, lambda a, b: F.least(a, b)), 2, lambda a, b: F.least(a, b))
            least = _pairs(four, 2, lambda a, b: F.least(a, b))  # of INNER neighbours

            def chosen(m: Column) -> Column:
                places = F.filter(
                    F.sequence(F.lit(0), F.size(m) - 1),
                    lambda i: (F.get(m, i) == F.get(h, i)) | (F.get(m, i) == F.get(h, i + INNER - 1)),
                )
                return F.transform(
                    places,
                    lambda i: F.struct(
                        i.alias("position"),
                        F.hash(F.get(h, i), F.get(h, i + 2), F.get(h, i + 4), F.get(h, i + 5)).alias("hash"),
                    ),
                )

            return let(least, chosen)

        whole = F.array(F.struct(F.lit(0).alias("position"), F.hash(text).alias("hash")))
        return F.when(F.size(units) >= K, let(inner, of_inner)).otherwise(whole)

    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<struct<position:int,hash:int>>")).otherwise(
        let(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)), of_units)
    )


def hashes(found: Column) -> Column:
    """The hashes of anchors, in the order of the text."""
    return F.transform(found, lambda a: a["hash"])


def fingerprint(found: Column) -> Column:
    """The hashes as text."""
    return F.array_join(F.transform(found, lambda a: F.hex(a.cast("long").bitwiseAND(0xFFFFFFFF))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes as a part of all hashes of two lists, from 0 to 1."""
    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda h: let(
            F.size(F.array_union(h["a"], h["b"])),
            lambda n: F.when(n == 0, F.lit(1.0)).otherwise(
                F.size(F.array_intersect(h["a"], h["b"])).cast("double") / n
            ),
        ),
    )


def shared_anchors(a: Column, b: Column) -> Column:
    """Anchors of ``a`` that ``b`` has, each with its shift to the first place there."""
    first = lambda x: F.element_at(F.filter(b, lambda y: y["hash"] == x["hash"]), 1)["position"]
    known = F.transform(b, lambda y: y["hash"])
    return F.transform(
        F.filter(a, lambda x: F.array_contains(known, x["hash"])),
        lambda x: F.struct(x["position"].alias("position"), (first(x) - x["position"]).alias("shift")),
    )


def with_next(documents: DataFrame, columns: list[str], name: str = "next") -> DataFrame:
    """Add a struct of ``columns`` of the document with the next larger id (after the last: the first).

    Ids are cut into ranges of about equally many rows. Every range is a window of
    its own; the first document of each is also sent to the range before it. The
    texts are shuffled once. The driver holds at most ``MOST_RANGES`` ids.
    """
    spark = documents.sparkSession
    ranges = min(MOST_RANGES, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = documents.select(F.percentile_approx("doc_id", steps, 10 * ranges)).head()[0] or []
    cuts = sorted(set(cuts))
    if cuts:
        values = F.array(*[F.lit(cut) for cut in cuts])
        place = F.size(F.filter(values, lambda cut: cut < F.col("doc_id")))
    else:
        place = F.lit(0)
    placed = documents.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(place))
    firsts = placed.groupBy("_range").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null")
    )
    bounds = sorted((row["_range"], None if row["has_null"] else row["first"]) for row in firsts.collect())
    if not bounds:
        return documents.withColumn(name, F.struct(*[F.col(c) for c in columns]))
    # The range that wants this range's first document.
    wants = [(own, first, bounds[i - 1][0]) for i, (own, first) in enumerate(bounds)]
    id_type = dict(documents.dtypes)["doc_id"]
    row = lambda own, first, before: F.struct(
        F.lit(own).alias("_own"), F.lit(first).cast(id_type).alias("_first"), F.lit(before).alias("_before")
    )
    table = F.broadcast(spark.range(1).select(F.inline(F.array(*[row(*want) for want in wants]))))
    joined = placed.join(table, F.col("_range") == F.col("_own"))
    copies = F.array_compact(
        F.array(
            F.struct(F.col("_range").alias("at"), F.lit(False).alias("ghost")),
            F.when(
                F.col("doc_id").eqNullSafe(F.col("_first")),
                F.struct(F.col("_before").alias("at"), F.lit(True).alias("ghost")),
            ),
        )
    )
    dealt = joined.withColumn("_copy", F.explode(copies)).drop("_own", "_first", "_before", "_range")
    order = ["_copy.ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    window = Window.partitionBy("_copy.at").orderBy(*order)
    return (
        dealt.withColumn(name, F.lead(F.struct(*[F.col(c) for c in columns])).over(window))
        .where(~F.col("_copy.ghost"))
        .drop("_copy")
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the hashes of its anchors, the edited text and its hashes, and the next document's hashes.

    Positions stay behind: of what is shuffled they would be the larger part.
    """
    plain = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = plain.withColumn("hashes", hashes(anchors(F.col("text")))).withColumn("n_chars", F.char_length("text").cast("long"))
    near = with_next(own, ["text", "hashes"])
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 4) as int))"),
        F.substring(F.col("next.text"), F.lit(1), cut),
    )
    return near.withColumn("edited", edited).withColumn("edited_hashes", hashes(anchors(F.col("edited"))))
