"""Operator 11: how filters interact, from wide packed counters.

Every document has a mask of the filters it fails. For each of the ``k!`` orders of
``k`` filters and each of its steps, a mask decides what happens to the document there: it is
kept, removed, or failed again after it was removed. All these outcomes of one document are the
fields of one big integer; the integers of a part are added, and the fields of the sum
are the counts of the part for all orders at once.

A field has 64 bits and holds at most the number of rows, which is a 64-bit number itself, so
no field runs into the next. The integer depends on the mask and the marks alone. Rows are
therefore counted by them first, in partial sums before the shuffle, and a
group's integer is added ``n`` times by multiplication: a part has at most
``2 ** (k + number of marks)`` groups, however many rows it has.

Null texts count as empty; a null part is the empty part. Rows without an id never
repeat another row and are repeated by none; they have no labels. Rows that share an id and a
text do not repeat each other. A document with several labels is good (toxic) if one of them says so.
Empty tables give no parts and no rows. Texts of any length are filtered whole, in
the JVM. Other columns of the inputs, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import let, skew_join
from pageloom.session import materialize

FILTERS = "ABCDE"
MARKS = ("good", "toxic")
MOST_FILTERS = 6  # 4,320 steps in an integer of 200 kB
FIELD_BYTES = 8
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def steps(filters: str) -> list[tuple[str, int, str]]:
    """``(order, step, filter)`` of every field group of the integers, in their order."""
    return [("".join(order), at, name) for order in permutations(filters) for at, name in enumerate(order, 1)]


@lru_cache(maxsize=1024)
def packed(filters: str, mask: int, marks: tuple[bool, ...]) -> int:
    """The integer of a document that fails the filters of ``mask`` (bit 0: the first one)."""
    failed = {name: bool(mask >> at & 1) for at, name in enumerate(filters)}
    fields = []
    for order in permutations(filters):
        left = True
        for name in order:
            removed = left and failed[name]
            fields += [left and not removed, removed, failed[name] and not left, failed[name] and mask.bit_count() == 1]
            fields += [removed and mark for mark in marks]
            left = left and not removed
    return int.from_bytes(np.array(fields, "<u8").tobytes(), "little")


def unpacked(total: int, filters: str, n_marks: int) -> np.ndarray:
    """The fields of a sum: a row per step, a column per outcome."""
    width = len(OUTCOMES) + n_marks
    n_fields = len(steps(filters)) * width
    return np.frombuffer(total.to_bytes(n_fields * FIELD_BYTES, "little"), "<u8").astype(np.int64).reshape(-1, width)


def audit(flags: DataFrame, filters: str = FILTERS, marks: Sequence[str] = MARKS) -> DataFrame:
    """The counts of every part, order and step.

    ``flags`` has a row per document: ``part``, ``mask`` and a boolean column per
    mark. ``shapley`` is what the step's filter removes, summed over all orders.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters, not {filters!r}")
    marks = list(marks)
    counts = flags.groupBy("part", "mask", *marks).agg(F.count("*").alias("n"))
    names = [*OUTCOMES, *[f"{mark}_lost" for mark in marks]]

    def of_part(groups: pd.DataFrame) -> pd.DataFrame:
        total = sum(
            n * packed(filters, mask, tuple(map(bool, found)))
            for mask, n, *found in groups[["mask", "n", *marks]].itertuples(index=False)
        )
        made = pd.DataFrame(steps(filters), columns=["filter_order", "step", "filter"])
        made[names] = unpacked(total, filters, len(marks))
        made["shapley"] = made.groupby("filter")["removed"].transform("sum")
        made.insert(0, "part", groups["part"].iloc[0])
        return made

    ddl = ", ".join(f"{name} long" for name in [*names, "shapley"])
    return counts.groupBy("part").applyInPandas(of_part, f"part string, filter_order string, step int, filter string, {ddl}")


def failed_alone(text: Column) -> Column:
    """The bits of the four filters that a text fails by itself."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(w: Column) -> Column:
        n = F.size(w)
        tests = [
            n < 200,
            F.size(F.array_distinct(w)) * 100 < n * 50,
            capitals.cast("long") * 100 > F.char_length(text).cast("long") * 2,
            text.rlike("[#$%&*|]"),
        ]
        return sum((F.when(test, 1 << at).otherwise(0) for at, test in enumerate(tests)), F.lit(0))

    return let(words, bits)


def document_flags(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``(doc_id, part, mask, good, toxic)`` of every document.

    Texts are read once and leave the scan as a hash. Hashes that occur under several ids
    are joined back to the documents from a stored table of one row per hash, so a text that a
    third of all documents share can be split.
    """
    text = F.coalesce("text", F.lit(""))
    own = documents.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("hash"),
        failed_alone(text).alias("alone"),
    )
    own = materialize(own, "flags")
    ids = own.where("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    masks = skew_join(own, ids.where("first < last").select("hash", "first"), ["hash"]).select(
        "doc_id", "part", (F.col("alone") + F.when(repeated, 16).otherwise(0)).alias("mask")
    )
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic")
    )
    never = F.lit(False)
    return skew_join(masks, marks, ["doc_id"]).select(
        "doc_id", "part", "mask", F.coalesce("good", never).alias("good"), F.coalesce("toxic", never).alias("toxic")
    )
