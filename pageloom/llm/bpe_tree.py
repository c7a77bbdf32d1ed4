"""Operator 2: encode whole texts with byte-pair merges and decode them again.

Texts up to ``long_chars`` are encoded from a memo of their chunks. A longer text is
numbered, stored and cut into pieces that are encoded as rows of their own, in parallel; the pieces
of a text are then joined pairwise, as a tree: a window around each join is
encoded again and grows until it agrees with both sides (``chunk_encoder``).

Null and empty texts have no ids. Repeated rows give repeated results. Other
columns pass through untouched; names that begin with two underscores are reserved.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.chunk_encoder import (
    chunk_encoder,
    cut_leaves,
    encode_span,
    in_slices,
    join_leaves,
    load_tokenizer,
)
from pageloom.llm.common import add_columns
from pageloom.session import materialize

LONG_CHARS = 65_536
LEAF_CHARS = 16_384
TASK_CHARS = 4_000_000  # of long texts that one task encodes


def _decoded(path: str, ids: np.ndarray) -> str:
    return load_tokenizer(path).decode(ids.tolist(), skip_special_tokens=False)


def encode(
    documents: DataFrame, path: str, text: str = "text", long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS, decoded: bool = False
) -> DataFrame:
    """Add ``ids``: little-endian unsigned 32-bit integers, as bytes; ``decoded`` adds also their text, in the same pass."""
    added = "ids binary, decoded string" if decoded else "ids binary"

    def made(found: list[np.ndarray]) -> list[list]:
        ids = [x.astype("<u4").tobytes() for x in found]
        return [ids, [_decoded(path, x) for x in found]] if decoded else [ids]

    def start_short():
        encoder = chunk_encoder(path)

        def work(texts):
            texts = [value or "" for value in texts]
            found = [x for a, b in in_slices(texts) for x in encoder.encode(texts[a:b])]
            return made(found)

        return work

    piece = T.StructType(
        [
            T.StructField("__row", T.StringType()),
            T.StructField("_piece", T.IntegerType()),
            T.StructField("_start", T.LongType()),
            T.StructField("_part", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, value in zip(batch["__row"], batch[text], strict=True):
                starts = cut_leaves(value, leaf_chars)
                ends = [*starts[1:], len(value)]
                yield pd.DataFrame(
                    {
                        "__row": row,
                        "_piece": range(len(starts)),
                        "_start": starts,
                        "_part": [value[a:b] for a, b in zip(starts, ends, strict=True)],
                    }
                )

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        for batch in batches:
            found = [encode_span(tokenizer, part, 0, len(part)) for part in batch["_part"]]
            batch["_rows"] = [x.tobytes() for x in found]
            yield batch

    def join(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("_piece")
        starts = pieces["_start"].tolist()
        leaves = [
            np.frombuffer(rows, np.int64).reshape(-1, 3) + [0, start, start]
            for rows, start in zip(pieces["_rows"], starts, strict=True)
        ]
        whole = "".join(pieces["_part"])
        joined = join_leaves(load_tokenizer(path), whole, starts, leaves)
        columns = [[pieces["__row"].iloc[0]], *made([joined[:, 0]])]
        return pd.DataFrame(dict(zip(["__row", "ids", "decoded"], columns, strict=False)))

    def start_numbers():
        task, number = TaskContext.get().partitionId(), itertools.count()
        return lambda texts: ([f"{task}-{next(number)}" for _ in texts],)

    is_long = F.coalesce(F.char_length(text) > long_chars, F.lit(False))
    plain = documents.drop("ids", *(["decoded"] if decoded else []))
    short = add_columns(plain.where(~is_long), [text], added, start_short)
    # Numbered once and stored: tasks that run again, or a shuffle before them, may see other rows.
    long = materialize(add_columns(plain.where(is_long), [text], "__row string", start_numbers), "long-texts")
    chars = long.agg(F.sum(F.char_length(text).cast("long"))).head()[0] or 0
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    pieces = long.select("__row", text).mapInPandas(cut, piece).repartition(tasks, "__row", "_piece")
    coded = pieces.mapInPandas(encode_pieces, T.StructType([*piece.fields, T.StructField("_rows", T.BinaryType())]))
    joined = coded.groupBy("__row").applyInPandas(join, f"__row string, {added}")
    return short.unionByName(long.join(joined, "__row").drop("__row"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``: the text of ``ids``, special tokens included."""

    def start():
        return lambda column: ([_decoded(path, np.frombuffer(ids, "<u4")) for ids in column],)

    return add_columns(encoded, ["ids"], "decoded string", start)
