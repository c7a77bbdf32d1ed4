"""Operator 5: harmonic packing of tokenised documents into sequences.

Piece lengths fall into classes by reciprocal capacity: class j holds lengths in
(C/(j+1), C/j], and a bin of the class takes exactly j pieces. Documents may be
cut, so a length is first cut into whole capacities and then, greedily, into
the largest class lengths C/j (j up to ``cut_classes``); only the rest, shorter than
C/cut_classes, goes to its class as it is. A full bin then wastes less than j tokens
(cut pieces) or one part in cut_classes + 1 (rests).

Every task packs its own documents, one after the other, and keeps at most
j - 1 pieces of a class: nothing is shuffled and memory does not grow with the
input. What its bins hold at the end is laid end to end and cut at the capacity;
the last stretch becomes sequences of power-of-two lengths, which need no padding.

A null text counts as empty: its only id is the end mark. Repeated rows are
packed as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.chunk_encoder import SLICE_CHARS, chunk_encoder, in_slices
from pageloom.llm.common import give_back

CAPACITY = 2048
END_ID = 1
CUT_CLASSES = 32
BATCH = 10_000  # pieces that a worker passes on at once

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def cut_lengths(tokens: int, capacity: int = CAPACITY, classes: int = CUT_CLASSES) -> list[int]:
    """Lengths of the pieces of a document."""
    lengths = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest and rest >= capacity // classes:
        lengths.append(capacity // -(-capacity // rest))
        rest -= lengths[-1]
    return [*lengths, rest] if rest else lengths


class Packer:
    """Bins of one task. Emits rows of whole sequences: (document, start, ids, tokens, sequence, offset)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, classes: int = CUT_CLASSES):
        self.capacity, self.classes = capacity, classes
        self.sequence = first_id
        self.bins: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, tokens in pieces:
            rows.append((doc, start, ids, tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        return rows

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        rows, start = [], 0
        for length in cut_lengths(len(ids), self.capacity, self.classes):
            kind = self.capacity // length
            held = self.bins.setdefault(kind, [])
            held.append((doc, start, ids[start : start + length], len(ids)))
            start += length
            if len(held) == kind:
                rows += self._close(self.bins.pop(kind))
        return rows

    def finish(self) -> list[tuple]:
        """Sequences of what the unfinished bins hold, without padding."""
        left = [piece for kind in sorted(self.bins) for piece in self.bins[kind]]
        self.bins = {}
        total = sum(len(piece[2]) for piece in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << k for k in reversed(range(self.capacity.bit_length())) if total % self.capacity >> k & 1]
        rows, held, room = [], [], iter(sizes)
        free = next(room, 0)
        for doc, start, ids, tokens in left:
            while len(ids):
                held.append((doc, start, ids[:free], tokens))
                used = len(held[-1][2])
                ids, start, free = ids[used:], start + used, free - used
                if not free:
                    rows += self._close(held)
                    held, free = [], next(room, 0)
        return rows


def pack(
    documents: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    classes: int = CUT_CLASSES,
    memo: int | None = None,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One row per piece of ``(doc_id, text)``; ``ids`` are little-endian unsigned 32-bit integers.

    The capacity must be a power of two. ``memo`` is the number of chunks whose ids a worker remembers, ``slice_chars``
    how much it encodes at once; both take memory and save time.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def pieces(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), BATCH):
            docs, starts, ids, tokens, sequences, offsets = zip(*rows[at : at + BATCH], strict=True)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int32)
            data = np.concatenate(ids).astype("<u4", copy=False)
            cut = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            columns = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, tokens, sequences, offsets)]
            yield pa.RecordBatch.from_arrays([*columns[:3], cut, *columns[3:]], names=SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path, memo)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, classes)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            docs, texts = batch["doc_id"].to_pylist(), [text or "" for text in batch["text"].to_pylist()]
            for a, b in in_slices(texts, slice_chars):
                rows: list[tuple] = []
                for doc, ids in zip(docs[a:b], encoder.encode(texts[a:b]), strict=True):
                    rows += packer.add(doc, np.concatenate([ids, end]))
                yield from pieces(rows)
        yield from pieces(packer.finish())
        give_back()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
