"""Batch encoding of texts into vectors.

An encoder is any picklable callable from a list of texts to a matrix with one
row per text. An encoder with a model should load it on its first call and keep
it in a module that is installed on the executors, so that every Python worker
loads it once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.config import DEFAULT_DIM, embed_text_cap

Encoder = Callable[[list], np.ndarray]
_WORD = re.compile("[a-z0-9]+")


class HashingEncoder:
    """Encoder without a model: signed word counts in hashed buckets, unit length.

    A text without words becomes the zero vector.
    """

    known_words = 20_000  # words whose place is remembered

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim
        self.places: dict[str, int] = {}  # the bucket, or its complement for words that count negative

    def _place(self, word: str) -> int:
        place = self.places.get(word)
        if place is None:
            if len(self.places) >= self.known_words:
                self.places.clear()
            digest = hashlib.md5(word.encode()).hexdigest()
            bucket = int(digest[:8], 16) % self.dim
            place = self.places[word] = bucket if int(digest[8], 16) < 8 else ~bucket
        return place

    def __call__(self, texts: list) -> np.ndarray:
        # All words of the batch at once: each different word is looked up once, and the
        # counts are a sum over (text, bucket) pairs.
        words = [_WORD.findall(text.lower()) for text in texts]
        codes, different = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
        places = np.fromiter(map(self._place, different), np.int64, len(different))
        rows = np.repeat(np.arange(len(texts)), [len(found) for found in words])
        buckets, signs = np.where(places < 0, ~places, places)[codes], np.where(places < 0, -1.0, 1.0)[codes]
        counts = np.bincount(rows * self.dim + buckets, signs, len(texts) * self.dim).reshape(len(texts), self.dim)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return counts / np.where(norms == 0, 1, norms)


def encode_batch(
    texts: DataFrame, encoder: Encoder, text_cap: int | None = None, batch_size: int = 256
) -> DataFrame:
    """``(doc_id, embedding)`` from ``(doc_id, text)``.

    The encoder sees at most ``text_cap`` characters of a text, which is how it
    is defined: the index itself keeps the whole text. Without one, the setting of
    the session counts.
    """
    if text_cap is None:
        text_cap = embed_text_cap(texts.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors = np.asarray(encoder(part.column("text").to_pylist()), dtype=np.float32)
                offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                embeddings = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), embeddings], names=["doc_id", "embedding"]
                )

    capped = texts.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, text_cap).alias("text"))
    return capped.mapInArrow(encode, "doc_id long, embedding array<float>")
