"""Operator 13: fill-in-middle transformation with content-defined chunk memoization.

A text of ``n`` units (runs of ASCII letters, other code points one by one) is cut into prefix,
middle and suffix at unit boundaries that a hash of its id draws. To find them, a rolling hash cuts
the text into chunks whose ends depend on the ``WINDOW`` code points before
them only, so passages that documents share fall into equal chunks. What a chunk contributes is its
boundary summary: how many units it has, and whether it begins and ends with a letter. Summaries are
kept per worker by the hash of the chunk and used after its content has
been compared. Adding the counts, one less where a run of letters goes on across a
chunk's edge, gives ``n`` and the chunk that holds a cut; only that chunk is looked into.

Work is done row by row without a shuffle; the memo has a fixed size in characters and holds nothing that
could not be computed again, and a text is hashed in blocks, so memory follows
the longest text. Null texts count as empty; a null id is hashed as an empty one; repeated rows
give repeated rows; empty tables give none. Other columns stay, but older ones of the
added names go.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import add_columns

WINDOW = 32  # code points that decide whether a chunk ends
CUT_BITS = 9  # one place in 512 is an end
LEAST, MOST = 128, 4096  # code points of a chunk
BLOCK = 1 << 20  # code points hashed at once
MEMO_CHARS = 16_000_000  # of one worker
MARKERS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
SEED = "1"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ADDED = "fim_n long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_text string"


def possible_ends(codes: np.ndarray) -> np.ndarray:
    """Whether the rolling hash allows a chunk to end behind a code point.

    The hash is the sum of the scrambled code points, each shifted by its distance; 32 places back, all
    bits are shifted out. The sum over a window is built from sums over windows of half the size.
    """
    rolling = (codes + np.uint32(1)) * np.uint32(0x9E3779B1)
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x85EBCA77)
    span = 1
    while span < WINDOW:
        rolling[span:] += rolling[:-span] << np.uint32(span)
        span *= 2
    return rolling >> np.uint32(32 - CUT_BITS) == 0


def chunk_ends(text: str) -> Iterator[int]:
    """Where the chunks of a text end, the last one at its end."""
    begin = 0
    for at in range(0, len(text), BLOCK):
        before = min(at, WINDOW - 1)
        codes = np.frombuffer(text[at - before : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        for end in (np.flatnonzero(possible_ends(codes)[before:]) + at + 1).tolist():
            while end - begin > MOST:
                begin += MOST
                yield begin
            if end - begin >= LEAST:
                begin = end
                yield end
    while begin < len(text):
        begin = min(begin + MOST, len(text))
        yield begin


class Memo:
    """Boundary summaries of chunks met before: two generations, the older one is dropped when the younger is full."""

    def __init__(self, most_chars: int = MEMO_CHARS) -> None:
        self.most = most_chars // 2
        self.young: dict[int, tuple[str, tuple[int, bool, bool]]] = {}
        self.old: dict[int, tuple[str, tuple[int, bool, bool]]] = {}
        self.chars = self.hits = self.misses = 0

    def summary(self, chunk: str) -> tuple[int, bool, bool]:
        """Units of the chunk, and whether it begins and ends with a letter."""
        key = hash(chunk)
        found = self.young.get(key) or self.old.get(key)
        if found is not None and found[0] == chunk:
            self.hits += 1
            return found[1]
        self.misses += 1
        letter = [one.isascii() and one.isalpha() for one in (chunk[0], chunk[-1])]
        made = (len(UNIT.findall(chunk)), *letter)
        if self.chars + len(chunk) > self.most:
            self.old, self.young, self.chars = self.young, {}, 0
        self.young[key] = (chunk, made)
        self.chars += len(chunk)
        return made


class Units:
    """The units of a text, counted by chunks."""

    def __init__(self, text: str, memo: Memo) -> None:
        self.text = text
        self.begins: list[int] = []
        self.counted: list[int] = []  # units that begin before the chunk
        self.goes_on: list[bool] = []  # whether the chunk begins inside a unit
        self.n, begin, open_run = 0, 0, False
        for end in chunk_ends(text):
            count, first, last = memo.summary(text[begin:end])
            self.begins.append(begin)
            self.counted.append(self.n)
            self.goes_on.append(open_run and first)
            self.n += count - self.goes_on[-1]
            begin, open_run = end, last

    def offset(self, k: int) -> int:
        """Code points of the first ``k`` units."""
        if k == self.n:
            return len(self.text)
        at = bisect_right(self.counted, k) - 1
        end = self.begins[at + 1] if at + 1 < len(self.begins) else len(self.text)
        inside = k - self.counted[at] + self.goes_on[at]
        match = next(islice(UNIT.finditer(self.text[self.begins[at] : end]), inside, None))
        return self.begins[at] + match.start()


def draws(seed: str, number: object) -> list[int]:
    """Four 32-bit numbers for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if number is None else number}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]


def rearranged(text: str, number: object, memo: Memo, seed: str = SEED) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)``."""
    one, two, three, four = draws(seed, number)
    units = Units(text, memo)
    if not text or any(marker in text for marker in MARKERS) or three % 100 >= PLAIN_FROM:
        return units.n, "plain", None, None, text
    first, second = sorted((one % (units.n + 1), two % (units.n + 1)))
    a, b = units.offset(first), units.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < SPM_BELOW:
        return units.n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return units.n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


MEMO = Memo()  # of this worker; later tasks find it filled


def transform(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents with ``fim_n``, ``fim_form``, ``fim_prefix_chars``, ``fim_middle_chars`` and ``fim_text``."""

    def start():
        from pageloom.llm import fill_middle

        def work(numbers, texts):
            done = [fill_middle.rearranged(text or "", number, fill_middle.MEMO, seed) for number, text in zip(numbers, texts, strict=True)]
            return [list(column) for column in zip(*done)] if done else [[], [], [], [], []]

        return work

    return add_columns(documents, ["doc_id", "text"], ADDED, start, slice_bytes=8 << 20)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>")
    a, b, c = (F.get(parts, F.lit(at)) for at in (1, 2, 3))
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(b, c, a)).otherwise(output)
