"""Exact ids of whole texts from a memo of their white-space-separated chunks."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain, filterfalse

import numpy as np

from pageloom.llm.common import hold

# White space as the tokenizer's patterns see it; Python's str.split() also cuts at U+001C to U+001F.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_NOT_SPACE = re.compile("[\x1c-\x1f]")
MOST_WORD = 200  # letters of a word that is encoded among others
LEAF = 8192  # characters of unsplit text that are encoded at once
MEMO = 700_000  # chunks, and pieces of chunks, that a worker remembers, if the caller doesn't say
SLICE_CHARS = 1_500_000  # of texts that are encoded at once, if the caller doesn't say


def split_chunks(text: str) -> list[str]:
    if _NOT_SPACE.search(text):
        return [chunk for chunk in _SPACES.split(text) if chunk]
    return text.split()


def safe_cut(text: str, at: int, low: int) -> int:
    """The last place up to ``at`` (``low`` if there is none) where normalisation cannot reach across."""
    while at > low and (
        unicodedata.category(text[at])[0] == "M" or "ᅠ" <= text[at] <= "ᇿ"
    ):
        at -= 1
    return at


def cut_leaves(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of the pieces of a text, about ``leaf`` characters apart."""
    starts = [0]
    for at in range(leaf, len(text), leaf):
        place = safe_cut(text, at, starts[-1])
        if place > starts[-1]:
            starts.append(place)
    return starts


def encode_span(tokenizer, text: str, low: int, high: int) -> np.ndarray:
    """Rows ``(id, start, end)`` of a part of a text, with places in the whole text."""
    encoded = tokenizer.encode(text[low:high], add_special_tokens=False)
    spans = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2) + low
    return np.column_stack([np.array(encoded.ids, dtype=np.int64), spans])


def _agreeing(side: np.ndarray, window: np.ndarray, last: bool) -> tuple[int, int] | None:
    """Places in both of a token they share: the same id over the same characters.

    Several tokens can lie in one character. ``last`` asks for the last token of
    its character (to cut behind it), else for the first (to cut before it).
    """
    if last:
        edge = lambda rows, i: i + 1 == len(rows) or rows[i + 1, 1] >= rows[i, 2]
    else:
        edge = lambda rows, i: i == 0 or rows[i - 1, 2] <= rows[i, 1]
    known = {tuple(row): i for i, row in enumerate(window.tolist()) if edge(window, i)}
    first = np.searchsorted(side[:, 2], window[0, 1]) if len(window) else 0
    places = range(len(side) - 1, max(first - 2, -1), -1) if last else range(len(side))
    for i in places:
        if not last and len(window) and side[i, 1] > window[-1, 2]:
            break
        found = known.get(tuple(side[i].tolist()))
        if found is not None and edge(side, i):
            return i, found
    return None


def join_encodings(tokenizer, text: str, left: np.ndarray, right: np.ndarray, low: int, at: int, high: int) -> np.ndarray:
    """The encoding of ``text[low:high]`` from those of its two parts, cut at ``at``.

    A window around the cut is encoded again and doubled until it shares a token
    with each side. Everything before the left one and behind the right one is
    kept. Every two neighbours of the result are then neighbours in an encoding
    of real text, which for byte-pair merges means that the whole is one, too.
    """
    width = 64
    while True:
        start = safe_cut(text, max(low, at - width), low)
        end = min(high, at + width)
        end = safe_cut(text, end, at) if end < high else high
        window = encode_span(tokenizer, text, start, end)
        a = (-1, -1) if start == low else _agreeing(left[left[:, 2] <= at], window, True)
        b = (len(right), len(window)) if end == high else _agreeing(right, window, False)
        if a is not None and b is not None and a[1] < b[1]:
            return np.concatenate([left[: a[0] + 1], window[a[1] + 1 : b[1]], right[b[0] :]])
        if start == low and end == high:
            return window
        width *= 2


def join_leaves(tokenizer, text: str, starts: list[int], leaves: list[np.ndarray]) -> np.ndarray:
    """Join the encodings of neighbouring pieces pairwise, as a tree."""
    ends = [*starts[1:], len(text)]
    while len(leaves) > 1:
        some, lows, highs = [], [], []
        for i in range(0, len(leaves) - 1, 2):
            args = (leaves[i], leaves[i + 1], starts[i], starts[i + 1], ends[i + 1])
            some.append(join_encodings(tokenizer, text, *args))
            lows.append(starts[i])
            highs.append(ends[i + 1])
        if len(leaves) % 2:
            some.append(leaves[-1])
            lows.append(starts[-1])
            highs.append(ends[-1])
        leaves, starts, ends = some, lows, highs
    return leaves[0]


def tree_encode(tokenizer, text: str, leaf: int = LEAF) -> np.ndarray:
    starts = cut_leaves(text, leaf)
    ends = [*starts[1:], len(text)]
    leaves = [encode_span(tokenizer, text, a, b) for a, b in zip(starts, ends, strict=True)]
    return join_leaves(tokenizer, text, starts, leaves)


def load_tokenizer(path: str):
    return hold("tokenizers", path, lambda: _load_tokenizer(path))


def _load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


# A word of Latin letters that normalisation only lower-cases, and signs (no apostrophe) behind it: each is a word of its own
# to the tokenizer, so the word's ids serve all its spellings and all signs. Of a line of anything else both groups are empty.
_WORDS_AND_SIGNS = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@[-`{-~]*)|.*)$", re.MULTILINE)


class ChunkEncoder(dict):
    """Ids of texts. The tokenizer never merges across white space, so equal chunks
    have equal ids; each is looked at once and remembered, up to ``memo`` chunks (``MEMO``
    if None, some 300 MB). The ids are the same with any number.

    A chunk is one or two pieces (word, signs); a piece is a stretch of one array of ids.
    """

    def __init__(self, tokenizer, memo: int | None = None):
        super().__init__()
        self.tokenizer = tokenizer
        self.most = memo
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self._forget_chunks()
        self.pieces: dict[str, int] = {"": 0}
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.lengths = np.zeros(1, np.int64)

    def _forget_chunks(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.two = np.empty((0, 2), np.int64)  # the pieces of each chunk

    def __missing__(self, chunk: str) -> int:
        self.pending.append(chunk)
        self[chunk] = place = len(self)
        return place

    def _learn(self, names: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
        self.pieces.update(zip(names, range(len(self.pieces), len(self.pieces) + len(names)), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Encode words as one text; each ends with the only token in it that ends a word."""
        names, flat, lengths = [], [], []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer has no word ends")
            names += some
            flat.append(found)
            lengths.append(np.diff(ends, prepend=0))
        if names:
            self._learn(names, np.concatenate(flat), np.concatenate(lengths))

    def _learn_others(self, pieces: list[str]) -> None:
        short = [piece if len(piece) <= LEAF else "" for piece in pieces]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(short, add_special_tokens=False)]
        for i, piece in enumerate(pieces):
            if len(piece) > LEAF:
                found[i] = tree_encode(self.tokenizer, piece)[:, 0].tolist()
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._learn(pieces, np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())), lengths)

    def _look_at_pending(self) -> None:
        known, pending = self.pieces, self.pending
        # All chunks are matched as lines of one text: they hold no line ends.
        words, signs = map(list, zip(*_WORDS_AND_SIGNS.findall("\n".join(pending)), strict=True))
        words = "\n".join(words).lower().split("\n")
        for i in [i for i, word in enumerate(words) if not word or len(word) > MOST_WORD]:
            words[i], signs[i] = "", ""
        names = [word or chunk for word, chunk in zip(words, pending, strict=True)]
        seen = known.__contains__
        self._learn_words(list(filterfalse(seen, dict.fromkeys(words))))
        self._learn_others(list(filterfalse(seen, dict.fromkeys(chain(names, signs)))))
        places = np.empty((len(pending), 2), np.int64)
        for column, own in enumerate((names, signs)):
            places[:, column] = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
        self.two = np.concatenate([self.two, places])
        self.pending = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        most = MEMO if self.most is None else self.most
        if len(self.pieces) > most:
            self._forget()
        elif len(self) > most:
            self._forget_chunks()
        chunks = [split_chunks(text) for text in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        if self.pending:
            self._look_at_pending()
        pieces = self.two[places].ravel()
        lengths = self.lengths[pieces]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[pieces] - (ends - lengths), lengths)
        flat = self.ids[shift + np.arange(len(shift))]
        text_ends = np.concatenate([[0], ends])[2 * np.cumsum(counts)]
        return np.split(flat, text_ends[:-1]) if len(texts) else []


def chunk_encoder(path: str, memo: int | None = None) -> ChunkEncoder:
    """One encoder per worker process; later tasks of the worker find it filled."""
    tokenizer = load_tokenizer(path)
    encoder = hold("tokenizers", ("chunks", path), lambda: ChunkEncoder(tokenizer))
    encoder.most = memo
    return encoder


def in_slices(texts: list[str], most: int = SLICE_CHARS):
    """Places of consecutive texts with at most about ``most`` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
