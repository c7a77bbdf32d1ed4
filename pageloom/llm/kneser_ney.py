"""Operator 10: quality by the perplexity of a Kneser-Ney bigram model of trusted text.

Trained per language on the documents that labels call good (and not toxic). All words and
all pairs of neighbours in the trusted texts count, however rare; the model grows with the input. A word is known by a code
of 63 bits, of which four are its shape (case, digits, signs). Counts are gathered as DataFrames: equal pairs meet
by code, the totals of contexts and the continuation counts of words make interpolated modified
Kneser-Ney probabilities. A word that no trusted text has gets the probability of a word never seen, shared out among
the shapes as those are frequent among the words with a single context. A word that follows itself, but does so in no trusted
text, counts as never seen too, of a shape of its own: how many words it follows elsewhere says nothing about that.

Pairs and words of a language are stored in the shared folder, sorted by code and cut into parts. Documents are scored where
they are: a task holds texts of ``GROUP_BYTES``, reads the stored counts past the different words and
pairs in them, a bounded number of rows at a time, and keeps what it finds. So neither texts nor their pairs are
shuffled, and memory depends neither on the size of the model nor on that of the input; the stored counts are read once for every
``GROUP_BYTES`` of text.

A fifth of the trusted documents is held out of training and gives the thresholds: a
document is kept if its log perplexity is at most the ``QUANTILE`` of its language's
held-out documents, plus ``MARGIN`` times the distance of that quantile to their
median. The log perplexity of few words says little, so it is judged together
with ``PRIOR`` words at the median. A language without held-out documents keeps all.

All good labels choose trusted documents: up to ``BROADCAST_LABELS`` of them are broadcast, more are
joined by a shuffle. Every language with a trusted document has a model of its own. Where there are more than
``LANGUAGES_HELD``, rows are sorted by language first, so that a group has few of them. Words, counts and
quantiles cover all texts of the trusted documents.

Null and empty texts have no perplexity and are kept; so are all documents if
nothing is trusted. Trusted documents without a language make the model of the languages that have none. Long texts
are scored whole.
Older columns named ``log_perplexity`` and ``good`` are replaced, by ``keep_good`` they are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.chunk_encoder import in_slices
from pageloom.llm.common import add_columns, hold, slices, small_batches
from pageloom.session import materialize, new_dir

BROADCAST_LABELS = 1_000_000
LANGUAGES_HELD = 8  # that a group of rows may have before rows are sorted by language
OTHERS = "*"
QUANTILE = 0.99
MARGIN = 0.5
PRIOR = 20
HELD_OUT = 5  # one of so many
PART_CHARS = 16_000_000  # of trusted texts whose pairs make one stored part
GROUP_BYTES = 16 << 20  # of texts that are scored with one reading of the stored counts
LOAD_ROWS = 131_072  # of stored counts that are read at once
FLUSH = 1_000_000  # words that a task counts before it passes them on
MEMO = 100_000  # words whose code a worker remembers
SLICE_CHARS = 500_000  # of texts that are cut into words at once
SLICE_BYTES = 1 << 20  # of rows that are turned into objects at once

SHAPES = 16  # classes of words never seen
REPEATED = SHAPES - 1  # the class of a word that repeats the one before, and was never seen to
START = SHAPES  # code of what stands before the first word
CODE_BITS = 29  # of the place of a word in the code of a pair within a group
_LETTERS = re.compile(r"[^\W\d_]")
_SIGN_END = re.compile(r"[^\w\s]{2,}$|[#$%&*@~^|<>=+\\/_]")


def shape(word: str, before: str | None) -> int:
    """The class of a word outside the vocabulary; a word that repeats the one before has its own."""
    if word == before:
        return REPEATED
    stem = word[:-1] if word[-1] in ".," else word
    if stem.isalpha() and stem.islower():  # most words
        return 6 if len(word) > 14 else 2
    if not _LETTERS.search(word):
        return 0 if any(c.isdigit() for c in word) else 1
    kind = 2
    if word.isupper() and len(word) > 1:
        kind = 3
    elif word[0].isupper():
        kind = 4
    elif any(c.isdigit() for c in word):
        kind = 5
    if _SIGN_END.search(word):
        return kind + 8
    return kind + 4 if len(word) > 14 else kind


class Codes(dict):
    """Codes of words, remembered: a hash, the last four bits are the shape."""

    def of(self, words: list[str]) -> np.ndarray:
        places, different = pd.factorize(np.array(words, dtype=object))
        new = [word for word in different if word not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = list(different)
        if new:
            hashes = pd.util.hash_array(np.array(new, dtype=object), categorize=False) >> np.uint64(1)
            shapes = np.fromiter((shape(word, None) for word in new), np.int64, len(new))
            self.update(zip(new, (hashes.astype(np.int64) & -SHAPES | shapes).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, different), np.int64, len(different))[places]


def word_codes(texts: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words of all texts, ``START`` before the first of each, and how many a text has with it."""
    pieces, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in in_slices(texts, SLICE_CHARS):
        words = [text.split() for text in texts[a:b]]
        own = np.fromiter(map(len, words), np.int64, len(words))
        pieces.append(np.insert(codes.of(list(chain.from_iterable(words))), np.cumsum(own) - own, START))
        counts.append(own + 1)
    return np.concatenate(pieces), np.concatenate(counts)


@dataclass(frozen=True)
class Smoothing:
    """What is the same for all pairs of a language."""

    discounts: tuple[float, float, float]
    unseen: tuple[float, ...]  # the probability of a word never seen, by shape


@dataclass(frozen=True)
class Model:
    folder: str  # of the counts
    vocabulary: dict[str, int]  # different words by language
    smoothing: dict[str, Smoothing]
    medians: dict[str, float]  # of the log perplexity of held-out documents, by language
    thresholds: dict[str, float]


def _language(languages: list[str], column: str = "lang"):
    own = F.coalesce(F.col(column), F.lit(OTHERS))
    return F.when(own.isin(languages), own).otherwise(F.lit(OTHERS)) if languages else F.lit(OTHERS)


def _by_turns(rows: DataFrame, column: str, languages: int) -> DataFrame:
    """The rows, those of a language next to each other in a task if there are many languages."""
    return rows.sortWithinPartitions(column) if languages > LANGUAGES_HELD else rows


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(language, u, v, n)``: the pairs of words in ``(language, text)``, each about once for ``FLUSH`` words.

    Rows of a word follow each other, so that its code takes little room when they are shuffled.
    """
    hold("words")
    codes, held, size = Codes(), {}, 0

    def flush():
        for language in list(held):
            different, ids = np.unique(np.concatenate(held.pop(language)), return_inverse=True)
            pair, n = np.unique(ids[:-1] << CODE_BITS | ids[1:], return_counts=True)
            u, v = different[pair >> CODE_BITS], different[pair & (1 << CODE_BITS) - 1]
            inside = v != START
            columns = [np.full(len(u), language, np.int32), u, v, n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(column[inside]) for column in columns], ["language", "u", "v", "n"])

    for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
        languages, texts = np.array(batch.column("language").to_pylist()), batch.column("text").to_pylist()
        for language in np.unique(languages).tolist():
            found, _ = word_codes([texts[i] for i in np.flatnonzero(languages == language)], codes)
            held.setdefault(language, []).append(found)
            size += len(found)
        if size > FLUSH:
            yield from flush()
            size = 0
    yield from flush()


def _discounts(counts: DataFrame, column: str) -> DataFrame:
    """Three discounts per language from the numbers of entries counted one to four times."""
    n = [F.sum((F.col(column) == k).cast("double")) for k in (1, 2, 3, 4)]
    sums = counts.groupBy("language").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    some = lambda k: F.when(F.col(f"n{k}") > 0, k - (k + 1) * F.col("y") * F.col(f"n{k + 1}") / F.col(f"n{k}"))
    # Small samples can give values outside the sensible range.
    safe = lambda k: F.least(F.greatest(F.coalesce(some(k), F.lit(0.5 * k)), F.lit(0.1)), F.lit(k * 0.95))
    return sums.withColumn("y", y).select("language", *[safe(k).alias(f"d{k}") for k in (1, 2, 3)])


def _discount(column: str):
    c = F.col(column)
    return F.when(c >= 3, F.col("d3")).when(c == 2, F.col("d2")).otherwise(F.col("d1"))


def _contexts(bigrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs with their discount ``d``, and ``(language, u, total, left)``: counts and discounts after ``u``."""
    high = bigrams.join(F.broadcast(_discounts(bigrams, "n")), "language").withColumn("d", _discount("n"))
    return high, high.groupBy("language", "u").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))


def _shorter(follows: DataFrame, classes: int | None) -> tuple[DataFrame, DataFrame]:
    """``(language, v, p)`` of the shorter model, and ``(language, share)``: its probability of a word never seen.

    ``classes`` is the number of words there can be; without it, one more than there are.
    """
    low = follows.join(F.broadcast(_discounts(follows, "a")), "language").withColumn("d", _discount("a"))
    words = F.count("*") + 1 if classes is None else F.lit(classes)
    sums = low.groupBy("language").agg(F.sum("a").alias("pairs"), (F.sum("d") / F.sum("a") / words).alias("share"))
    low = low.join(F.broadcast(sums), "language")
    p = (F.col("a") - F.col("d")) / F.col("pairs") + F.col("share")
    return low.select("language", "v", p.alias("p")), sums.select("language", "share")


def probabilities(bigrams: DataFrame, classes: int | None = None) -> DataFrame:
    """``(language, u, v, logp)`` of seen pairs; ``v`` -1: log weight of the shorter model after ``u``;
    ``u`` -1: the shorter model's log probability of ``v``; both -1: of a word never seen."""
    high, contexts = _contexts(bigrams)
    contexts = contexts.withColumn("gamma", F.col("left") / F.col("total"))
    words, rest = _shorter(bigrams.groupBy("language", "v").agg(F.count("*").alias("a")), classes)
    seen = high.join(contexts, ["language", "u"]).join(words, ["language", "v"])
    p = (F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("p")
    none = F.lit(-1).cast("long")
    return (
        seen.select("language", "u", "v", F.log(p).alias("logp"))
        .unionByName(contexts.select("language", "u", none.alias("v"), F.log("gamma").alias("logp")))
        .unionByName(words.select("language", none.alias("u"), "v", F.log("p").alias("logp")))
        .unionByName(rest.select("language", none.alias("u"), none.alias("v"), F.log("share").alias("logp")))
    )


@dataclass(frozen=True)
class Pairs:
    """Log probabilities for a group of texts: of seen pairs, and of the shorter model for all others."""

    codes: np.ndarray  # of seen pairs, sorted
    logp: np.ndarray
    weight: np.ndarray  # log weight of the shorter model after each word
    word: np.ndarray  # the shorter model's log probability of each word

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The log probability of each id after the one before it."""
        before, after = ids[:-1], ids[1:]
        shorter = self.weight[before] + self.word[after]
        if not len(self.codes):
            return shorter
        code = before.astype(np.int64) << CODE_BITS | after
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[place] == code, self.logp[place], shorter)


def _stored_rows(folder: str, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of what is stored in a folder, a bounded number of rows at a time, which are sorted."""
    store, path = fs.FileSystem.from_uri(folder)
    for entry in store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)):
        if entry.is_file and entry.base_name.endswith(".parquet"):
            with store.open_input_file(entry.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(LOAD_ROWS, columns=columns):
                    if batch.num_rows:
                        yield [batch.column(name).to_numpy(zero_copy_only=False) for name in columns]


def _words(folder: str, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """``p``, ``total`` and ``left`` of each of the sorted codes; no number where there is nothing."""
    found = tuple(np.full(len(wanted), np.nan) for _ in range(3))
    for code, *values in _stored_rows(folder, ["code", "p", "total", "left"]):
        a, b = np.searchsorted(wanted, code[0]), np.searchsorted(wanted, code[-1], "right")
        place = np.minimum(np.searchsorted(code, wanted[a:b]), len(code) - 1)
        hit = np.flatnonzero(code[place] == wanted[a:b])
        for out, value in zip(found, values, strict=True):
            out[a + hit] = value[place[hit]]
    return found


def _counts(folder: str, wanted_u: np.ndarray, wanted_v: np.ndarray) -> np.ndarray:
    """How often each of the sorted pairs of codes was counted."""
    found = np.zeros(len(wanted_u))
    for u, v, n in _stored_rows(folder, ["u", "v", "n"]):
        a, b = np.searchsorted(wanted_u, u[0]), np.searchsorted(wanted_u, u[-1], "right")
        own_u, own_v = wanted_u[a:b], wanted_v[a:b]
        # The rows of the first word, halved until the second one is found.
        low, high = np.searchsorted(u, own_u), np.searchsorted(u, own_u, "right")
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = v[middle] < own_v[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        last = np.minimum(low, len(u) - 1)
        hit = np.flatnonzero((u[last] == own_u) & (v[last] == own_v))
        found[a + hit] += n[last[hit]]
    return found


def _read(folder: str, place: int, smoothing: Smoothing, different: np.ndarray, ids: np.ndarray) -> Pairs:
    """The probabilities that a group needs: of the sorted codes of its words, and of their pairs in ``ids``."""
    p, total, left = _words(f"{folder}/words/language={place}", different)
    p = np.where(np.isnan(p), np.array(smoothing.unseen)[different & SHAPES - 1], p)
    known = total > 0
    gamma = np.divide(left, total, where=known, out=np.ones(len(total)))  # after a context never seen the shorter model holds
    pair = np.sort(ids[:-1] << CODE_BITS | ids[1:])
    pair = pair[np.diff(pair, prepend=-1) > 0]
    u, v = pair >> CODE_BITS, pair & (1 << CODE_BITS) - 1
    n = _counts(f"{folder}/pairs/language={place}", different[u], different[v])
    seen, again = n > 0, (u == v) & (different[u] != START)
    discount = np.array(smoothing.discounts)[np.minimum(n[seen], 3).astype(np.int64) - 1]
    logp = np.full(len(pair), np.log(smoothing.unseen[REPEATED]))
    logp[again] += np.log(gamma[u[again]])
    logp[seen] = np.log((n[seen] - discount) / total[u[seen]] + gamma[u[seen]] * p[v[seen]])
    own = seen | again
    return Pairs(pair[own], logp[own], np.log(gamma), np.log(p))


def _places(languages) -> dict[str, int]:
    """The number of the folder of each language; names can be anything."""
    return {language: place for place, language in enumerate(sorted(languages))}


def with_log_perplexity(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``log_perplexity``, minus the mean log probability of the words (null without any), and their number ``_scored_words``."""
    folder, smoothing = model.folder, model.smoothing
    places = _places(model.vocabulary)

    def start():
        hold("words")
        codes = Codes()

        def work(languages, texts):
            out: list = [None] * len(texts)
            n_words = [0] * len(texts)
            by: dict[str, list[int]] = {}
            for i, (language, text) in enumerate(zip(languages, texts, strict=True)):
                own = language if language in places else OTHERS
                if text and own in smoothing:
                    by.setdefault(own, []).append(i)
            for language, rows in by.items():
                found, counts = word_codes([texts[i] for i in rows], codes)
                different, ids = np.unique(found, return_inverse=True)
                logp = _read(folder, places[language], smoothing[language], different, ids).of(ids)
                ends = np.cumsum(counts)
                for i, a, b in zip(rows, (ends - counts).tolist(), (ends - 1).tolist(), strict=True):
                    if b > a:
                        out[i] = -float(logp[a:b].mean())
                        n_words[i] = b - a
            return out, n_words

        return work

    documents = _by_turns(documents, "lang", len(places))
    return add_columns(documents, ["lang", "text"], "log_perplexity double, _scored_words long", start, SLICE_BYTES, GROUP_BYTES)


def trusted_documents(documents: DataFrame, labels: DataFrame, max_labels: int | None = None) -> DataFrame:
    """``(doc_id, lang, text)`` of the documents with a good label: all of them, unless ``max_labels`` asks for fewer."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    if max_labels is not None and n > max_labels:
        cut = good.select(F.percentile_approx(F.xxhash64("doc_id"), max_labels / n, 100_000)).head()[0]
        good = good.where(F.xxhash64("doc_id") < cut)
    some = documents.where("text is not null and text <> ''").select("doc_id", "lang", "text")
    if n <= BROADCAST_LABELS:
        return some.join(F.broadcast(good), "doc_id", "left_semi")
    # Shuffled once, and read several times by the fit.
    return materialize(some.join(good, "doc_id", "left_semi"), "trusted")


def fit(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> Model:
    """Counts, probabilities and thresholds; the driver gets a few numbers of each language only."""
    with small_batches(documents.sparkSession):
        return _fit(documents, labels, quantile, margin)


def _in_parts(rows: DataFrame, code: str, parts: DataFrame) -> DataFrame:
    """The rows with the ``part`` of their language that their code belongs to."""
    place = F.shiftright(F.shiftright(code, 63 - 31) * F.col("parts"), 31).cast("int")
    return rows.join(F.broadcast(parts), "language").withColumn("part", place).drop("parts")


def _write_parts(rows: DataFrame, folder: str, *order: str) -> None:
    sorted_rows = rows.sortWithinPartitions("language", "part", *order)
    sorted_rows.write.partitionBy("language", "part").option("compression", "zstd").parquet(folder)


def _count(text: DataFrame, parts: DataFrame, tasks: int, folder: str) -> DataFrame:
    """``(language, u, v, n)`` of all pairs in ``(language, text)``, stored by the code of the first word."""
    counted = _in_parts(text.mapInArrow(_pair_counts, "language int, u long, v long, n long"), "u", parts)
    # Shuffled once: all counts of a pair are in its part.
    counted = counted.repartition(tasks, "language", "part").groupBy("language", "part", "u", "v").agg(F.sum("n").alias("n"))
    _write_parts(counted, f"{folder}/pairs", "u", "v")
    return text.sparkSession.read.schema("u long, v long, n long, language int, part int").parquet(f"{folder}/pairs").drop("part")


def _smooth(bigrams: DataFrame, parts: DataFrame, tasks: int, folder: str) -> dict[int, tuple[int, Smoothing]]:
    """Store ``(code, p, total, left)`` of all words; their number and what is the same for all pairs, by language."""
    follows = materialize(bigrams.groupBy("language", "v").agg(F.count("*").alias("a")), "follows")
    _, contexts = _contexts(bigrams)
    low, rest = _shorter(follows, None)
    words = contexts.withColumnRenamed("u", "code").join(low.withColumnRenamed("v", "code"), ["language", "code"], "full")
    words = _in_parts(words, "code", parts).repartition(tasks, "language", "part")
    _write_parts(words.select("language", "part", "code", "p", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("left", F.lit(0.0)).alias("left")), f"{folder}/words", "code")
    discounts = {row["language"]: (row["d1"], row["d2"], row["d3"]) for row in _discounts(bigrams, "n").collect()}
    once = follows.where("a = 1").groupBy("language", F.col("v").bitwiseAND(F.lit(SHAPES - 1)).alias("shape")).count().collect()
    shapes = {language: np.ones(SHAPES) for language in discounts}
    for row in [*once, *bigrams.where("u = v and n = 1").groupBy("language", F.lit(REPEATED).alias("shape")).count().collect()]:
        shapes[row["language"]][row["shape"]] += row["count"]
    share = {row["language"]: row["share"] for row in rest.collect()}
    sizes = {row["language"]: row["count"] for row in follows.groupBy("language").count().collect()}
    return {k: (sizes[k], Smoothing(d, tuple(share[k] * shapes[k] / shapes[k].sum()))) for k, d in discounts.items()}


def _fit(documents: DataFrame, labels: DataFrame, quantile: float, margin: float) -> Model:
    spark = documents.sparkSession
    trusted = trusted_documents(documents, labels)
    sizes = {row["lang"]: row["chars"] for row in trusted.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()}
    places = _places({OTHERS, *sizes} - {None})
    by_place = [(place, -(-(sizes.get(k, 0) + (sizes.get(None, 0) if k == OTHERS else 0)) // PART_CHARS) or 1) for k, place in places.items()]
    parts, tasks = spark.createDataFrame(by_place, "language int, parts int"), sum(n for _, n in by_place)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    chosen = trusted.withColumn("language", F.coalesce("lang", F.lit(OTHERS)))
    numbers = F.broadcast(spark.createDataFrame([(k, place) for k, place in places.items()], "name string, place int"))
    text = chosen.where(~held_out).join(numbers, F.col("language") == F.col("name")).select(F.col("place").alias("language"), "text")
    folder = new_dir(spark, "kneser-ney")
    made = _smooth(_count(text, parts, tasks, folder), parts, tasks, folder)
    known = {k: made[place][0] if place in made else 0 for k, place in places.items()}
    smoothing = {k: made[place][1] for k, place in places.items() if place in made}
    model = Model(folder, known, smoothing, {}, {})
    others = chosen.where(held_out).select(F.col("language").alias("lang"), "text")
    scored = with_log_perplexity(others, model).where("_scored_words > 0")
    # First the medians, then the quantiles of what is judged together with them.
    scored = materialize(scored.select("lang", "log_perplexity", "_scored_words"), "held-out")
    middle = scored.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("q")).collect()
    medians = {row["lang"]: row["q"] for row in middle}
    judged = _judged(scored, medians).groupBy("lang")
    found = judged.agg(F.percentile_approx("_judged", [0.5, quantile], 10_000).alias("q")).collect()
    limits = {row["lang"]: row["q"][1] + margin * (row["q"][1] - row["q"][0]) for row in found}
    return Model(folder, known, smoothing, medians, limits)


def _by_language(values: dict[str, float], language: Column) -> Column:
    if not values:
        return F.lit(None).cast("double")
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))[language]


def _judged(scored: DataFrame, medians: dict[str, float], language: Column | None = None) -> DataFrame:
    middle = _by_language(medians, F.col("lang") if language is None else language)
    mean = (F.col("log_perplexity") * F.col("_scored_words") + middle * PRIOR) / (F.col("_scored_words") + PRIOR)
    return scored.withColumn("_judged", mean)


def with_quality(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``log_perplexity`` and ``good``."""
    language = _language([k for k in model.vocabulary if k != OTHERS])
    scored = _judged(with_log_perplexity(documents, model), model.medians, language)
    good = F.col("_judged") <= _by_language(model.thresholds, language)
    return scored.withColumn("good", F.coalesce(good, F.lit(True))).drop("_judged", "_scored_words")


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The good documents with their own columns, whatever those are called."""
    own = {name: f"_own_{name}" for name in ("log_perplexity", "good") if name in documents.columns}
    kept = with_quality(documents.withColumnsRenamed(own), model).where("good").drop("log_perplexity", "good")
    return kept.withColumnsRenamed({new: name for name, new in own.items()}).select(*documents.columns)
