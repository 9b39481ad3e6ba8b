"""Language identification: known words first, then ever shorter character n-grams.

Every word of a text that the model knows adds its log frequency per language. A word it
doesn't know is looked up by its n-grams (of the word between spaces): the longest n
from ``LONGEST`` down of which the model knows any, by the mean over the known ones; a
word without known n-grams adds nothing. Words are runs of ASCII letters and non-ASCII
characters, in lower case.

The model is learned from at most about ``per_language`` rows of each language, drawn by
a hash of the id. Words are counted in Spark; n-grams are those of the different words of a
language, each once, so neither depends on how rows lie in files. Of each language its most frequent
words and n-grams are kept, an equal part of ``max_words`` and ``max_grams``, so the model's size has a
bound and rare languages keep theirs. Languages are as many as the column has values; their number
is taken to be small.

Null texts and texts without any letter are ``und`` with score 0. A text with letters but
nothing known gets the most frequent language, with its share as the score. Ties go to
the language first in alphabetical order. Without rows to learn from all is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from routescope.llm.tables import saved
from routescope.llm.words import ALPHA, Words, arrow_rows, mix, span_hashes
from routescope.session import ship_package

LONGEST = 5
PER_LANGUAGE = 2000
MAX_WORDS = 200_000
MAX_GRAMS = 300_000
EVIDENCE = 40.0  # words; more make a score no surer


def grams(words: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of the words at ``which``, between spaces, and whose they are."""
    size = words.end[which] - words.begin[which] + 2
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(which)), size)
    place = np.arange(at[-1]) - at[owner]
    inner = (place > 0) & (place < size[owner] - 1)
    text = np.full(at[-1], 32, np.uint8)
    text[inner] = words.kept[words.begin[which][owner[inner]] + place[inner] - 1]
    chars = np.flatnonzero((text & 0xC0) != 0x80)
    ends = np.append(chars[1:], at[-1])
    who = owner[chars]
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = who[:m] == who[n - 1 :]
    begin, end = chars[:m][whole], ends[n - 1 :][whole]
    return mix(span_hashes(text, begin, end) + np.uint64(n)), who[:m][whole]


@dataclass
class Table:
    """Sorted hashes with a log frequency per language."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, at


@dataclass
class Model:
    languages: list[str]
    share: np.ndarray
    words: Table
    grams: Table

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share of belief, by row."""
        rows = len(w.first) - 1
        counts = np.diff(w.first)
        known, at = self.words.find(w.hashes)
        value = np.zeros((len(w.hashes), len(self.languages)), np.float32)
        value[known] = self.words.logs[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            _, one, back = np.unique(w.hashes[new], return_index=True, return_inverse=True)
            value[new] = self._unseen(w, new[one])[back]
        total = np.zeros((rows, len(self.languages)))
        full = counts > 0
        if full.any():
            total[full] = np.add.reduceat(value, w.first[:-1][full], axis=0, dtype=np.float64)
        total *= np.minimum(1.0, EVIDENCE / np.maximum(counts, 1))[:, None]
        total += np.log(self.share)
        belief = np.exp(total - total.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
        best = np.round(belief, 9).argmax(axis=1)
        return best, np.round(belief[np.arange(rows), best], 6)

    def _unseen(self, w: Words, which: np.ndarray) -> np.ndarray:
        order = np.argsort(which)
        which = which[order]
        value = np.zeros((len(which), len(self.languages)), np.float32)
        left = np.arange(len(which))
        for n in range(LONGEST, 0, -1):
            hashes, owner = grams(w, which[left], n)
            known, at = self.grams.find(hashes)
            if known.any():
                hits = np.bincount(owner[known], minlength=len(left))
                for k in range(len(self.languages)):
                    sums = np.bincount(owner[known], self.grams.logs[at[known], k], len(left))
                    value[left[hits > 0], k] = (sums / np.maximum(hits, 1))[hits > 0]
                left = left[hits == 0]
            if not len(left):
                break
        out = np.empty_like(value)
        out[order] = value
        return out


def _words(rows: DataFrame) -> DataFrame:
    """(lang, hash, word, n): the words of each language with their counts; words are combined before they are shuffled."""

    def run(batches):
        for batch in batches:
            text, lang = batch.column("text"), np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, w in arrow_rows(text, ALPHA):
                of = np.repeat(lang[lo:hi], np.diff(w.first))
                for name in sorted(set(lang[lo:hi])):
                    own = np.flatnonzero(of == name)
                    hashes, one, n = np.unique(w.hashes[own], return_index=True, return_counts=True)
                    spelt = [w.kept[a:b].tobytes() for a, b in zip(w.begin[own[one]], w.end[own[one]])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(spelt, pa.binary()), pa.array(n.astype(np.int64))],
                        ["lang", "hash", "word", "n"])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, "lang string, hash bigint, word binary, n bigint").groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


def _grams(words: DataFrame) -> DataFrame:
    """(lang, hash, n): the n-grams of each language's words, every word once."""

    def run(batches):
        for batch in batches:
            spelt, lang = batch.column("word").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for name in sorted(set(lang)):
                own = [spelt[i] for i in np.flatnonzero(lang == name)]
                data = np.frombuffer(b"".join(own), np.uint8)
                w = Words(data, np.concatenate([[0], np.cumsum([len(x) for x in own])]), ALPHA)
                for length in range(1, LONGEST + 1):
                    hashes, n = np.unique(grams(w, np.arange(len(w.begin)), length)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "hash", "n"])

    return words.select("lang", "word").mapInArrow(run, "lang string, hash bigint, n bigint").groupBy("lang", "hash").agg(F.sum("n").alias("n"))


def _table(sums: DataFrame, languages: list[str], most: int) -> Table:
    """The most frequent hashes of each language, ``most`` in all, with log frequencies smoothed by half a count."""
    each = max(1, most // len(languages))
    totals = {r["lang"]: float(r["n"]) for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    ranked = sums.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "hash")))
    chosen = ranked.where(F.col("r") <= each).select("hash").distinct()  # at most ``most``
    rows = sums.join(chosen, "hash", "left_semi").select("hash", "lang", "n").toPandas()
    keys = np.unique(rows["hash"].to_numpy(np.int64).view(np.uint64))
    counts = np.zeros((len(keys), len(languages)))
    at = np.searchsorted(keys, rows["hash"].to_numpy(np.int64).view(np.uint64))
    np.add.at(counts, (at, [languages.index(x) for x in rows["lang"]]), rows["n"].to_numpy(float))
    size = np.array([totals.get(x, 0.0) for x in languages]) + 1
    return Table(keys, np.log((counts + 0.5) / size).astype(np.float32))


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model | None:
    """A model from the rows with a language for which ``usable`` holds."""
    usable = F.lit(True) if usable is None else usable
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return None
    names = sorted(found)
    parts = 1 << 20
    cuts = docs.sparkSession.createDataFrame([(name, int(min(1.0, per_language / found[name]) * parts)) for name in names], "lang string, cut bigint")
    drawn = rows.join(F.broadcast(cuts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.col("cut"))  # a row for each language
    text = drawn.select(F.lower("text").alias("text"), "lang")
    counted = saved(_words(text), "words")
    words = _table(counted.groupBy("lang", "hash").agg(F.sum("n").alias("n")), names, max_words)
    shorter = _table(saved(_grams(counted), "grams"), names, max_grams)
    share = np.array([found[n] for n in names], float)
    return Model(names, share / share.sum(), words, shorter)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred`` and ``score``, by the whole text."""
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("__text"), lettered.alias("__lettered"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of max_words and max_grams entries at most

    def run(batches):
        model = shared.value
        for batch in batches:
            text, ok = batch.column("__text"), batch.column("__lettered").to_numpy(zero_copy_only=False)
            best, score = np.full(len(text), -1), np.zeros(len(text))
            for lo, hi, w in arrow_rows(text, ALPHA, 1 << 20) if model else ():
                best[lo:hi], score[lo:hi] = model.scores(w)
            best[~ok], score[~ok] = -1, 0.0
            names = np.array([*(model.languages if model else []), "und"], object)[best]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("__text", "__lettered")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score)], names=[f.name for f in schema])

    ship_package(docs.sparkSession)
    return rows.mapInArrow(run, schema)
