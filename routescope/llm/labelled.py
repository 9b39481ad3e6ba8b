"""Labelled samples, folds and per-row scoring shared by the trained text classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.llm.words import ALNUM, Words, arrow_rows
from routescope.session import ship_package

BUCKETS = 1 << 18


def fold(doc_id: str, parts: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves ``held`` when divided by ``parts``; no for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == held, F.lit(False))


def _known(labels: DataFrame, target: str, usable: Column | None) -> DataFrame:
    usable = F.lit(True) if usable is None else usable
    return labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))


def class_rows(docs: DataFrame, labels: DataFrame, target: str, usable: Column | None = None) -> tuple[int, int]:
    """Rows of ``docs`` labelled 0 and 1 that ``labelled`` draws from, all of them counted; ids only are read."""
    rows = docs.select("doc_id").join(_known(labels, target, usable), "doc_id").groupBy("y").count().collect()
    found = {r["y"]: r["count"] for r in rows}
    return found.get(0, 0), found.get(1, 0)


def class_weights(sampled: np.ndarray, whole: tuple[int, int] | None) -> tuple[float, np.ndarray]:
    """Share of label 1 in the ``whole`` table, and what a sampled row of each class weighs: its
    class's share there over that in the sample. Without ``whole`` the sample is the table."""
    own = np.bincount(sampled, minlength=2)[:2]
    if whole is None or not sum(whole):
        whole = tuple(own)
    there = np.array(whole, np.float64) / max(1, sum(whole))
    here = own / max(1, own.sum())
    return float(there[1]), np.where(own > 0, there / np.where(own > 0, here, 1.0), 0.0)


def labelled(docs: DataFrame, labels: DataFrame, target: str, per_class: int, usable: Column | None = None) -> DataFrame:
    """Whole texts of at most ``per_class`` labelled ids a class, those first by a hash of the id.

    A null label or id is left out; an id labelled both ways counts as 1. The ids picked
    are few by their bound, so the planner sends them to the texts, not the reverse."""
    known = _known(labels, target, usable)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), stated_size(docs).alias("size"))
    return texts.join(picked[0].unionAll(picked[1]), "doc_id")


def every_labelled(docs: DataFrame, labels: DataFrame, target: str, usable: Column | None, parts: int) -> DataFrame:
    """(doc_id, text, lang, y): whole texts of all labelled rows, in ``parts`` partitions by id; which labels count
    is as in ``labelled``. Texts are shuffled once: both sides lie alike before they meet."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    known = _known(labels, target, usable)
    return texts.where("doc_id is not null").repartition(parts, "doc_id").join(known.repartition(parts, "doc_id"), "doc_id")


def stated_size(docs: DataFrame) -> Column:
    """The length that a table's metadata gives a text; null where it has none."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double")


def hashed_rows(
    rows: DataFrame, encode: Callable[[Words], np.ndarray], extra: Callable[[pa.Array, pa.Array], np.ndarray] | None = None
) -> DataFrame:
    """(doc_id, y, lang, ids, extra): what ``encode`` makes of each row's words as 32-bit
    integers, a line for each word, and what ``extra`` says of its text and stated size as doubles."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            more = extra(text, batch.column("size")) if extra else np.zeros((len(text), 0))
            for lo, hi, w in arrow_rows(text, ALNUM):
                ids = encode(w).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo),
                     batch.column("lang").slice(lo, hi - lo),
                     pa.array([ids[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])], pa.binary()),
                     pa.array([row.tobytes() for row in more[lo:hi]], pa.binary())],
                    ["doc_id", "y", "lang", "ids", "extra"])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, "doc_id bigint, y int, lang string, ids binary, extra binary")


def buckets(words: Words) -> np.ndarray:
    return (words.hashes & np.uint64(BUCKETS - 1)).astype(np.int32)


def gathered(rows: DataFrame, max_words: int, width: int = 1) -> list[tuple[int, str | None, np.ndarray, np.ndarray]]:
    """(label, language, buckets, extra) of the sample in hash order, to the driver one
    partition at a time, until it holds ``max_words`` words of ``width`` buckets each."""
    out, total = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "ids").toLocalIterator():
        ids = np.frombuffer(bytes(r["ids"]), np.int32)
        words = len(ids) // width
        if total + words > max_words:
            continue
        total += words
        out.append((r["y"], r["lang"], ids, np.frombuffer(bytes(r["extra"]), np.float64)))
    return out


def scored(docs: DataFrame, keep: list[str], run: Callable[[pa.Array, pa.Array], np.ndarray], column: str = "score") -> DataFrame:
    """``docs`` with its columns ``keep`` and a score of each row's whole text and stated size, in one pass without a shuffle."""
    clean = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"), stated_size(docs).alias("__size"))
    schema = docs.select(*keep, F.lit(0.0).alias(column)).schema

    def score(batches):
        for batch in batches:
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in ("__text", "__size")]
            values = run(*[batch.column(batch.schema.get_field_index(c)) for c in ("__text", "__size")])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.float64())], names=[f.name for f in schema])

    ship_package(docs.sparkSession)
    return clean.mapInArrow(score, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
