"""The traffic detector that needs numpy inside tasks.

Isolation trees grow on samples of a fixed size; scoring is spread over cells of every series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routescope.operators.traffic import KEY
from routescope.session import ship_package

TREES = 100
SAMPLE = 256
CELL = 65_536  # points scored in one group


def _average_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _tree(values: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """One isolation tree on a line: cut points and the depth of each interval between."""
    cuts: list[float] = []
    depths: list[float] = []
    stack = [(np.sort(values), 0)]
    while stack:
        part, depth = stack.pop()
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            depths.append(depth + _average_depth(len(part)))
            continue
        cut = rng.uniform(part[0], part[-1])
        split = np.searchsorted(part, cut, side="right")
        cuts.append(cut)
        stack.append((part[split:], depth + 1))
        stack.append((part[:split], depth + 1))
    # leaves come off the stack from left to right
    return np.sort(np.array(cuts)), np.array(depths)


def grown(train: np.ndarray, seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trees of a forest, each of at most ``SAMPLE`` of the training values."""
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, len(train))
    limit = int(np.ceil(np.log2(max(size, 2))))
    return [_tree(rng.choice(train, size, replace=False), rng, limit) for _ in range(TREES)]


def isolation_scores(trees: list[tuple[np.ndarray, np.ndarray]], size: int, values: np.ndarray) -> np.ndarray:
    """Isolation scores (higher is odder) of ``values`` under trees of ``size`` values each."""
    depth = np.zeros(len(values))
    for cuts, depths in trees:
        depth += depths[np.searchsorted(cuts, values, side="left")]
    return 2.0 ** (-depth / len(trees) / max(_average_depth(size), 1e-12))


def forests(past: DataFrame) -> DataFrame:
    """(series, event_name, size, cuts, depths) of every tree of every series with at least ten past values; numbers as eight bytes each.

    All trees together look at ``TREES`` x ``SAMPLE`` values, as the method has it, so no more
    than that, first by a hash, go to the task that grows them."""
    w = Window.partitionBy(*KEY).orderBy("_h", "period", "idx")
    draw = past.select(*KEY, "period", "idx", "value", F.xxhash64("period", "idx").alias("_h"))
    train = draw.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= TREES * SAMPLE).select(*KEY, "_r", "value")

    def grow(known: pd.DataFrame) -> pd.DataFrame:
        trees = grown(known.sort_values("_r")["value"].to_numpy(float)) if len(known) >= 10 else []
        rows = [(*known[KEY].iloc[0], min(SAMPLE, len(known)), cuts.astype("<f8").tobytes(), depths.astype("<f8").tobytes()) for cuts, depths in trees]
        return pd.DataFrame(rows, columns=[*KEY, "size", "cuts", "depths"], dtype=object)

    ship_package(past.sparkSession)
    return train.groupBy(*KEY).applyInPandas(grow, "series string, event_name string, size int, cuts binary, depths binary")


def unpacked(cuts, depths) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(c, "<f8"), np.frombuffer(d, "<f8")) for c, d in zip(cuts, depths)]


def scored(points: DataFrame, trees: DataFrame) -> DataFrame:
    """``points`` (series, event_name, idx, value, now) with ``score``; a series' points go in cells of about ``CELL``."""
    counts = points.groupBy(*KEY).agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("idx", "value", "now"), F.col("cells")).cast("int").alias("cell")
    left = points.join(counts, KEY).select(*KEY, cell, "idx", "value", "now")
    right = trees.join(counts, KEY).select(*KEY, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "size", "cuts", "depths")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both hold columns of the same sources

    def score(key: tuple, x: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        own = unpacked(forest["cuts"], forest["depths"])
        rows = len(x) if own else 0
        found = isolation_scores(own, int(forest["size"].iloc[0]), x["value"].to_numpy(float)) if rows else []
        series, event = (pd.Series([str(k)] * rows, dtype=object) for k in key[:2])
        return pd.DataFrame({"series": series, "event_name": event, "idx": x["idx"].iloc[:rows].to_numpy(), "now": x["now"].iloc[:rows].to_numpy(bool), "score": found})

    return left.groupBy(*KEY, "cell").cogroup(right.groupBy(*KEY, "cell")).applyInPandas(
        score, "series string, event_name string, idx int, now boolean, score double"
    )


def isolation_forest(current: DataFrame, past: DataFrame, contamination: float = 0.1) -> DataFrame:
    """(series, event_name, idx, ml_score) of current points odder than most of history.

    The limit is the quantile of the scores of all past values."""
    values = lambda df, now: df.select(*KEY, "idx", "value", F.lit(now).alias("now"))
    rows = scored(values(current, True).unionAll(values(past, False)), forests(past))
    limits = rows.groupBy(*KEY).agg(F.percentile(F.when(~F.col("now"), F.col("score")), F.lit(1.0 - contamination)).alias("limit"))
    odd = rows.where("now").join(limits, KEY).withColumn("ml_score", F.col("score") - F.col("limit"))
    return odd.where("ml_score > 0").select(*KEY, "idx", "ml_score")
