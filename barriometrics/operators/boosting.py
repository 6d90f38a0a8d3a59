"""Gradient boosting over folded rows.

Features are binned once, so a tree never needs more of the rows than how many fall into each tuple of
bins and the sum of their labels. One aggregate folds them (``fold``); its size is bounded by the bins, not
by the rows. Each model is then fitted by one task over its tuples, many models side by side, instead of
by jobs for every level of every tree. Splits, leaves and residuals are those of a row-wise fit on the
binned features; row subsampling draws how many of a tuple's rows take part.

A fitted model is constant on a tuple: ``score`` predicts each distinct tuple once and joins.

A row's tuple is one binary column (``_tuple``): expressions that compare each feature with each edge make methods
too long for the JVM to compile, and as many keys to group and join by as there are features.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barriometrics.operators.lookups import attach
from barriometrics.session import materialise

MAX_BINS = 32
#: Tasks over which models are dealt when there are several.
MODEL_TASKS = 64
_MODEL = "model string, base double, starts binary, feature binary, threshold binary, left binary, value binary"


@dataclass(frozen=True)
class BoostedTrees:
    """Trees over binned features: a node sends bins above its threshold to ``left + 1``; leaves have feature -1."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    starts: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Predictions for rows of bins, a column for each feature."""
        total = np.full(len(bins), self.base)
        rows = np.arange(len(bins))
        for start in self.starts:
            at = np.full(len(bins), start)
            while (feature := self.feature[at]).max(initial=-1) >= 0:
                right = bins[rows, feature] > self.threshold[at]
                at = np.where(feature < 0, at, self.left[at] + right)
            total += self.value[at]
        return total


def _bin(feature: str, edges: Sequence[float]) -> Column:
    """How many edges lie below the value; NULL for NULL and NaN."""
    value = F.col(feature).cast("double")
    count = reduce(lambda a, b: a + b, [(value > e).cast("short") for e in edges], F.lit(0).cast("short"))
    return F.when(value.isNotNull() & ~F.isnan(value), count.cast("short"))


def _tuple(features: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """How many edges of each feature lie below its value, as the bytes of 16-bit numbers; NULL where any value is NULL or NaN."""
    cuts = [np.array(e, np.float64) for e in edges]

    @F.pandas_udf("binary")
    def of(*values: pd.Series) -> pd.Series:
        columns = [v.to_numpy(np.float64) for v in values]
        gaps = np.logical_or.reduce([np.isnan(c) for c in columns])
        rows = np.stack([np.searchsorted(e, c) for e, c in zip(cuts, columns, strict=True)], 1).astype(np.int16)
        found = pd.Series(list(map(bytes, rows.view(np.uint8))), dtype=object)
        found[gaps] = None
        return found

    # Not deterministic for the optimizer only: it would else work the column out again below each filter.
    return of.asNondeterministic()(*[F.col(f).cast("double") for f in features])


def _bins(tuples: pd.Series, many: int) -> np.ndarray:
    """Rows of bins, a column for each feature."""
    return np.frombuffer(b"".join(tuples), np.int16).reshape(-1, many)


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> tuple[tuple[float, ...], ...]:
    """Where each feature's bins end: between all its values where they are few, else at even quantiles."""
    steps = [i / max_bins for i in range(1, max_bins)]
    known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double") + F.lit(0.0)) for f in features]
    numbers = df.agg(*[F.approx_count_distinct(c).alias(f"n_{i}") for i, c in enumerate(known)]).first()
    few = [n <= max_bins for n in numbers]  # some tens of values each
    summary = df.agg(*[(F.collect_set(c) if few[i] else F.percentile_approx(c, steps)).alias(f"q_{i}") for i, c in enumerate(known)]).first()
    values = {i: summary[f"q_{i}"] for i in range(len(features)) if few[i]}
    edges = []
    for i in range(len(features)):
        if i in values:
            ordered = sorted(values[i])
            edges.append(tuple((a + b) / 2 for a, b in zip(ordered[:-1], ordered[1:], strict=True)))
        else:
            edges.append(tuple(sorted(set(summary[f"q_{i}"] or []))))
    return tuple(edges)


def fold(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], label: str, model: Column) -> DataFrame:
    """model, tuple, n, total: rows and label sum of each tuple of bins. Rows with a gap are left out."""
    named = df.select(*features, model.alias("_model"), F.col(label).cast("double").alias("_y")).where(F.col("_model").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y"))
    rows = named.select(F.col("_model").alias("model"), F.col("_y").alias("y"), _tuple(features, edges).alias("tuple")).where("tuple is not null")
    return rows.groupBy("model", "tuple").agg(F.count("*").alias("n"), F.sum("y").alias("total"))


def fit_folded(bins: np.ndarray, n: np.ndarray, total: np.ndarray, params: Mapping[str, object]) -> tuple[float, list[np.ndarray]]:
    """The trees of one model over its tuples: base, then starts, feature, threshold, left and value."""
    rng = np.random.default_rng(params["seed"])
    rate, share = params["stepSize"], params["subsamplingRate"]
    many = bins.shape[1]
    tried = max(1, int(np.log2(many))) if params["featureSubsetStrategy"] == "log2" else many
    width = int(bins.max(initial=0)) + 1
    # Of 0/1 features only the ones are counted; the others get a whole histogram.
    flags = [f for f in range(many) if width > 2 and bins[:, f].max(initial=0) <= 1]
    full = [f for f in range(many) if f not in set(flags)]
    one_row, one_flag = np.nonzero(bins[:, flags])
    whole_key = bins[:, full].T.astype(np.int64) + width * np.arange(len(full))[:, None]  # a place for each feature and bin
    mean = total / n
    base = float(total.sum() / n.sum())
    now = np.full(len(n), base)
    starts, nodes, count = [], [], 0
    for _ in range(params["maxIter"]):
        weight = (n if share >= 1 else rng.binomial(n, share)).astype(np.float64)
        pull = weight * (mean - now)
        starts.append(count)
        rows, node, at_level = np.arange(len(n)), np.zeros(len(n), np.int64), 1
        ones, ones_flag = one_row, one_flag
        for depth in range(params["maxDepth"] + 1):
            size = np.bincount(node, weight[rows], at_level)
            sums = np.bincount(node, pull[rows], at_level)
            value = np.divide(sums, size, out=np.zeros(at_level), where=size > 0)
            feature, threshold = np.full(at_level, -1), np.zeros(at_level, np.int64)
            if depth < params["maxDepth"]:
                gain, cut = _best_cuts(many, whole_key, rows, node, weight, pull, size, sums, full, flags, ones, ones_flag, width, params["minInstancesPerNode"])
                order = rng.random(gain.shape)
                order[~(gain > 1e-12)] = 2
                chosen = np.argsort(order, 1)[:, :tried]
                best = np.take_along_axis(chosen, np.take_along_axis(gain, chosen, 1).argmax(1)[:, None], 1)[:, 0]
                split = (np.take_along_axis(gain, best[:, None], 1)[:, 0] > 1e-12) & (size >= params["minInstancesToSplit"])
                feature[split], threshold[split] = best[split], cut[np.arange(at_level), best][split]
            split = feature >= 0
            child = np.cumsum(split) - 1
            left = np.where(split, count + at_level + 2 * child, 0)
            nodes.append((feature, threshold, left, np.where(split, 0, rate * value)))
            count += at_level
            ended = ~split[node]
            now[rows[ended]] += rate * value[node[ended]]
            rows, node = rows[~ended], node[~ended]
            if not len(rows):
                break
            node = 2 * child[node] + (bins[rows, feature[node]] > threshold[node])
            at_level = 2 * int(split.sum())
            inside = np.full(len(n), -1)
            inside[rows] = node
            keep = inside[ones] >= 0
            ones, ones_flag = ones[keep], ones_flag[keep]
    columns = [np.concatenate(x) for x in zip(*nodes, strict=True)] if nodes else [np.zeros(0)] * 4
    kinds = (np.int16, np.int16, np.int32, np.float64)
    return base, [np.array(starts, np.int64), *(c.astype(k) for c, k in zip(columns, kinds, strict=True))]


def _best_cuts(many, whole_key, rows, node, weight, pull, size, sums, full, flags, ones, ones_flag, width, least):
    """For each node and feature the gain of its best cut (-1: none) and the bin it cuts behind."""
    nodes = len(size)
    gain, cut = np.full((nodes, many), -1.0), np.zeros((nodes, many), np.int64)
    w, p = weight[rows], pull[rows]

    def gains(left_size: np.ndarray, left_sum: np.ndarray) -> np.ndarray:
        of_node = (nodes,) + (1,) * (left_size.ndim - 1)
        right_size, right_sum = size.reshape(of_node) - left_size, sums.reshape(of_node) - left_sum
        fits = (left_size >= least) & (right_size >= least)
        whole = np.divide(sums**2, size, out=np.zeros(nodes), where=size > 0).reshape(of_node)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(fits, left_sum**2 / left_size + right_sum**2 / right_size - whole, -1.0)

    if full and width > 1:
        key = (node * (len(full) * width) + whole_key[:, rows]).ravel()
        shape = (nodes, len(full), width)
        left_size = np.bincount(key, np.tile(w, len(full)), nodes * len(full) * width).reshape(shape).cumsum(2)[:, :, :-1]
        left_sum = np.bincount(key, np.tile(p, len(full)), nodes * len(full) * width).reshape(shape).cumsum(2)[:, :, :-1]
        each = gains(left_size, left_sum)
        cut[:, full] = each.argmax(2)
        gain[:, full] = each.max(2)
    if flags:
        of = np.zeros(len(weight), np.int64)
        of[rows] = node
        key = of[ones] * len(flags) + ones_flag
        right_size = np.bincount(key, weight[ones], nodes * len(flags)).reshape(nodes, -1)
        right_sum = np.bincount(key, pull[ones], nodes * len(flags)).reshape(nodes, -1)
        gain[:, flags] = gains(size[:, None] - right_size, sums[:, None] - right_sum)
    return gain, cut


def fit(df: DataFrame, features: Sequence[str], label: str, params: Mapping[str, object], model: Column | None = None) -> dict[str, BoostedTrees]:
    """A model for each value of ``model`` (one for all rows by default), fitted side by side.

    A task holds one model's tuples, at most as many as the bins allow, and never rows. The fitted
    trees come to the driver: about 20 bytes a node, at most maxIter * 2 ** maxDepth * 2 nodes a model.
    """
    edges = bin_edges(df, features, params["maxBins"])
    folded = fold(df, features, edges, label, F.lit("all") if model is None else model)
    settings, many = dict(params), len(features)

    def grow(tuples: pd.DataFrame) -> pd.DataFrame:
        bins = _bins(tuples["tuple"], many)
        order = np.lexsort(bins.T[::-1])  # the same order whatever the partitions were
        base, arrays = fit_folded(bins[order], tuples["n"].to_numpy(np.int64)[order], tuples["total"].to_numpy(np.float64)[order], settings)
        return pd.DataFrame([(tuples["model"].iloc[0], base, *(a.tobytes() for a in arrays))], columns=[c.split()[0] for c in _MODEL.split(", ")])

    if model is not None:
        folded = folded.repartition(MODEL_TASKS, "model")
    fitted = materialise(folded.groupBy("model").applyInPandas(grow, _MODEL), "models")
    found = {r["model"]: _trees(tuple(features), edges, r) for r in fitted.collect()}
    if not found and model is None:
        raise ValueError("no row has all features and the label")
    return found


def _trees(features: tuple[str, ...], edges: tuple[tuple[float, ...], ...], row) -> BoostedTrees:
    kinds = {"starts": np.int64, "feature": np.int16, "threshold": np.int16, "left": np.int32, "value": np.float64}
    return BoostedTrees(features, edges, row["base"], **{c: np.frombuffer(row[c], k) for c, k in kinds.items()})


def save(spark: SparkSession, trees: BoostedTrees, path: str) -> None:
    """One row: features, bin edges and trees."""
    arrays = [getattr(trees, c).tobytes() for c in ("starts", "feature", "threshold", "left", "value")]
    row = ("all", trees.base, *(bytearray(a) for a in arrays), list(trees.features), [list(e) for e in trees.edges])
    spark.createDataFrame([row], f"{_MODEL}, features array<string>, edges array<array<double>>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> BoostedTrees:
    row = spark.read.parquet(path).first()
    return _trees(tuple(row["features"]), tuple(tuple(e) for e in row["edges"]), row)


def score(df: DataFrame, models: Mapping[str, BoostedTrees], into: str, model: Column | None = None) -> DataFrame:
    """The rows with ``into``: the prediction of the model that ``model`` names (the only one by default).

    Each distinct tuple of bins is predicted once. Rows with a gap, or without a model, have NULL. All
    models have the same features and bins.
    """
    kept = [c for c in df.columns if c != into]
    if not models:
        return df.select(*kept, F.lit(None).cast("double").alias(into))
    any_ = next(iter(models.values()))
    many = len(any_.features)
    keyed = df.select(*df.columns, (F.lit(next(iter(models))) if model is None else model).alias("_model"))
    keyed = keyed.select(*kept, "_model", _tuple(any_.features, any_.edges).alias("_tuple"))
    shared = df.sparkSession.sparkContext.broadcast(dict(models))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.full(len(batch), np.nan)
            bins = _bins(batch["_tuple"], many)
            for name, at in batch.groupby("_model").indices.items():
                out[at] = shared.value[name].predict(bins[at])
            yield batch.assign(**{into: out})

    tuples = keyed.select("_model", "_tuple").where(F.col("_tuple").isNotNull() & F.col("_model").isin(*models)).distinct()
    scores = tuples.mapInPandas(predict, f"_model string, _tuple binary, `{into}` double")
    return attach(keyed, scores, ["_model", "_tuple"]).select(*kept, into)
