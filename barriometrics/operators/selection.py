"""Sampling, feature studies and model comparison."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import PredictionModel
from pyspark.ml.feature import UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from barriometrics.operators.boosting import MAX_BINS, bin_edges
from barriometrics.session import materialise

#: Folded tuples a task holds before it adds them up.
FOLDED_ROWS = 65_536


def sample_n(df: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows in digest order, a repeatable sample; raises where the table is smaller."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in df.columns]))
    sample = df.orderBy(digest, *df.columns).limit(n)
    if df.limit(n).count() < n:
        raise ValueError("sample size cannot be larger than the table")
    return sample


def _assembled(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    keep = [label] if label else []
    return assembler.transform(df).select("features", *keep)


def feature_importance(df: DataFrame, features: Sequence[str], label: str = "price", seed: int = 42, **params) -> DataFrame:
    """Random-forest importances, most important first. The result has one row per feature."""
    forest = RandomForestRegressor(labelCol=label, seed=seed, **params).fit(_assembled(df, features, label))
    scores = [(f, float(s)) for f, s in zip(features, forest.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(scores, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def covariances(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Population covariances of all pairs of columns over the rows without a gap, in one aggregate."""
    number = {c: F.col(c).cast("double") for c in columns}
    whole = reduce(and_, [c.isNotNull() & ~F.isnan(c) for c in number.values()])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    row = df.where(whole).agg(*[F.covar_pop(number[columns[i]], number[columns[j]]).alias(f"{i}_{j}") for i, j in pairs]).first()
    if row[0] is None:
        raise ValueError("no row has all columns")
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"{i}_{j}"]
    return out


def pca_explained(df: DataFrame, features: Sequence[str], wanted: float = 0.9) -> DataFrame:
    """Per principal component of the standardised features: explained share, running share, whether it is needed for ``wanted``, loadings.

    All comes from the features' covariances. A constant feature has no share; a component's largest loading is positive.
    """
    matrix = covariances(df, features)
    spread = np.sqrt(np.diag(matrix))
    scale = np.where(spread > 0, spread, 1.0)
    values, vectors = np.linalg.eigh(matrix / np.outer(scale, scale))
    shares = np.clip(values[::-1], 0, None) / max(values.sum(), 1e-300)
    loadings = vectors[:, ::-1]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(len(features))])
    rows, total = [], 0.0
    for i, share in enumerate(shares):
        needed = total < wanted
        total += float(share)
        rows.append((i + 1, float(share), total, bool(needed), {f: float(loadings[j][i]) for j, f in enumerate(features)}))
    schema = "component int, explained double, cumulative double, needed boolean, loadings map<string,double>"
    return df.sparkSession.createDataFrame(rows, schema)


def corr_with(df: DataFrame, columns: Sequence[str], target: str = "price") -> DataFrame:
    """Pearson correlation of every column with the target, highest first, in one aggregate."""
    values = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])
    return values.select(F.inline(rows)).orderBy(F.desc("correlation"), "feature")


def low_variance_filter(df: DataFrame, features: Sequence[str], threshold: float = 0.3) -> list[str]:
    """Features whose sample variance exceeds the threshold."""
    selector = VarianceThresholdSelector(featuresCol="features", outputCol="kept", varianceThreshold=threshold)
    model = selector.fit(_assembled(df, features))
    return [features[i] for i in model.selectedFeatures]


def select_features(df: DataFrame, features: Sequence[str], label: str = "price", share: float = 0.2) -> list[str]:
    """The most informative ``share`` of the features by the F-test against the label (at least one)."""
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="kept", selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("continuous")
    selector.setSelectionThreshold(max(1, int(len(features) * share)))
    return [features[i] for i in sorted(selector.fit(_assembled(df, features, label)).selectedFeatures)]


def drop_collinear(df: DataFrame, features: Sequence[str], label: str = "price", threshold: float = 0.3) -> list[str]:
    """Of each pair correlated beyond the threshold, the one less correlated with the label goes."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    row = df.agg(
        *[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs], *[F.corr(f, label).alias(f) for f in features]
    ).first().asDict()
    kept = list(features)
    for a, b in pairs:
        if a in kept and b in kept and abs(row[f"{a}~{b}"] or 0) > threshold:
            kept.remove(a if abs(row[a] or 0) < abs(row[b] or 0) else b)
    return kept


def rfe(df: DataFrame, features: Sequence[str], label: str = "price", keep: int = 3) -> list[str]:
    """Recursive elimination: fit a linear model, drop the smallest coefficient, until ``keep`` stay.

    Every fit is solved from the same covariances, taken in one pass. Where features determine each other the
    solution of least norm counts; of equal coefficients the last goes.
    """
    matrix = covariances(df, [*features, label])
    left = list(range(len(features)))
    while len(left) > keep:
        weights = np.abs(np.linalg.pinv(matrix[np.ix_(left, left)], rcond=1e-10, hermitian=True) @ matrix[left, -1])
        least = np.flatnonzero(weights <= weights.min() * (1 + 1e-6) + 1e-12)
        left.pop(int(least[-1]))
    return [features[i] for i in left]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with equal keys as one row that has the sums of their values."""
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[starts], np.add.reduceat(values[order], starts)


def fold_bootstrapped(
    rows: DataFrame, features: Sequence[str], label: str, edges: Sequence[Sequence[float]], centre: float, trees: int, seed: int
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The rows added up in one pass: by part and tuple of bins, and each part's products of 1, the features and the label.

    A tuple has ``n`` rows, the sums of their labels less ``centre`` (``total``) and of the squares, its bins as ``features``, and for
    each tree of a forest how often its bootstrap drew the tuple's rows (``n_0`` on) and the sum of the labels drawn (``total_0`` on).
    Each row is drawn on its own, a Poisson number of times for each tree. A task adds up as it reads and holds at most some
    ``FOLDED_ROWS`` tuples; their number is bounded by the bins, not by the rows. In the products, features are less their middle edge.
    """
    cuts = [np.array(e, np.float64) for e in edges]
    middles = np.array([e[len(e) // 2] if len(e) else 0.0 for e in cuts])
    bins = [f"bin_{i}" for i in range(len(features))]
    sums = ["n", "total", "squares", *(f"n_{t}" for t in range(trees)), *(f"total_{t}" for t in range(trees))]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        products: dict[int, np.ndarray] = {}
        merged = lambda: _summed(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        frame = lambda keys, values: pd.concat([pd.DataFrame(keys, columns=["part", *bins]), pd.DataFrame(values, columns=sums)], axis=1).assign(products=None)
        for batch in batches:
            if batch.empty:
                continue
            y = batch["_y"].to_numpy(np.float64)[:, None] - centre
            values, part = batch[bins].to_numpy(np.float64), batch["part"].to_numpy()
            found = [np.searchsorted(e, values[:, i]) for i, e in enumerate(cuts)]
            drawn = rng.poisson(1.0, (len(batch), trees)).astype(np.float64)
            kept.append(_summed(np.stack([part, *found], 1).astype(np.int32), np.concatenate([np.ones_like(y), y, y * y, drawn, drawn * y], 1)))
            lines = np.concatenate([np.ones_like(y), values - middles, y], 1)
            for p in np.unique(part):
                products[p] = products.get(p, 0.0) + lines[part == p].T @ lines[part == p]
            if sum(len(k) for k, _ in kept) > FOLDED_ROWS:
                kept = [merged()]
                if len(kept[0][0]) > FOLDED_ROWS // 2:
                    yield frame(*kept.pop())
        if kept:
            yield frame(*merged())
        if products:
            yield pd.DataFrame({"part": list(products), "products": [m.ravel().tolist() for m in products.values()]})

    read = rows.select("part", *[F.col(f).alias(b) for f, b in zip(features, bins, strict=True)], F.col(label).cast("double").alias("_y"))
    whole = ["part", *bins, *sums, "products"]
    schema = ", ".join(["part int", *(f"{b} int" for b in bins), *(f"{c} double" for c in sums), "products array<double>"])
    added = materialise(read.mapInPandas(lambda batches: (b.reindex(columns=whole) for b in add_up(batches)), schema), "added")
    folded = added.where("products is null").groupBy("part", *bins).agg(*[F.sum(c).alias(c) for c in sums])
    tuples = materialise(VectorAssembler(inputCols=bins, outputCol="features").transform(folded).drop(*bins), "folded")
    wide = len(features) + 2
    totals: dict[int, np.ndarray] = {}
    for row in added.where("products is not null").select("part", F.posexplode("products")).groupBy("part", "pos").agg(F.sum("col").alias("s")).collect():
        totals.setdefault(row["part"], np.zeros((wide, wide)))[divmod(row["pos"], wide)] = row["s"]
    return tuples, totals


def _linear_error(products: Mapping[int, np.ndarray], held: int) -> float:
    """The error on one part of least squares over the others, from the parts' products of 1, the features and the label."""
    train = sum(m for part, m in products.items() if part != held)
    mean = train[0, 1:] / train[0, 0]
    matrix = train[1:, 1:] / train[0, 0] - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(matrix)[:-1], 0, None))
    scale = np.where(spread > 0, spread, 1.0)
    weights = np.linalg.pinv(matrix[:-1, :-1] / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (matrix[:-1, -1] / scale) / scale
    miss = np.array([mean[:-1] @ weights - mean[-1], *-weights, 1.0])  # times 1, the features and the label
    return float(np.sqrt(max(0.0, miss @ products[held] @ miss) / products[held][0, 0]))


def _held_out_error(held: DataFrame, models: Sequence[PredictionModel]) -> float:
    """Root mean square error over all rows of folded tuples, of the models' mean prediction."""
    scored = held
    for i, model in enumerate(models):
        scored = model.setPredictionCol(f"p_{i}").transform(scored)
    guess = reduce(add, [F.col(f"p_{i}") for i in range(len(models))]) / len(models)
    missed = F.col("squares") - 2 * guess * F.col("total") + F.col("n") * guess * guess
    return float(scored.agg(F.sqrt(F.sum(missed) / F.sum("n"))).first()[0])


def compare_models(
    df: DataFrame, features: Sequence[str], label: str = "price", folds: int = 3, seed: int = 42, trees: int = 20
) -> DataFrame:
    """Cross-validated error of several regressors, best first; ``best`` marks the winner.

    The rows are read a fixed number of times, whatever the learners do. Least squares comes from each part's products. Trees
    see a feature only by its bin, so rows that share all bins are one row with a weight, bootstraps drawn row by row before.
    """
    stored = materialise(_assembled(df, features, label))
    columns = [f"x_{i}" for i in range(len(features))]
    read = stored.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.rand(seed).alias("r"))
    part = sum(((F.col("r") >= F.lit(k * (1.0 / folds))).cast("int") for k in range(1, folds)), F.lit(0)).alias("part")
    rows = read.select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns)], "y", part)
    labels = stored.select(F.col(label).cast("double").alias("y")).agg(F.avg("y").alias("mean"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("gaps")).first()
    if labels["gaps"]:
        raise ValueError(f"a row has no {label}")
    folded, products = fold_bootstrapped(rows, columns, "y", bin_edges(rows, columns), labels["mean"] or 0.0, trees, seed)
    if len(products) < folds:
        raise ValueError("each part needs rows")

    def learnt(learner, fold: int, of: str = "") -> PredictionModel:
        weight, total = F.col(f"n{of}"), F.col(f"total{of}")
        train = folded.where((F.col("part") != fold) & (weight > 0))
        return learner.fit(train.select("features", (total / weight).alias("y"), weight.alias("w")))

    common = {"labelCol": "y", "weightCol": "w", "maxBins": MAX_BINS}
    grown = {
        "decision_tree": lambda fold: [learnt(DecisionTreeRegressor(seed=seed, **common), fold)],
        "random_forest": lambda fold: [
            # A third of the features at each node, as forests have it, which a forest of one tree would not.
            learnt(RandomForestRegressor(seed=seed + t, numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", **common), fold, f"_{t}")
            for t in range(trees)
        ],
        "gradient_boosting": lambda fold: [learnt(GBTRegressor(seed=seed, maxIter=trees, **common), fold)],
    }
    tasks = [(name, fold) for name in grown for fold in range(folds)]
    with ThreadPool(len(tasks)) as pool:
        errors = pool.map(inheritable_thread_target(df.sparkSession)(lambda t: _held_out_error(folded.where(F.col("part") == t[1]), grown[t[0]](t[1]))), tasks, 1)
    scores = [("linear", float(np.mean([_linear_error(products, fold) for fold in range(folds)])))]
    scores += [(name, float(np.mean([e for (n, _), e in zip(tasks, errors, strict=True) if n == name]))) for name in grown]
    scores.sort(key=lambda s: s[1])
    ranked = [(i + 1, name, rmse, i == 0) for i, (name, rmse) in enumerate(scores)]
    return df.sparkSession.createDataFrame(ranked, "rank int, model string, rmse double, best boolean")
