"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms, and of those it repeats, hashed to ``BUCKETS``. The score is the logistic function of a bias, a
weight for each present term and the inner products of the factors of each pair of present terms, so that
pairs count beyond the sum of their weights. The machine is fitted on at most ``CLASS_ROWS`` labelled rows
of either class (those with the smallest hash of the id), with each class weighted to its share of all
labelled rows. Terms have weights where the residuals of the machine so far stand out for them, or for a pair
that they are in, by more than noise over all buckets would; however many there are. Scoring is one pass over
the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barriometrics.llm import arrow_text

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
CLASS_ROWS = 6_000
FACTORS = 4
PASSES = 60
ROUNDS = 12
#: Standard deviations that noise over all buckets, and over all pairs of frequent terms, reaches but rarely.
STANDS_OUT = float(np.sqrt(2 * np.log(BUCKETS)))
PAIR_STANDS_OUT = 6.5
THRESHOLD = 0.7
_SEED = 7


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from; a row without id isn't held out, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (row, bucket) pairs of a piece, sorted, and its rows. A term that a text repeats has a second bucket."""
    found = arrow_text.words(column, arrow_text.ALNUM)
    bucket = (found.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    pairs, count = np.unique(found.row.astype(np.int64) << BUCKET_BITS | bucket, return_counts=True)
    again = pairs[count > 1]
    again = again ^ (again & (BUCKETS - 1)) | (again * 0x9E3B5 + 1) & (BUCKETS - 1)
    pairs = np.unique(np.concatenate((pairs, again)))
    return pairs >> BUCKET_BITS, pairs & (BUCKETS - 1), found.rows


@dataclass
class Machine:
    """``place`` maps a bucket to its row in ``weights`` and ``factors``, -1 for none."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        row, bucket, rows = _terms(column)
        term = self.place[bucket]
        return 1.0 / (1.0 + np.exp(-self.totals(row[term >= 0], term[term >= 0], rows)))

    def totals(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of each row, given its terms as (row, term) pairs."""
        total = self.bias + np.bincount(row, self.weights[term], rows)
        for k in range(self.factors.shape[1]):
            f = self.factors[term, k]
            total += 0.5 * (np.bincount(row, f, rows) ** 2 - np.bincount(row, f * f, rows))
        return np.clip(total, -60, 60)


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, factors: int = FACTORS, passes: int = PASSES) -> Machine:
    """Fit on rows of buckets with 0/1 labels; ``share`` is that of label 1 among all labelled rows.

    Terms enter in rounds, so that a term which only keeps company with telling ones stays out: in each round
    those that what is left unexplained stands out for at least half as much as for the strongest, in the last
    round all that stand out, then the terms of pairs that toxic rows left unexplained have in common.
    """
    place = np.full(BUCKETS, -1, np.int32)
    share = min(0.999, max(0.001, share))
    start = float(np.log(share / (1 - share)))
    ones = int(labels.sum())
    if not ones or ones == len(labels):
        return Machine(place, start, np.zeros(0), np.zeros((0, factors)))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    rate = ones / len(labels)
    weight = np.where(labels == 1, share / rate, (1 - share) / (1 - rate)).astype(np.float32)
    machine = Machine(place, start, np.zeros(0), np.zeros((0, factors)))
    chosen = np.zeros(0, np.int64)
    p = np.full(len(rows), rate)
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            z = np.bincount(flat, (labels - p)[owner], BUCKETS) / np.sqrt(np.bincount(flat, (p * (1 - p))[owner], BUCKETS) + 1.0)
            z[chosen] = 0
            top = np.abs(z).max()
            best = np.flatnonzero(np.abs(z) >= max(STANDS_OUT, 0.5 * top if turn < ROUNDS - 1 else 0.0))
            if not len(best):
                continue  # nothing changes before the pairs
        else:
            best = np.setdiff1d(_pair_terms(rows, labels, p), chosen)
            if not len(best):
                break
        place[best] = len(chosen) + np.arange(len(best))
        chosen = np.concatenate((chosen, best))
        term = place[flat]
        known = term >= 0
        lists = np.split(term[known], np.cumsum(np.bincount(owner[known], minlength=len(rows)))[:-1])
        bias, w, v = _descend(lists, labels.astype(np.float32), weight, start, factors, passes)
        machine = Machine(place, float(bias), w.astype(np.float64), v.astype(np.float64))
        odds = np.exp(machine.totals(owner[known], term[known], len(rows))) * (rate / (1 - rate)) / (share / (1 - share))
        p = odds / (1 + odds)  # as the sample's classes are mixed
    return machine


def _pair_terms(rows: list[np.ndarray], labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Buckets of pairs that the residuals stand out for, the pairs found in toxic rows that ``p`` leaves unexplained.

    A pair that stands out by ``PAIR_STANDS_OUT`` deviations is in at least so many of those rows, so only
    buckets that are in as many of them can be in one. Each such bucket is held against the rest at once.
    """
    left = np.flatnonzero((labels == 1) & (p < 0.5))
    least = int(np.ceil(PAIR_STANDS_OUT))
    if len(left) < least:
        return np.zeros(0, np.int64)
    often = np.flatnonzero(np.bincount(np.concatenate([rows[i] for i in left]), minlength=BUCKETS) >= least)
    code = np.full(BUCKETS, -1, np.int32)
    code[often] = np.arange(len(often))
    own = [k[k >= 0] for k in (code[r] for r in rows)]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(k) for k in own])
    flat = np.concatenate(own)
    order = np.argsort(flat, kind="stable")
    holders = np.split(owner[order], np.cumsum(np.bincount(flat, minlength=len(often)))[:-1])
    unexplained = np.zeros(len(rows), bool)
    unexplained[left] = True
    residual, spread = labels - p, p * (1 - p)
    found = np.zeros(len(often), bool)
    for a, mine in enumerate(holders):
        some = [own[i] for i in mine[unexplained[mine]]]
        other = np.bincount(np.concatenate(some), minlength=len(often)) >= least
        other[: a + 1] = False
        if not other.any():
            continue
        lists = [own[i] for i in mine]
        sizes, terms = [len(k) for k in lists], np.concatenate(lists)
        z = np.bincount(terms, np.repeat(residual[mine], sizes), len(often)) / np.sqrt(np.bincount(terms, np.repeat(spread[mine], sizes), len(often)) + 1.0)
        other &= z >= PAIR_STANDS_OUT
        found |= other
        found[a] |= other.any()
    return often[found]


def _descend(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, start: float, factors: int, passes: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam over shuffled batches of rows of terms, with a little decay; the same for the same rows."""
    rng = np.random.default_rng(_SEED)
    terms = 1 + max((int(r.max()) for r in rows if len(r)), default=-1)
    values = [np.array([start], np.float32), np.zeros(terms, np.float32), (0.01 * rng.standard_normal((terms, factors))).astype(np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in values]
    step, batch = 0, 256
    decay = 0.2 / max(200, len(rows))
    total_steps = max(1500, passes * len(rows) // batch)
    while step < total_steps:
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            xb, (bias, w, v) = np.zeros((len(part), terms), np.float32), values
            lists = [rows[i] for i in part]
            xb[np.repeat(np.arange(len(part)), [len(r) for r in lists]), np.concatenate(lists)] = 1.0
            s = xb @ v
            total = bias[0] + xb @ w + 0.5 * ((s * s).sum(1) - xb @ (v * v).sum(1))
            error = weight[part] * (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[part]) / len(part)
            slopes = [np.array([error.sum()]), xb.T @ error + decay * w, xb.T @ (error[:, None] * s) - (xb.T @ error)[:, None] * v + 10 * decay * v]
            step += 1
            rate = 0.05 * max(0.02, 1 - step / total_steps)
            for value, slope, (first, second) in zip(values, slopes, moments, strict=True):
                first += 0.1 * (slope - first)
                second += 0.001 * (slope * slope - second)
                value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return float(values[0][0]), values[1], values[2]


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", class_rows: int = CLASS_ROWS) -> Machine:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    An id labelled twice has its larger label; NULL labels and ids are left out. Rows that repeat one set
    of terms count once, with the label of most of them. Without labels every score is 0.5; with one
    class, scores are that class's smoothed share.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(sizes.values())
    if not total:
        return Machine(np.full(BUCKETS, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    near = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(class_rows) for y in (0, 1)]
    chosen = F.broadcast(near[0].unionByName(near[1]))  # at most 2 * class_rows rows of two numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrow_text.pieces(batch, "text"):
                row, bucket, rows = _terms(piece.column("text"))
                offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("y"), pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32)))], ["y", "terms"])

    texts = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = texts.join(chosen, "id").select("y", "text").mapInArrow(extract, "y int, terms array<int>").toArrow().combine_chunks()
    votes: dict[bytes, list[int]] = {}
    kept: dict[bytes, np.ndarray] = {}
    for y, terms in zip(found.column("y").to_pylist(), found.column("terms"), strict=True):
        values = terms.values.to_numpy(zero_copy_only=False)
        kept[key] = values if (key := values.tobytes()) not in kept else kept[key]
        votes.setdefault(key, []).append(y)
    keys = sorted(kept)
    y = np.array([int(2 * sum(votes[k]) > len(votes[k])) for k in keys], np.int64)
    return fit([kept[k] for k in keys], y, sizes.get(1, 0) / total)


def score(documents: DataFrame, machine: Machine, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every given row as ``row`` (a struct of the ``carry`` columns, all by default) with its ``score``.

    NULL and empty texts have the score of no terms. The text is the only input.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    if carry:
        out = documents.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    else:
        out = documents.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrow_text.pieces(arrow_text.with_text(batch, text), "text"):
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(shared.value.scores(piece.column("text")))], ["row", "score"])

    return out.mapInArrow(run, T.StructType([out.schema["row"], T.StructField("score", T.DoubleType())]))


def report(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per given row."""
    scored = score(documents, train(documents, labels, doc_id), carry=[doc_id])
    key = F.col("row")[doc_id]
    return scored.select(key.alias(doc_id), held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that score below the threshold, with the columns they came with; batches are filtered as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, text=text))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrow_text.pieces(batch, text):
                yield piece.filter(pa.array(shared.value.scores(piece.column(text)) < threshold))

    return documents.mapInArrow(choose, documents.schema)
