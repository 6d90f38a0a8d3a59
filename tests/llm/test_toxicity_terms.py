"""The factorization machine learns rare terms beside a common one, and pairs that are toxic only together."""

import numpy as np
import pyarrow as pa

from barriometrics.llm import toxicity


def buckets(texts):
    row, bucket, rows = toxicity._terms(pa.array(texts))
    return np.split(bucket, np.searchsorted(row, np.arange(1, rows)))


def caught(make, seed=1, rows=4000):
    """The share of each kind of fresh rows that score at least 0.7, after a fit on other rows."""
    rng = np.random.default_rng(seed)

    def some(n):
        made = [make(rng) for _ in range(n)]
        texts = [" ".join([*(f"w{k}" for k in rng.zipf(1.3, 60) % 3000), *words]) for words, _ in made]
        return texts, np.array([kind for _, kind in made])

    texts, kind = some(rows)
    labels = np.isin(kind, (1, 2)).astype(np.int64)
    machine = toxicity.fit(buckets(texts), labels, labels.mean())
    texts, kind = some(2000)
    scores = machine.scores(pa.array(texts))
    return {int(k): float((scores[kind == k] >= toxicity.THRESHOLD).mean()) for k in np.unique(kind)}


def test_rare_terms_count_beside_a_common_one():
    def make(rng):
        if rng.random() > 0.3:
            return [], 0
        return (["common"], 1) if rng.random() < 0.5 else ([f"rare{rng.integers(30)}"], 2)

    share = caught(make)
    assert share[1] > 0.98 and share[2] > 0.95 and share[0] < 0.005


def test_pairs_count_where_neither_term_does():
    def make(rng):
        words = [w for w, p in (("insult", 0.05), ("group", 0.05)) if rng.random() < p]
        if rng.random() < 0.05:
            words = ["insult", "group"]
        if rng.random() < 0.3:
            return [*words, "common"], 1
        return words, 2 if len(words) == 2 else 3 if words else 0

    share = caught(make)
    assert share[1] > 0.98 and share[2] > 0.95 and share[3] < 0.05 and share[0] < 0.005


def test_long_texts_and_clashing_columns(spark):
    rows = [(i, ("vile " if i % 3 == 0 else "kind ") + f"w{i}", "r", 0.5) for i in range(300)]
    rows += [(900, "kind " * 200_000 + "vile", "r", None), (901, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.report(docs, labels).collect()}
    assert len(got) == 302 and all(got[i] == int(i % 3 == 0) for i in range(300)) and got[901] == 0
    assert toxicity.report(docs.limit(0), labels).count() == 0
