"""Filtering stages hand rows on as they came: clashing columns, NULLs, repeats, long texts, empty tables."""

import random

import pytest

from barriometrics.llm import decontaminate, toxicity

SCHEMA = "doc_id long, text string, row string, found int, score double, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        body = rng.choices(words, k=rng.randint(0, 60))
        if i % 4 == 0:
            body.insert(rng.randint(0, len(body)), "vileword")
        if i % 7 == 0:
            body += [f"test{k}" for k in range(12)]
        rows.append((i, " ".join(body), "r", i, 0.5, "s"))
    rows += [(None, None, None, None, None, None), (5, "", "r", 1, 0.1, ""), (6, "vileword " * 30_000, "r", 1, 0.1, ""), rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_clean_rows_stay_whole(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.schema == docs.schema
    machine = toxicity.train(docs, labels)
    expected = toxicity.score(docs, machine).where(f"score < {toxicity.THRESHOLD}").select("row.*")
    assert sorted(map(str, kept.collect())) == sorted(map(str, expected.collect()))
    assert 250 < kept.count() < 320 and kept.where("doc_id is null").count() == 1
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_rows_without_test_windows_stay_whole(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "TEST_BLOCK_BYTES", block)
    items = [(k, " ".join(f"test{j}" for j in range(k, k + 11))) for k in range(2)] + [(9, "vileword vileword vileword"), (10, None), (11, "w1 absent")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.schema == docs.schema
    expected = decontaminate.matches(docs, benchmark).where("size(found.spans) = 0").select("row.*")
    assert sorted(map(str, kept.collect())) == sorted(map(str, expected.collect()))
    assert kept.count() == 405 - 58 - 1 and decontaminate.remove_contaminated(docs, benchmark.limit(0)).count() == 405
