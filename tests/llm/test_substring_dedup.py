"""Substring removal against brute force: shared passages, copies, hot stretches, awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barriometrics.llm import substring_dedup

SCHEMA = "doc_id long, text string, found string, row int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """doc_id, n_words, n_removed, digest of the words that stay, for every row."""
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, documents=150):
    """Texts of few words, full of chance repeats, with long shared passages and edited copies."""
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(rng.randint(5, 80))) for _ in range(6)]
    rows = []
    for i in range(documents):
        parts = [" ".join(rng.choice("xyzé") + str(rng.randint(0, 8)) for _ in range(rng.randint(0, 60)))]
        parts += rng.sample(common, rng.randint(0, 3))
        rng.shuffle(parts)
        body = "\t \n".join(parts).split()
        for _ in range(rng.randint(0, 3)):
            if body:
                body[rng.randrange(len(body))] = "edit"
        rows.append((rng.randint(0, documents), " ".join(body)))
    return rows


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("window", [13, 5, 2])
def test_removal_matches_brute_force(spark, window):
    rows = passages(window)
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, rows[5][1] + " " + rows[4][1]), (None, "only here " * 20), (None, "only here " * 20)]
    rows += [(7001, None), (7002, ""), (7003, " \t\n"), (7004, "one two"), (7005, "again " * 5_000), (7006, "again " * 40), (7007, "x" * 100_000)]
    frame = spark.createDataFrame([(i, t, "clash", k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5)
    assert collected(substring_dedup.report(frame, window=window)) == brute(rows, window)


def test_hot_stretches_are_split_and_stay_exact(spark):
    rng = random.Random(5)
    passage = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(200):
        copy = list(passage)
        copy[rng.randrange(40)] = f"edit{rng.randint(0, 40)}"
        rows.append((199 - i, " ".join(copy)))
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA).repartition(7)
    found = substring_dedup.remove_repeats(frame, hot_words=40, run_words=30)
    got = found.select(
        "row.doc_id", "found.n_words", substring_dedup.removed_words(F.col("found.spans")), F.sha2(F.col("row.text").cast("binary"), 256)
    )
    assert collected(got) == brute(rows, 13)


def test_pieces_do_not_change_the_result(spark, monkeypatch):
    rows = passages(8)
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    whole = collected(substring_dedup.report(frame.coalesce(1)))
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 500)
    assert whole == collected(substring_dedup.report(frame.repartition(11))) == brute(rows, 13)


def test_rows_come_back_with_their_columns_and_spans(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(1, passage, "f", 1), (2, "before  here\n" + passage + " after", "g", 2), (3, None, None, None)]
    got = {r["row"]["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["row"].asDict() == {"doc_id": 2, "text": "before here after", "found": "g", "row": 2}
    assert got[2]["found"].asDict() == {"n_words": 23, "spans": [2, 22]}
    assert got[1]["row"]["text"] == passage and got[1]["found"]["spans"] == []
    assert got[3]["row"].asDict() == {"doc_id": 3, "text": "", "found": None, "row": None}


def test_empty_table_and_a_short_one_give_their_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.report(nothing).count() == 0
    short = spark.createDataFrame([(1, "few words", "", 0)], SCHEMA)
    assert collected(substring_dedup.report(short)) == brute([(1, "few words")], 13)


def test_automaton_gives_matching_statistics_of_random_stretches():
    rng = random.Random(1)
    for _ in range(60):
        automaton, added = substring_dedup.Automaton(), []
        for document in range(12):
            stretch = [rng.randint(0, 2) for _ in range(rng.randint(1, 14))]
            for window in (2, 3, 5):
                expected = []
                for k in range(len(stretch) - window + 1):
                    have = [d for d, s in added if any(s[j : j + window] == stretch[k : k + window] for j in range(len(s)))]
                    expected.append(min(have, default=-1))
                assert automaton.stream(stretch, window) == expected
            automaton.add(stretch, document)
            added.append((document, stretch))
