"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from barriometrics.llm import spelling_groups


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if w}


def brute(counts, least=5, times=3):
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    rows, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        rows[w] = (n, len(near))
    out = set()
    for w, (n, near) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near, words[form[w]] if form[w] else None))
    return out


def vocabulary(seed, size, alphabet="abcdé÷ÿ"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(size)}
    for w in list(words)[: size // 2]:
        for _ in range(3):
            k = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]]))
    words.discard("")
    return {w: rng.choice([1, 2, 3, 4, 7, 7, 20, 50, 400]) for w in sorted(words)}


def test_variants_match_brute_force_also_in_parts(spark):
    words = vocabulary(4, 500)
    frame = spark.createDataFrame([*words.items(), (None, 9)], "word string, n long").repartition(3)
    for least, part in ((5, 100_000), (1, 100_000), (3, 7)):
        got = spelling_groups.variants(frame, least, 3, part_words=part).select("word", "form", "root", "n", "n_near", "form_n")
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(words, least)


def test_sorted_list_finds_every_near_word_of_any_alphabet():
    words = sorted({*vocabulary(9, 250, "ab"), *vocabulary(2, 150, "a日😀z"), "x" * 300, "x" * 299, "x" * 298})
    characters, length = spelling_groups.code_points(words)
    begins, k = np.arange(len(words)) == 0, np.full(len(words), len(words))
    q, e = spelling_groups.SortedLists(characters, length, begins).near(characters, length, 0 * k, k)
    got = list(zip(q.tolist(), e.tolist(), strict=True))
    expected = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == expected


def test_report_matches_brute_force_over_awkward_texts(spark):
    rng = random.Random(11)
    pool = [w for w in vocabulary(6, 160) if len(w) > 3]
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, k=rng.randint(0, 120))) for _ in range(150)]
    texts[0] = "Größe×é÷ a1b2_cc ÀÉ straße日本naïve " * 9
    rows = list(enumerate(texts)) + [(7, texts[7]), (7, texts[7]), (None, texts[3]), (None, None), (900, ""), (901, " \t"), (902, "lengthy" * 3_000), (903, "often here " * 9_000)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    counts = {r["word"]: r["n"] for r in spelling_groups.word_counts(frame).collect()}
    assert counts == brute_counts(rows)
    got = [tuple(r) for r in spelling_groups.report(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(brute_counts(rows))


def test_many_hits_in_one_text_and_full_counters(spark, monkeypatch):
    monkeypatch.setattr(spelling_groups, "HELD_WORDS", 50)
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(3_000))) for i in range(3)]
    got = spelling_groups.word_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {r["word"]: r["n"] for r in got.collect()} == brute_counts(rows)


def test_long_chains_reach_their_root(spark):
    chain = [("word" + "x" * k, 3 * 2**k) for k in range(1, 20)]
    got = {r["word"]: r["root"] for r in spelling_groups.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"word" + "x" * 19}


def test_empty_table(spark):
    assert spelling_groups.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
