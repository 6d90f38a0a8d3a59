"""The pipeline operators against brute force, exact round trips and held-out labels, with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barriometrics.llm import (
    decontaminate, encoders, graph, host_reputation, html_extract, lattice_lm, sentencepiece_backend, simhash, token_counts, token_files, topk_search, toxicity,
)
from barriometrics.llm.model_file import ModelFile

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BODY = " ".join(f"word{i % 37} of the{i % 11} Story{i % 5}," for i in range(60))
TEXTS = [
    (1, BODY), (2, BODY), (3, BODY + " end"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (7, "one"), (None, "no id here, <|endoftext|> I'LL"),
    (8, "Ünïcode straße ÉTÉ 日本語 😀 é " * 4), (9, "long " * 20_000), (10, "x" * 30_000), (11, BODY.upper()),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, f"a{k}", k) for k, (i, t) in enumerate(TEXTS)]
    names = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_words int"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 40)]) for i in range(300)] + [(i, [0.1] * 40) for i in range(300, 700)]
    rows += [(900, None), (1000, [0.1] * 39 + [None]), (1100, [float("nan")] * 40), (1200, [1.0]), (200, rows[200][1]), (None, [0.1] * 40)]
    got = topk_search.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and len(v) == 40 and all(x is not None and np.isfinite(x) for x in v)]
    expected = set()
    for q, v in {i: v for i, v in good if i % 100 == 0}.items():
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    assert {tuple(r) for r in got if r["query_id"] != 1200} == expected
    assert topk_search.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_huge_values_is_ordered_exactly(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 2.0])]
    got = topk_search.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1)]


def test_lattice_marginal_sums_all_segmentations():
    pieces = lattice_lm.Pieces.of(ModelFile.read(PIECES))
    p = {h: np.exp(pieces.log_p[o]) for h, o in zip(pieces.hashes.tolist(), pieces.order.tolist())}
    from barriometrics.llm.arrow_text import bytes_hash

    def all_ways(text):
        return 1.0 if not text else sum(p.get(bytes_hash(text[:k]), 0.0) * all_ways(text[k:]) for k in range(1, len(text) + 1))

    for word in (b"the", b"andthe", "été".encode()):
        data = np.frombuffer(word, np.uint8)
        got = lattice_lm.log_marginals(pieces, data, np.array([0]), np.array([len(word)]))[0]
        assert np.isclose(got, np.log(all_ways(lattice_lm.MARKER + word)))
        assert np.isclose(got, lattice_lm._long_word(pieces, word))
        total = lattice_lm.expected_counts(pieces, data, np.array([0]), np.array([len(word)]), np.ones(1))
        assert total.sum() > 0


def test_lattice_base_matches_brute_force(docs, nothing):
    got = lattice_lm.scores(docs, ModelFile.read(PIECES), head=5).collect()
    out = {i for i, _ in TEXTS if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", lowered(t))
    counts = {}
    for i, t in TEXTS:
        for w in [*words(t), None] if i not in out else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["train_tokens"] == n and r["score"] < 0 and r["held_out"] == (r["doc_id"] in out) for r in got)
    assert lattice_lm.scores(nothing, ModelFile.read(PIECES)).count() == 0


def test_lattice_score_sums_over_kinds_and_segmentations(spark):
    rng = np.random.default_rng(5)
    stock = {"en": ["the", "and", "story", "hill"], "fr": ["le", "et", "mont", "the"], None: ["xx", "yy"]}
    rows = [(i, " ".join(rng.choice(stock[g], 6)) + f" own{i}", g) for i, g in enumerate(["en", "fr", None, "fr", "en", "en"] * 9)] + [(900, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = ModelFile.read(PIECES)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    by_kind = {g: Counter(w for _, t, k in learnt if k == g for w in t.split()) for g in stock}
    every = sum(by_kind.values(), Counter())
    pieces = lattice_lm.fit(spark.createDataFrame([(w.encode(),) for w in every], "word binary"), model)

    def spelled(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return np.exp(lattice_lm.log_marginals(pieces, data, np.array([0]), np.array([len(data)]))[0])

    def probability(text):
        total = 0.0
        for g, c in by_kind.items():
            ends = sum(k == g for *_, k in learnt)
            n, once = sum(c.values()) + ends, [w for w in c if c[w] == 1]
            d = min(0.95, max(0.05, len(once) / max(1, len(once) + 2 * sum(x == 2 for x in c.values()))))
            new = min(0.98, max(0.05, sum(every[w] == 1 for w in once) / max(1, len(once))))
            p = ends / len(learnt) * ends / n
            for w in text.split():
                back = (1 - new) * every[w] / every.total() + new * spelled(w)
                p *= (c[w] - d if w in c else 0) / n + d * len(c) / n * back
            total += p
        return np.log10(total)

    for head in (2, 1000):
        got = {r["doc_id"]: r["score"] for r in lattice_lm.scores(docs, model, head=head).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            assert np.isclose(got[i], probability(t), rtol=1e-9), i
    one = {r["doc_id"]: r["score"] for r in lattice_lm.scores(docs, model, kind=None).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(got[i] for i in held) > sum(one[i] for i in held)


def test_token_counts_and_cache(spark, docs, nothing, tmp_path):
    library = Tokenizer.from_file(WORDS)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all is cached
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, WORDS, cache).collect())
        assert got == sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    stored = spark.read.parquet(f"{cache}/version={encoders.version(WORDS)}")
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.token_counts(nothing, WORDS, cache).count() == 0


def test_word_encoder_is_the_library():
    library, own = Tokenizer.from_file(WORDS), encoders.encoder(WORDS)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aZ 'séß \t\n\x1c<|>İ中0½👍‍̈!.,À"), 50)) for _ in range(500)] + ["<|endoftext|>x<|ENDOFTEXT|>", "ﬁ ½ ΣΑΣ", ""]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, nothing):
    library = Tokenizer.from_file(WORDS)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.report(docs, WORDS).collect())
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in TEXTS}
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = [], 0
    for i, t in order:
        expected.append((start, i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())))
        start += len(ids[i, t])
    assert got == expected
    assert token_files.report(nothing, WORDS).count() == 0


def test_packed_blocks_hold_exceptions():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 40, 3 * token_files.BLOCK + 17).astype(np.uint32)
    ids[rng.integers(0, len(ids), 60)] = rng.integers(0, 2**32, 60)
    blocks = token_files.pack(ids)
    assert np.array_equal(token_files.unpack(blocks), ids)
    assert sum(map(len, blocks)) < len(ids)
    assert token_files.pack(np.zeros(0, np.uint32)) == []


def test_sentencepiece_parity(docs, nothing):
    original = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_backend.encode(docs, PIECES).select("row.doc_id", "row.text", "encoded.*").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["ids"] == original.encode(r["text"] or "") and r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"])
    tools = sentencepiece_backend.backend(PIECES, 1)
    for text in (" a", "a ", "  ", "a  b", "▁a b▁", "a\n b", "<s>x</s>"):
        assert tools.encode([text.encode()])[0].tolist() == original.encode(text)
    assert sentencepiece_backend.report(nothing, PIECES).count() == 0


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 400, 30)]
        toxic = i % 4 == 0
        rows.append((i, " ".join([*words, "Idiot!", "scum"] if toxic else words)))
        labels.append((i, int(toxic) if zlib.crc32(str(i).encode()) % 3 != 1 else 1))
    rows += [(None, None), (5000, ""), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.report(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 900)
    assert all(0 <= r["score"] < 0.7 for r in got if r["doc_id"] in (None, 5000))
    none = toxicity.report(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in none.collect()} == {0.5}


def test_host_reputation_rules_and_shrinkage(spark):
    urls = [(1, "http://WWW.Example.com/en/1?x"), (2, "https://a.example.com/en/2"), (3, "http://b.net/es/3#t"), (4, None), (5, "no scheme"), (6, "http://bad.org/x"), (7, "http://c.org"), (8, "http://a.com?q=://z/y"), (8, "http://a.com?q=://z/y")]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    outcomes = spark.createDataFrame([("bad.org", 200, 199), ("c.org", 400, 2), ("b.net", 50, 1)], "host string, n long, bad long")
    got = {r["page_id"]: r for r in host_reputation.judge(spark.createDataFrame(urls, "page_id long, url string"), outcomes, rules).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2]["rule"] == "example.com/en/" and got[3]["rule"] == "net/es/" and got[3]["verdict"] == "block"
    assert (got[4]["host"], got[4]["path"], got[5]["host"], got[8]["path"], got[8]["rule"]) == ("", "", "", "", None)
    assert got[6]["verdict"] == "block" and got[7]["verdict"] == "allow" and got[6]["lower"] > 0.9
    empty = host_reputation.judge(spark.createDataFrame(urls, "page_id long, url string"), outcomes.limit(0), rules)
    assert empty.count() == len(urls)


def brute_components(prints, bits):
    ids, values = list(prints), np.array([prints[i] for i in prints], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= bits)):
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_simhash_matches_brute_force(docs, nothing):
    expected = {k: plain_fingerprint(t) for k, (_, t) in enumerate(TEXTS)}
    got = simhash.report(docs).collect()
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{p:016x}" for p in expected.values())
    assert {r["doc_id"]: r["component_id"] for r in got}[2] == 1 and {r["doc_id"]: r["component_id"] for r in got}[6] == 4
    assert simhash.report(nothing).count() == 0


@pytest.mark.parametrize("limit", [simhash.LIST_PAIRS, 70])
def test_simhash_links_dense_lists_exactly(limit, monkeypatch):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    values = {base} | {base ^ sum(1 << int(b) for b in rng.integers(0, 32, rng.integers(1, 12))) for _ in range(400)}
    group = np.array(sorted(values), np.int64)
    monkeypatch.setattr(simhash, "LIST_PAIRS", limit)
    a, b = simhash._list_pairs(np.zeros(len(group), np.int64), group, 4)
    expected = brute_components({int(v): int(v) for v in group}, 4)
    values, low = simhash._forest_arrays(a, b)
    got = {int(v): int(v) for v in group} | dict(zip(values.tolist(), low.tolist()))
    assert len(set(got.values())) == len(set(expected.values()))
    assert all(len({got[v] for v in expected if expected[v] == r}) == 1 for r in set(expected.values()))


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", lowered(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edited(rng, words, edits):
    words = list(words)
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"e{rng.integers(1 << 40)}"
    return words


@pytest.mark.parametrize("parts", [1, 6])
def test_near_copies_of_all_kinds_match_brute_force(spark, parts):
    rng = np.random.default_rng(17)
    rows = []
    for k in range(30):  # copies of copies, so that some links lead over others
        words = [f"b{w}" for w in rng.integers(0, 1 << 30, int(rng.integers(60, 500)))]
        for _ in range(int(rng.integers(1, 9))):
            rows.append(" ".join(words))
            words = edited(rng, words, max(1, len(words) // 80)) if rng.random() < 0.8 else words
    base = [f"h{w}" for w in rng.integers(0, 1 << 30, 300)]
    rows += [" ".join(edited(rng, base, int(rng.integers(0, 3)))) for _ in range(150)]  # one hot group
    rows += [" ".join(f"w{w}" for w in rng.integers(0, 90, int(rng.integers(1, 8)))) for _ in range(60)]
    rows += [None, "", " \t ", "Same TEXT", "same text", "same  text"]
    numbered = list(zip(rng.permutation(len(rows)).tolist(), rows))
    prints = {i: plain_fingerprint(t) for i, t in sorted(numbered)}  # the smallest id first
    root = brute_components(prints, 4)
    docs = spark.createDataFrame(numbered, "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}
    assert 60 < len(set(root.values())) < 180
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(root.values()))


def test_stage_keeps_one_row_of_repeated_and_missing_ids(spark):
    long = " ".join(f"z{i}" for i in range(50_000))
    rows = [(None, "a b c d e"), (7, "A B c d e"), (7, "a b c d e"), (None, "alone here"), (9, long), (8, long + " end"), (3, None)]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, rid int").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema and simhash.keep_one(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:3].lower()) for r in kept.collect()) == [(-1, "alo"), (3, ""), (7, "a b"), (8, "z0 ")]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_html_main_text():
    page = """<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies. Accept.</div>
    <main><h2>Title &amp; more</h2><p>First <b>para</b>, ok?<p>Second&nbsp;one.<div class="ad-slot">Buy.</div><ul><li>item one<li>two</ul><script>x="</p>"</script>
    <p title="a>b">Third</p><section id="comments"><p>Nice, thanks for all of this.</p></section></main><aside>Side. Here.</aside><footer>&copy; x</footer>"""
    assert html_extract.main_text(page) == "Title & more First para, ok? Second one. item one two Third"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p 'x>") == ""


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        terminal = rng.normal(0, 1, n).tolist()
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.random(12)) if a != b]

        def cost(labels):
            return sum(max(0, t) if not x else max(0, -t) for t, x in zip(terminal, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert np.isclose(cost(html_extract.minimum_cut(terminal, edges)), best)


@pytest.mark.parametrize("block", [decontaminate.TEST_BLOCK_BYTES, 600])
def test_decontamination_matches_brute_force(spark, docs, nothing, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "TEST_BLOCK_BYTES", block)
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    tests = [(1, " ".join(BODY.split()[8:24])), (2, "one"), (3, "ÜNÏCODE straße"), (4, ""), (5, None), (6, "never seen in any text at all by anyone here"), (12, " ".join(BODY.split()[8:24])), (1, " ".join(BODY.split()[8:24])), (None, "long long long")]
    got = decontaminate.report(docs, spark.createDataFrame(tests, "item_id long, text string")).collect()
    windows = {}
    for i, t in tests:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    expected = []
    for i, t in TEXTS:
        w, items, hit = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    items |= {x for x in found if x is not None}
                    hit |= set(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        expected.append((str(i), len(w), len(hit), len(items), digest, bool(hit)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(expected)
    assert decontaminate.report(nothing, spark.createDataFrame(tests, "item_id long, text string")).count() == 0
    assert decontaminate.report(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_stages_return_the_columns_of_documents(spark, docs):
    folder = "/root/testdata/sf0.001"
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, folder)
        assert given.columns == docs.columns, name
    kept = {r["doc_id"] for r in given.select("doc_id").collect()}
    assert 1 in kept and not kept & {2, 11, 5, 6} and {8, 9, 10, None} <= kept
    assert corpus_pipeline.STAGES[-1][1](spark, given, folder).where("NOT parity OR NOT round_trip").count() == 0


def test_expected_counts_of_long_words_are_those_of_the_lattice(monkeypatch):
    pieces = lattice_lm.Pieces.of(ModelFile.read(PIECES))
    words = [b"internationalisation" * 3, b"a", "日本語のテキスト".encode() * 4]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start, count = end - [len(w) for w in words], np.array([1.0, 2.0, 3.0])
    expected = lattice_lm.expected_counts(pieces, data, start, end, count)
    monkeypatch.setattr(lattice_lm, "_LONG", 0)
    monkeypatch.setattr(lattice_lm, "_STRETCH", 7)
    np.testing.assert_allclose(lattice_lm.expected_counts(pieces, data, start, end, count), expected, atol=1e-9)
