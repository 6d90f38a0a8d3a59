"""Benchmark decontamination: suffix arrays over the training shards, searched with every test suffix.

A shard is a run of training rows inside one task. Its words become numbers: a word of the tests has its
place in the tests' vocabulary, any other word is 0, through which no match can pass. The suffix array
orders all positions that start with a test word by as many words as fit one 64-bit key; a range is put
in order by the following words only when a search enters it, so long copies cost no deep sort of the
rest. Every test suffix is found by binary search, and goes on into deeper ranges for its longest match.

Training rows are never shuffled. The tests are sent to the tasks in blocks of at most
``TEST_BLOCK_BYTES`` of text, one pass over the training rows for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barriometrics.llm import arrow_text

WINDOW = 10
TEST_BLOCK_BYTES = 16 << 20

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_item", T.LongType()),
        T.StructField("longest_at", T.LongType()),
    ]
)


@dataclass
class Tests:
    """One block of tests, as numbers: ``words`` holds all items, a 0 after each."""

    vocabulary: np.ndarray
    words: np.ndarray
    start: np.ndarray
    item: np.ndarray
    known: np.ndarray
    left: np.ndarray
    need: np.ndarray

    @staticmethod
    def of(items: list[tuple[int | None, str | None]], window: int) -> Tests:
        found = arrow_text.words(pa.array([text or "" for _, text in items], pa.string()), arrow_text.ALNUM)
        vocabulary, number = np.unique(found.hash, return_inverse=True)
        words = np.zeros(len(number) + len(items), np.int64)
        place = np.arange(len(number)) + found.row
        words[place] = number + 1
        counts = found.counts()
        inside = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
        length = counts[found.row]
        return Tests(
            vocabulary, words, place, np.array([-1 if i is None else i for i, _ in items], np.int64)[found.row],
            np.array([i is not None for i, _ in items], bool)[found.row], length - inside, np.minimum(window, length),
        )


class Shard:
    """The suffix array of one shard's words, ordered deeper where searches go."""

    def __init__(self, numbers: np.ndarray, vocabulary: int):
        self.bits = max(1, int(vocabulary).bit_length())
        self.wide = max(1, min(8, 63 // self.bits))
        self.numbers = np.concatenate((numbers, np.zeros(self.wide, np.int64)))
        start = np.flatnonzero(numbers)
        key = self.key(self.numbers, start)
        order = np.argsort(key, kind="stable")
        self.places, self.keys = start[order], key[order]

    def key(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next words from each position, packed; beyond the end all words are 0."""
        key = np.zeros(len(at), np.int64)
        for j in range(self.wide):
            key = (key << self.bits) | numbers[np.minimum(at + j, len(numbers) - 1)]
        return key

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Longest match of every test suffix and a place of it; (suffix, place) where the match reaches its need."""
        test_words = np.concatenate((tests.words, np.zeros(self.wide, np.int64)))
        longest, at = np.zeros(len(tests.start), np.int64), np.full(len(tests.start), -1)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        live, segment = np.arange(len(tests.start)), np.zeros(len(tests.start), np.int64)
        places, keys, bounds = self.places, self.keys, np.array([0, len(self.places)])
        depth = 0
        while len(live) and len(places):
            wanted = self.key(test_words, tests.start[live] + depth)
            single = len(bounds) == 2
            if not single:
                ranked, rank = np.unique(keys, return_inverse=True)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                joint = owner * (len(ranked) + 1) + rank

            def range_of(words_kept: int) -> tuple[np.ndarray, np.ndarray]:
                """Where the suffixes lie that agree with each live search in so many further words."""
                shift = self.bits * (self.wide - words_kept)
                low = (wanted >> shift) << shift
                a = np.searchsorted(keys if single else ranked, low, "left")
                b = np.searchsorted(keys if single else ranked, low + ((1 << shift) - 1), "right")
                if single:
                    return a, b
                base = segment * (len(ranked) + 1)
                return np.searchsorted(joint, base + a, "left"), np.searchsorted(joint, base + b, "left")

            full = None
            for more in range(1, self.wide + 1):
                lo, hi = range_of(more)
                fits = (hi > lo) & (tests.left[live] >= depth + more)
                longest[live[fits]] = depth + more
                at[live[fits]] = places[lo[fits]]
                reached = fits & (tests.need[live] == depth + more)
                if reached.any():
                    hits.append(_expand(live[reached], places, lo[reached], hi[reached]))
                full = (fits, lo, hi)
            fits, lo, hi = full
            live, lo, hi = live[fits], lo[fits], hi[fits]
            depth += self.wide
            if not len(live):
                break
            pairs, segment = np.unique(np.stack((lo, hi), 1), axis=0, return_inverse=True)
            segment = segment.reshape(-1)
            sizes = pairs[:, 1] - pairs[:, 0]
            owner, chosen = _expand(np.arange(len(pairs)), places, pairs[:, 0], pairs[:, 1])
            keys = self.key(self.numbers, chosen + depth)
            order = np.lexsort((keys, owner))
            places, keys = chosen[order], keys[order]
            bounds = np.concatenate(([0], np.cumsum(sizes)))
        if hits:
            return longest, at, (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
        return longest, at, (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _expand(owner: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) for every value of each owner's range."""
    sizes = hi - lo
    index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
    return np.repeat(owner, sizes), values[index]


def _shard_rows(batch: pa.RecordBatch, tests: Tests, earlier: list | None) -> list[dict]:
    found = arrow_text.words(batch.column("text"), arrow_text.ALNUM)
    counts = found.counts()
    place = np.arange(len(found.hash)) + found.row  # a 0 after each row
    numbers = np.zeros(len(found.hash) + found.rows, np.int64)
    if len(tests.vocabulary):
        near = np.minimum(np.searchsorted(tests.vocabulary, found.hash), len(tests.vocabulary) - 1)
        numbers[place] = np.where(tests.vocabulary[near] == found.hash, near + 1, 0)
    shard = Shard(numbers, len(tests.vocabulary))
    longest, at, (suffix, position) = shard.search(tests)
    first = np.cumsum(counts) - counts + np.arange(found.rows)  # of each row, in numbers
    of_row = lambda p: np.searchsorted(first, p, "right") - 1

    marks = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(marks, position, 1)
    np.add.at(marks, position + tests.need[suffix], -1)
    covered = np.concatenate(([0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]))
    turns = np.diff(covered)
    opened, closed = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    spans: dict[int, list[int]] = {}
    for r, a, b in zip(of_row(opened), opened, closed, strict=True):
        spans.setdefault(int(r), []).extend((int(a - first[r]), int(b - first[r])))
    items: dict[int, set[int]] = {}
    known = tests.known[suffix]
    pairs = np.unique(np.stack((of_row(position[known]), tests.item[suffix[known]]), 1), axis=0)
    for r, i in pairs.tolist():
        items.setdefault(r, set()).add(i)
    best: dict[int, tuple[int, int, int]] = {}
    some = np.flatnonzero(at >= 0)
    if len(some):
        rows = of_row(at[some])
        order = np.lexsort((tests.item[some], -longest[some], rows))
        for k in order[np.unique(rows[order], return_index=True)[1]]:
            s = some[k]
            best[int(rows[k])] = (int(longest[s]), int(tests.item[s]) if tests.known[s] else None, int(at[s] - first[rows[k]]))
    out = []
    for r in range(found.rows):
        row = {"n_words": int(counts[r]), "spans": spans.get(r, []), "items": sorted(items.get(r, ()))}
        row["longest"], row["longest_item"], row["longest_at"] = best.get(r, (0, None, None))
        if earlier:
            row = _merged(earlier[r], row)
        out.append(row)
    return out


def _merged(a: dict, b: dict) -> dict:
    """The findings of two blocks of tests about one row."""
    spans: list[int] = []
    for s, e in sorted(zip(a["spans"][::2] + b["spans"][::2], a["spans"][1::2] + b["spans"][1::2], strict=True)):
        if spans and s <= spans[-1]:
            spans[-1] = max(spans[-1], e)
        else:
            spans += [s, e]
    best = a if a["longest"] >= b["longest"] else b
    return best | {"spans": spans, "items": sorted({*a["items"], *b["items"]})}


def _test_blocks(benchmark: DataFrame, item: str, item_text: str, window: int) -> Iterator[Broadcast]:
    """The tests, sent to all tasks in blocks of bounded size; one block at least."""
    spark = benchmark.sparkSession
    tests = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("body")).distinct()
    size = tests.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // TEST_BLOCK_BYTES))
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block).orderBy("item", "body").collect()
        yield spark.sparkContext.broadcast(Tests.of([(r["item"], r["body"]) for r in rows], window))


def matches(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Each training row with what it holds of the tests: columns ``row`` (all given columns), ``found``.

    ``found``: n_words; spans, the merged word ranges (start, end, start, end, ...) inside any occurrence of
    a test window; items, the distinct ids of tests with a window here; longest, longest_item, longest_at: the
    longest verbatim match that a search of this row's shard placed in it. A window is ``window``
    consecutive words of a test, or all words of a shorter one.

    NULL or wordless texts have no words and no hits; wordless tests have no window; repeated rows are each
    judged; a test repeated under one id counts once; a test without id marks words and isn't listed.
    Empty tables give no rows, or rows without hits. Given columns keep their names inside ``row``.
    """
    out = documents.select(F.struct("*").alias("row"))
    for shared in _test_blocks(benchmark, item, item_text, window):
        schema = T.StructType([out.schema["row"], T.StructField("found", _FOUND)])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in arrow_text.pieces(arrow_text.with_text(batch, text), "text"):
                    earlier = piece.column("found").to_pylist() if "found" in piece.schema.names else None
                    found = _shard_rows(piece, shared.value, earlier)
                    yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(found, _ARROW)], ["row", "found"])

        out = out.mapInArrow(search, schema)
    return out.select("row", "found")


_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64())), ("longest", pa.int64()), ("longest_item", pa.int64()), ("longest_at", pa.int64())]
)


def hit_words(spans: Column) -> Column:
    """Words covered by merged spans."""
    ends = F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: x - total)
    return ends  # end - (start - ...) alternates, so the last value is the sum of lengths


def report(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per training row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = matches(documents.select(doc_id, "text"), benchmark, window=window)
    ids = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    n_hit = hit_words(F.col("found.spans"))
    return found.select(
        F.col(f"row.{doc_id}").alias(doc_id), F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.col("found.longest").alias("longest_match"),
    )


def remove_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The training rows that hold no test window, with the columns they came with; batches are filtered as they are."""
    out = documents
    for shared in _test_blocks(benchmark, item, item_text, window):

        def choose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in arrow_text.pieces(batch, text):
                    found = _shard_rows(piece.select([text]).rename_columns(["text"]), shared.value, None)
                    yield piece.filter(pa.array([not row["spans"] for row in found], pa.bool_()))

        out = out.mapInArrow(choose, documents.schema)
    return out
