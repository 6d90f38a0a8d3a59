"""Spelling variants: edit-distance rows over a sorted vocabulary, shared prefixes worked once.

Two words one edit apart (a code point inserted, deleted or replaced) differ before or behind the middle, so
they share either their first half or the rest. Each word therefore stands in a few shards of the
vocabulary, keyed by one half and a length; every near pair meets in exactly one of them.

A shard is a sorted list of words. Each word is a query that scans the list with the band of its edit
matrix (three cells a row: one edit reaches no further). A row belongs to a range of the list, all
words that begin with the same characters as told by the common prefixes of neighbours, and is worked out
once for the range. A range whose row has no cell below two is skipped; where one edit is spent,
only the ranges going on with a character that the band asks for are looked up. All queries of a block
advance a character at a time together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barriometrics.llm import arrow_text
from barriometrics.session import materialise

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A run is damaged where this divides the CRC of its document and itself.
DAMAGE = 97
#: Words are maximal runs of ``[A-Za-zÀ-ÿ]``, here as UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+").findall
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: A shard's list is cut into parts of about so many words; each of its words is then a query to every part.
PART_WORDS = 100_000
QUERIES = 4096
#: Words of several shards are scanned together.
RUN_WORDS = 10_000


def _damaged(run: bytes, crc: int) -> bytes:
    text = run.decode()
    at = crc % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """word, n: the runs of letters of all whole texts, A-Z lower-cased, and how often they occur.

    With ``damage``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses the code point at crc32 % length.
    NULL and empty texts have no runs; a row without id counts as id ""; repeated rows count again.
    """
    rows = documents.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            data, offsets = arrow_text.buffers(batch.column("text"))
            raw = memoryview(data)
            for i, a, b in zip(batch.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                runs = RUN(raw[a:b].tobytes().lower())
                held.update(runs)
                if damage:
                    start = zlib.crc32(f"{i}:".encode())
                    hit = [r for r in set(runs) if not zlib.crc32(r, start) % damage]
                    own = Counter(runs) if len(hit) > 8 else None
                    for run in hit:
                        n = own[run] if own else runs.count(run)
                        held[run] -= n
                        held[_damaged(run, zlib.crc32(run, start))] += n
                if len(held) > HELD_WORDS:
                    yield flushed(held)
                    held = Counter()
        yield flushed(held)

    counts = rows.mapInArrow(count, "word string, n long").where("word <> ''")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


class SortedLists:
    """Lists of distinct words in code-point order, one behind the other, with what a scan needs to know of common prefixes."""

    def __init__(self, characters: np.ndarray, length: np.ndarray, begins: np.ndarray):
        """``characters``: a row of code points for each word, 0 behind its end; ``begins``: whether a word opens a list."""
        self.characters, self.length = characters, length
        k, width = characters.shape
        self.lcp = np.full(k, -1)  # nothing is shared across lists
        self.lcp[1:] = np.where(begins[1:], -1, np.cumprod(characters[1:] == characters[:-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64))
        self.starts: list[np.ndarray] = []  # by depth: where a range of words with the same depth + 1 characters begins
        self.looked: list[np.ndarray] = []  # by depth: (range of depth characters, next character) of each word, ascending
        for depth in range(width):
            begin, parent = np.flatnonzero(self.lcp <= depth), np.flatnonzero(self.lcp < depth)
            self.starts.append(begin)
            of = np.repeat(parent, np.diff(np.append(parent, k)))
            self.looked.append(of[begin] << 21 | characters[begin, depth])

    def near(self, queries: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for all words from ``low`` up to ``high``, a list of its own for each query, that are exactly one edit from it."""
        width = self.characters.shape[1]
        padded = np.zeros((len(queries), max(width, queries.shape[1]) + 3), np.int64)
        padded[:, 1 : queries.shape[1] + 1] = queries  # character j of a query at j + 1
        q = np.flatnonzero(low < high)
        low, high = low[q], high[q]
        #: Cells (depth, depth - 1), (depth, depth), (depth, depth + 1) of the edit matrix, at most 2.
        left, mid, right = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        depth = 0
        while len(q):
            ends = self.length[low] == depth  # the range's first word ends here
            gap = length[q] - depth
            cell = np.where(gap == 0, mid, np.where(gap == 1, right, np.where(gap == -1, left, 2)))
            hit = ends & (cell == 1)
            out.append((q[hit], low[hit]))
            low = low + ends
            stay = low < high
            q, low, high, left, mid, right = (x[stay] for x in (q, low, high, left, mid, right))
            if depth >= width or not len(q):
                break
            free = np.minimum(np.minimum(left, mid), right) == 0
            parts = [self._all(q, low, high, free, depth)]
            asked = [(~free & (cell == 1), padded[q, depth + 1 + shift]) for shift, cell in ((-1, left), (0, mid), (1, right))]
            for n, (use, character) in enumerate(asked):
                for before, other in asked[:n]:
                    use = use & ~(before & (other == character))
                parts.append(self._one(np.flatnonzero(use & (character > 0)), low, character, depth))
            parent, low_, high_ = (np.concatenate(x) for x in zip(*parts, strict=True))
            query, word = q[parent], self.characters[low_, depth]
            a, b, c = left[parent], mid[parent], right[parent]
            # Cells of the next row; its left cell lies under b, its middle one under c.
            new_left = np.minimum(a + (padded[query, depth] != word), b + 1) if depth else np.ones(len(query), np.int8)
            new_mid = np.minimum(np.minimum(b + (padded[query, depth + 1] != word), c + 1), new_left + 1)
            new_right = np.minimum(c + (padded[query, depth + 2] != word), new_mid + 1)
            beyond = length[query] - depth - 1
            new_mid = np.where(beyond < 0, 2, new_mid)
            new_right = np.where(beyond < 1, 2, new_right)
            alive = np.minimum(np.minimum(new_left, new_mid), new_right) < 2
            q, low, high = query[alive], low_[alive], high_[alive]
            left, mid, right = (np.minimum(x[alive], 2).astype(np.int8) for x in (new_left, new_mid, new_right))
            depth += 1
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _all(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, chosen: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every range that goes on a chosen one: its index, first word and end."""
        starts, at = self.starts[depth], np.flatnonzero(chosen)
        a, b = np.searchsorted(starts, low[at], "left"), np.searchsorted(starts, high[at], "left")
        size = b - a
        index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        return np.repeat(at, size), starts[index], np.append(starts, len(self.length))[index + 1]

    def _one(self, at: np.ndarray, low: np.ndarray, character: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The range that goes on a chosen one with a character, where there is one."""
        looked, starts = self.looked[depth], self.starts[depth]
        mine = looked[np.searchsorted(starts, low[at], "right") - 1] >> 21
        wanted = mine << 21 | character[at]
        i = np.minimum(np.searchsorted(looked, wanted, "left"), len(looked) - 1)
        found = looked[i] == wanted
        i = i[found]
        return at[found], starts[i], np.append(starts, len(self.length))[i + 1]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, 0 behind their ends, and their lengths."""
    length = np.array([len(w) for w in words], np.int64)
    wide = np.array(words, dtype=f"U{max(1, int(length.max(initial=1)))}")
    return wide.view(np.uint32).reshape(len(words), -1).astype(np.int64), length


def shards_of(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, and the shard (size, front, half), part and whether the word stands in this part's list.

    Of size c are words of c and c + 1 characters; their first c // 2 characters, or their last c - c // 2.
    """
    sides = [
        F.struct((F.length("word") - less).alias("size"), F.lit(front).alias("front"), half.alias("half"))
        for less in (0, 1)
        for size in [F.length("word") - less]
        for front, half in (
            (True, F.substring("word", F.lit(1), F.floor(size / 2).cast("int"))),
            (False, F.col("word").substr(F.length("word") - (size - F.floor(size / 2)).cast("int") + 1, (size - F.floor(size / 2)).cast("int"))),
        )
    ]
    rows = vocabulary.select("word", "n", F.explode(F.array(*sides)).alias("shard")).select("word", "n", "shard.*")
    large = rows.groupBy("size", "front", "half").agg(F.count("*").alias("words")).where(F.col("words") > part_words)
    large = large.select("size", "front", "half", F.ceil(F.col("words") / part_words).alias("parts"))
    rows = rows.join(large, ["size", "front", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("word"), F.col("parts"))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select("word", "n", "size", "front", "half", "part", (F.col("own") == F.col("part")).alias("listed"))


def _changes(table: pa.Table | pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Where a sorted table's values of ``by`` differ from the row before; the first row always does."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in by:
        values = table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def _near_of(table: pa.Table) -> pa.RecordBatch:
    """For each word of some shards' parts: how many near words its list has, and the most frequent of them."""
    words = table.column("word").to_pylist()
    n, size = table.column("n").to_numpy(), table.column("size").to_numpy()
    front, listed = table.column("front").to_numpy(), np.flatnonzero(table.column("listed").to_numpy())
    shard = np.cumsum(_changes(table, _SHARD)) - 1
    characters, length = code_points(words)
    lists = SortedLists(characters[listed], length[listed], np.append(True, shard[listed][1:] != shard[listed][:-1])[: len(listed)])
    low, high = np.searchsorted(shard[listed], shard, "left"), np.searchsorted(shard[listed], shard, "right")
    counts, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    for a in range(0, len(words), QUERIES):
        block = slice(a, a + QUERIES)
        q, e = lists.near(characters[block], length[block], low[block], high[block])
        q, e = q + a, listed[e]
        here = np.minimum(length[q], length[e]) == size[q]  # two longer ones meet in the shard of the next size
        q, e = q[here], e[here]
        common = np.cumprod(characters[q] == characters[e], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
        here = front[q] | (common < size[q] // 2)  # else they meet by their first half
        q, e = q[here], e[here]
        counts += np.bincount(q, minlength=len(words))
        order = np.lexsort((e, -n[e], q))
        q, e = q[order], e[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        best[q[first]] = e[first]
    some = np.flatnonzero(counts)
    columns = [pa.array([words[i] for i in some], pa.string()), pa.array(counts[some]), pa.array(n[best[some]]), pa.array([words[i] for i in best[some]], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "form_n", "form"])


_SHARD = ["size", "front", "half", "part"]


def near_words(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n_near, form_n, form: of each word (word, n) with near words, their number and the most frequent.

    Ties go to the first in code-point order. Words are distinct; of a hot shard each part answers apart.
    """
    rows = shards_of(vocabulary, part_words).repartition(*_SHARD).sortWithinPartitions(*_SHARD, "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _SHARD, RUN_WORDS):
            yield _near_of(table)

    found = rows.mapInArrow(scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows or more, from sorted batches, that never part rows with the same values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        new = _changes(batch, by)
        if held:
            new[0] = any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in by)
        last = np.flatnonzero(new)[-1:].tolist()
        if held and last and sum(map(len, held)) + last[0] >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, last[0])])
            held, batch = [], batch.slice(last[0])
        if len(batch):
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word (word, form) along the forms to the last; forms never go round.

    Each step joins the roots so far with themselves and halves what is left of every path.
    """
    table = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not table.where("moved").isEmpty():
        further = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        table = table.drop("moved").join(further, "root", "left")
        table = materialise(table.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return table.drop("moved")


def variants(
    counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = 2, part_words: int = PART_WORDS
) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words (word, n) long and frequent enough.

    A word's form is its most frequent near word (ties: the first in code-point order) if that occurs at
    least ``ratio`` times as often, else NULL; its root is where following forms ends, itself without a form.
    NULL words are left out. An empty table gives no rows.
    """
    kept = (F.length("word") >= least_length) & (F.col("n") >= least_count)
    vocabulary = materialise(counts.where(kept).select("word", "n"), "vocabulary")
    found = vocabulary.join(near_words(vocabulary, part_words), "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")
    )
    found = materialise(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n of the damaged words of all texts."""
    return variants(word_counts(documents, doc_id)).select("word", "form", "root", "n", "n_near", "form_n")
