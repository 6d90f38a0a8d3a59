"""Substring removal: suffix automata of reference shards give documents their matching statistics.

A window of ``window`` words that also starts in a document with a smaller id goes. Documents are read
once and kept as pieces, files of a few megabytes in the shared folder; no text is shuffled.

1. A piece cuts its documents into stretches: runs of consecutive windows whose least hash of ``GRAM``
   words, the stretch's key, is the same. Equal windows have equal keys, wherever they stand.
2. Keys go to reference shards (one row for each piece and shard), which answer whether another
   document has the key at all. Most stretches end here.
3. Each different stretch of the others goes to its key's shard, once for a piece. The shard adds them to
   suffix automata in order of document, each state knowing the first document of its words, and
   streams each through the automaton of those before: where the matching statistic reaches ``window``,
   the state tells the window's first document.
4. Pieces are read again: windows whose first document is smaller than their own are marked, and the
   maximal marked spans removed.

The reference grows with the corpus, so its automata have no bounded size to broadcast; each stretch is sent
to the one shard that can hold its matches instead, which finds the same matches in time proportional to
the corpus. A shard is worked in runs of keys of about ``RUN_WORDS`` words, one automaton at a time. A key
with more than ``HOT_WORDS`` words of stretches is split: its windows go one by one to keys of their own
hashes. Copies of a stretch are one row for each piece, however many documents share them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barriometrics.llm import arrow_text
from barriometrics.session import materialise, scratch_path

WINDOW = 13
#: Words of which the least hash is a window's key.
GRAM = 4
PIECE_BYTES = 4 << 20
#: Text for each reference shard, before stretches without a partner have gone.
SHARD_BYTES = 16 << 20
RUN_WORDS = 1 << 15
HOT_WORDS = 1 << 18
#: Documents without an id come after all others.
LAST = np.iinfo(np.int64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton of stretches of words; each state has the first document of its strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _apart(self, before: int, word: int, state: int) -> int:
        """Splits off those strings of ``state`` that end ``before`` and ``word``."""
        new = len(self.next)
        self.next.append(self.next[state].copy())
        self.link.append(self.link[state])
        self.length.append(self.length[before] + 1)
        self.first.append(self.first[state])
        self.link[state] = new
        while before != -1 and self.next[before].get(word) == state:
            self.next[before][word] = new
            before = self.link[before]
        return new

    def add(self, words: list[int], document: int) -> None:
        """Adds a stretch; documents come in ascending order."""
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            known = following[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._apart(last, word, known)
                continue
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            self.first.append(document)
            link.append(0)
            while last != -1 and word not in following[last]:
                following[last][word] = new
                last = link[last]
            if last != -1:
                known = following[last][word]
                link[new] = known if length[known] == length[last] + 1 else self._apart(last, word, known)
            last = new

    def stream(self, words: list[int], window: int) -> list[int]:
        """For each window of the words, the first document with it; -1 where the matching statistic is shorter."""
        following, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        out = []
        for i, word in enumerate(words, 1):
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = following[state].get(word)
            if to is not None:
                state, size = to, size + 1
                while size > window and length[link[state]] >= window:
                    state = link[state]
                    size = min(size, length[state])
            if i >= window:
                out.append(first[state] if size >= window else -1)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _grams(words: np.ndarray, window: int) -> np.ndarray:
    """Hashes of ``GRAM`` neighbouring words, fewer in a smaller window."""
    width = min(GRAM, window)
    grams = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        grams = _mixed((grams + words[j : j + len(grams)]) * _STEP)
    return grams


def _hashes(words: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, the same wherever a run stands."""
    n = len(words)
    power, back = np.full(n + 1, _STEP), np.full(n + 1, pow(int(_STEP), -1, 2**64), np.uint64)
    power[:1] = back[:1] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    return _mixed((total[first + length] - total[first]) * back[first])


class Stretches:
    """The stretches of a piece, in text order: first word, number of windows, key, document, hash of the words."""

    def __init__(self, found: arrow_text.Words, documents: np.ndarray, window: int):
        self.window, self.words = window, found.hash
        count = len(self.words) - window + 1
        if count < 1:
            self.first, self.windows, self.key, self.document = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        keys = _least(_grams(self.words, window), window - min(GRAM, window) + 1)
        start = np.flatnonzero(found.row[:count] == found.row[window - 1 :])
        key, row = keys[start], found.row[start]
        at = np.flatnonzero(_changes(key, row))
        self.first, self.windows = start[at], np.diff(np.append(at, len(start)))
        self.key, self.document = key[at], documents[row[at]]

    def split(self, level: np.ndarray) -> None:
        """Stretches with a level above 0 become single windows, under 2 ** level keys by their hashes."""
        hot = np.repeat(level > 0, np.where(level > 0, self.windows, 1))
        times = np.where(level > 0, self.windows, 1)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, windows = np.repeat(self.first, times) + inside, np.where(hot, 1, np.repeat(self.windows, times))
        key, document, level = np.repeat(self.key, times), np.repeat(self.document, times), np.repeat(level, times)
        self.first, self.windows, self.document = first, windows, document
        part = self.hash() & ((np.uint64(1) << level.astype(np.uint64)) - np.uint64(1))
        self.key = np.where(hot, _mixed(key + (part + np.uint64(1)) * _STEP), key)

    def keep(self, chosen: np.ndarray) -> None:
        self.first, self.windows, self.key, self.document = (x[chosen] for x in (self.first, self.windows, self.key, self.document))

    def hash(self) -> np.ndarray:
        return _hashes(self.words, self.first, self.windows + self.window - 1)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _groups(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    start = np.flatnonzero(_changes(sorted_))
    return start, np.diff(np.append(start, len(sorted_)))


def _changes(*sorted_: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row always does."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return new


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, joined."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _store(folder: str, batch: pa.RecordBatch) -> str:
    """Writes a file of the task's own under a fresh name; only names that reach a written table are read."""
    name = f"{folder}/{uuid.uuid4().hex}.arrow"
    system, place = fs.FileSystem.from_uri(name)
    with system.open_output_stream(place) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return name


def _load(name: str) -> pa.RecordBatch:
    system, place = fs.FileSystem.from_uri(name)
    with system.open_input_stream(place) as source, pa.ipc.open_stream(source) as reader:
        return reader.read_next_batch()


def _ids(piece: pa.RecordBatch) -> np.ndarray:
    return piece.column("_id").fill_null(LAST).to_numpy(zero_copy_only=False)


def _keys(stretches: Stretches, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The piece's keys by shard: key, shard, stretches that differ, in several documents, and each stretch's place among them."""
    value = stretches.hash()
    shard = _shard(stretches.key, shards)
    order = np.lexsort((value, stretches.key, shard))
    key, value, document = stretches.key[order], value[order], stretches.document[order]
    start, size = _groups(key)
    if not len(start):
        return key, shard, size, size > 0, size
    new = _changes(key, value).astype(np.int64)
    several = np.minimum.reduceat(document, start) < np.maximum.reduceat(document, start)
    place = np.empty(len(key), np.int64)
    place[order] = np.repeat(np.arange(len(start)), size)
    return key[start], shard[order][start], np.add.reduceat(new, start), several, place


def _by(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of all rows with one value, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        start, size = _groups(values)
        for a, n in zip(start.tolist(), size.tolist(), strict=True):
            if held and held[0].column(column)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, n))
    if held:
        yield pa.Table.from_batches(held)


def _joined(table: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' numbers joined, and how many each row has."""
    parts = [np.frombuffer(x.as_py() or b"", kind) for x in table.column(column)]
    return np.concatenate(parts), np.array([len(p) for p in parts])


_ASK = T.StructType([T.StructField("path", T.StringType()), T.StructField("shard", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("low", "high", "seen"))])
_SEND = T.StructType([T.StructField("path", T.StringType()), T.StructField("shard", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("documents", "sizes", "text"))])


def _cut(folder: str, text: str, shards: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrow_text.pieces(arrow_text.with_text(batch, text), "text", PIECE_BYTES):
                path = _store(folder, piece)
                found = arrow_text.words(piece.column("text"), arrow_text.SPACED, lower=False)
                key, shard, differ, several, _ = _keys(Stretches(found, _ids(piece), window), shards)
                seen = (np.minimum(differ, 32_767) << 1 | several).astype("<u2")
                start, size = _groups(shard)
                columns: list[list] = [[path], [-1], [None], [None], [None]]  # the piece itself, should it ask nothing
                for a, b in zip(start.tolist(), (start + size).tolist(), strict=True):
                    low, high = key[a:b].astype("<u4"), (key[a:b] >> np.uint64(32)).astype("<u2")
                    for column, value in zip(columns, (path, int(shard[a]), low.tobytes(), high.tobytes(), seen[a:b].tobytes()), strict=True):
                        column.append(value)
                types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _ASK.names)

    return run


def _answer(window: int, hot_words: int):
    """Of each key asked: 0 if no other document has it, else 1 and the level by which it is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by(batches, "shard"):
            low, sizes = _joined(table, "low", "<u4")
            high, seen = _joined(table, "high", "<u2")[0], _joined(table, "seen", "<u2")[0].astype(np.int64)
            _, place, pieces = np.unique(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), return_inverse=True, return_counts=True)
            differ = np.bincount(place, seen >> 1)
            shared = (pieces > 1) | (np.bincount(place, seen & 1) > 0)
            level = np.ceil(np.log2(np.maximum(1, differ * 1.5 * window / hot_words))).astype(np.uint8)
            codes = np.where(shared, np.minimum(level, 32) + 1, 0).astype(np.uint8)[place]
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            replies = [codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("path").combine_chunks(), table.column("shard").combine_chunks(), pa.array(replies, pa.binary())], ["path", "shard", "codes"])

    return run


def _asking(piece: pa.RecordBatch, codes: np.ndarray, found: arrow_text.Words, shards: int, window: int) -> tuple[Stretches, np.ndarray, np.ndarray]:
    """The piece's stretches whose keys others have too, sorted by shard; their shards, and where a different one begins."""
    own = Stretches(found, _ids(piece), window)
    code = codes[_keys(own, shards)[4]]
    own.keep(code > 0)
    own.split(code[code > 0] - 1)
    value, shard = own.hash(), _shard(own.key, shards)
    order = np.lexsort((own.document, own.windows, value, own.key, shard))
    own.keep(order)
    return own, shard[order], _changes(own.key, value[order], own.windows)


def _send(shards: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by(batches, "path"):
            codes = _joined(table, "codes", np.uint8)[0].astype(np.int64)
            if not codes.any():
                continue
            path = table.column("path")[0].as_py()
            piece = _load(path)
            found = arrow_text.words(piece.column("text"), arrow_text.SPACED, lower=False)
            own, shard, new = _asking(piece, codes, found, shards, window)
            own.keep(new)
            length = own.windows + window - 1
            rows = []
            for a, n in zip(*(x.tolist() for x in _groups(shard[new])), strict=True):
                part = slice(a, a + n)
                at = _spread(own.first[part], length[part])
                text = _spaced(found.data, found.start[at], found.end[at])
                arrays = (own.document[part].tobytes(), length[part].astype("<u4").tobytes(), pa.compress(text, "zstd", asbytes=True), len(text))
                rows.append((path, int(shard[new][a]), *arrays[:2], arrays[3].to_bytes(8, "little") + arrays[2]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), *[pa.binary()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, _SEND.names)

    return run


def _spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The byte ranges, a space behind each."""
    size = end - start
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[_spread(np.cumsum(size + 1) - size - 1, size)] = data[_spread(start, size)]
    return out.tobytes()


def _match(window: int, run_words: int):
    """The first document of each window of the stretches sent to a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by(batches, "shard"):
            document, sizes = _joined(table, "documents", np.int64)
            length = _joined(table, "sizes", "<u4")[0].astype(np.int64)
            texts = [pa.decompress(t[8:], int.from_bytes(t[:8], "little"), "zstd", asbytes=True).decode() for t in table.column("text").to_pylist()]
            words = np.concatenate([arrow_text.words(pa.array([t]), arrow_text.SPACED, lower=False).hash for t in texts])
            firsts = _first_documents(words, document, length, window, run_words)
            ends = np.concatenate(([0], np.cumsum(length - window + 1)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
            replies = [firsts[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("path").combine_chunks(), table.column("shard").combine_chunks(), pa.array(replies, pa.binary())], ["path", "shard", "firsts"])

    return run


def _first_documents(words: np.ndarray, document: np.ndarray, length: np.ndarray, window: int, run_words: int) -> np.ndarray:
    """For each window of each stretch (``length`` of the words, of a document) the first document with it."""
    start = np.cumsum(length) - length
    key = _least(_grams(words, window), window - min(GRAM, window) + 1)[start]  # that of all the stretch's windows
    value = _hashes(words, start, length)
    order = np.lexsort((document, length, value, key))
    new = _changes(key[order], value[order], length[order])
    copy_of = np.empty(len(order), np.int64)
    copy_of[order] = np.cumsum(new) - 1  # copies of one stretch fold to the first
    words = np.unique(words, return_inverse=True)[1]
    one = order[new]
    by_document = np.lexsort((document[one], key[one]))
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(one)
    automaton, held = Automaton(), 0
    ordered = one[by_document]
    more = np.append(key[ordered][1:] == key[ordered][:-1], False).tolist()  # whether a stretch of this key follows
    for i, s, n, d, follows in zip(by_document.tolist(), start[ordered].tolist(), length[ordered].tolist(), document[ordered].tolist(), more, strict=True):
        numbers = words[s : s + n].tolist()
        first = np.array(automaton.stream(numbers, window), np.int64)
        found[i] = np.where(first < 0, d, first)
        if follows and first.min() < 0:
            automaton.add(numbers, d)
            held += n
        elif not follows and held > run_words:
            automaton, held = Automaton(), 0
    return np.concatenate([found[i] for i in copy_of.tolist()]) if len(one) else np.zeros(0, np.int64)


def _remove(shards: int, window: int, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by(batches, "path"):
            piece = _load(table.column("path")[0].as_py())
            data = arrow_text.buffers(piece.column("text"))[0]
            found = arrow_text.words(piece.column("text"), arrow_text.SPACED, lower=False)
            marks = np.zeros(len(found.hash) + 1, np.int64)
            codes = _joined(table, "codes", np.uint8)[0].astype(np.int64)
            if codes.any():
                own, _, new = _asking(piece, codes, found, shards, window)
                firsts, windows = _joined(table, "firsts", np.int64)[0], own.windows[new]
                begin = (np.cumsum(windows) - windows)[np.cumsum(new) - 1]
                start = _spread(own.first, own.windows)
                earlier = start[firsts[_spread(begin, own.windows)] < np.repeat(own.document, own.windows)]
                marks[:-1] += np.bincount(earlier, minlength=len(found.hash))
                marks -= np.bincount(earlier + window, minlength=len(marks))
            gone = np.cumsum(marks[:-1]) > 0
            texts = _kept(data, found, gone)
            lengths = found.counts()
            spans = _spans(gone, found.row, lengths)
            row = piece.column("row")
            kept = pa.StructArray.from_arrays([texts if c == text else row.field(c) for c in names], names) if text in names else row
            details = pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), spans], ["n_words", "spans"])
            yield pa.RecordBatch.from_arrays([kept, details], ["row", "found"])

    return run


def _kept(data: np.ndarray, found: arrow_text.Words, gone: np.ndarray) -> pa.Array:
    """Each row's words that stay, joined by one space."""
    start, end, row = found.start[~gone], found.end[~gone], found.row[~gone]
    wide = end - start + 1
    bytes_ = np.frombuffer(_spaced(data, start, end), np.uint8)
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, wide, minlength=found.rows)))).astype(np.int64)
    keep = np.ones(len(bytes_), bool)
    keep[ends[1:][np.diff(ends) > 0] - 1] = False  # no space after a row's last word
    offsets = ends - np.concatenate(([0], np.cumsum(np.diff(ends) > 0)))
    return pa.LargeStringArray.from_buffers(found.rows, pa.py_buffer(offsets), pa.py_buffer(bytes_[keep])).cast(pa.string())


def _spans(gone: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Maximal removed spans of each row as word numbers start, end, start, end, ..."""
    edge = np.ones(len(gone) + 1, bool)
    edge[1:-1] = row[1:] != row[:-1]
    opens = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))[: len(gone)]))
    closes = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False]))[: len(gone)])) + 1
    first = (np.cumsum(lengths) - lengths)[row[opens]]
    values = np.stack((opens - first, closes - first), 1).ravel()
    offsets = np.concatenate(([0], np.cumsum(2 * np.bincount(row[opens], minlength=len(lengths)))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType()))])


def remove_repeats(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run_words: int = RUN_WORDS, hot_words: int = HOT_WORDS
) -> DataFrame:
    """Every given row as ``row``, its text without the words of repeated windows, and ``found``: n_words, spans.

    A word goes if it lies in a window of ``window`` words that also starts in a row with a smaller ``doc_id``;
    windows are judged on the input. The words that stay are joined by one space. ``spans`` has the
    maximal removed runs as word numbers (start, end, start, end, ...).

    NULL, empty and white-space texts have no words and come back empty. Rows without id come after all
    others and never take words from each other; nor do rows of one id. Repeated rows are each judged.
    Texts of any length are worked whole (a longer text is a piece of its own). An empty table gives no
    rows. Given columns keep their names inside ``row``. Words are known by 64-bit hashes.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-size // SHARD_BYTES))
    folder = scratch_path(spark, "pieces")
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    rows = documents.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("_id"))
    asked = materialise(rows.mapInArrow(_cut(folder, text, shards, window), _ASK), "asked")
    dealt = lambda df, *by: df.repartition(max(parts, shards), by[0]).sortWithinPartitions(*by)
    codes = dealt(asked.where("shard >= 0"), "shard", "path").mapInArrow(_answer(window, hot_words), "path string, shard long, codes binary")
    codes = materialise(codes, "codes")
    sent = dealt(codes, "path", "shard").mapInArrow(_send(shards, window), _SEND)
    firsts = dealt(sent, "shard", "path").mapInArrow(_match(window, run_words), "path string, shard long, firsts binary")
    none = F.lit(None).cast("binary")
    each = asked.where("shard < 0").select("path", "shard", none.alias("codes"), none.alias("firsts"))
    each = each.unionByName(codes.withColumn("firsts", none)).unionByName(firsts.withColumn("codes", none))
    schema = T.StructType([rows.schema["row"], T.StructField("found", _FOUND)])
    return dealt(each, "path", "shard").mapInArrow(_remove(shards, window, documents.columns, text), schema)


def removed_words(spans: Column) -> Column:
    """Words covered by spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: x - total)


def report(documents: DataFrame, doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per given row: doc_id, n_words, n_removed, kept_sha256."""
    found = remove_repeats(documents.select(doc_id, "text"), doc_id, "text", window)
    return found.select(
        F.col(f"row.{doc_id}").alias(doc_id), F.col("found.n_words").alias("n_words"), removed_words(F.col("found.spans")).alias("n_removed"),
        F.sha2(F.col("row.text").cast("binary"), 256).alias("kept_sha256"),
    )
