"""SimHash near-duplicates: a byte-position inverted index, count filtering, verification, components.

Fingerprints of 64 bits at most ``bits`` apart differ in at most ``bits`` of their 8 positional bytes, so
they share at least 8 - bits of them: the guaranteed minimum. The index therefore posts every distinct
fingerprint under each set of that many positional bytes, which no linked pair can miss, and a list holds
only fingerprints that already reach the minimum. Inside a list the shared positional bytes of a pair are
tallied, pairs below the minimum (key collisions) fall out, and the rest is verified by differing bits.

Copies with equal fingerprints are folded to one before indexing. Lists stream through tasks sorted by
key; a list of many close fingerprints never has its pairs written out: a task keeps a spanning forest of
the links it has verified, and a list beyond ``LIST_PAIRS`` fingerprints is linked through half-way values,
which takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barriometrics.llm import arrow_text
from barriometrics.llm.graph import components
from barriometrics.session import materialise, scratch_path

SHINGLE = 4
BITS = 4
SEED = 42
#: Lists up to this length are compared pair by pair inside the task; longer ones by half-way values.
LIST_PAIRS = 8192
_STEP = 65_536


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, by lanes of eight counters in one word."""
    lanes = np.uint64(0x0101010101010101)
    counts = np.zeros((8, 8), np.int64)
    for a in range(0, len(hashes), 255):
        part = hashes[a : a + 255]
        for b in range(8):
            total = ((part >> np.uint64(b)) & lanes).sum(dtype=np.uint64)
            counts[:, b] += np.array([total], np.uint64).view(np.uint8)
    return counts.ravel()


def _shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    joined = b" ".join(text.lower().split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    size = min(shingle, len(starts))
    starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(starts), _STEP):
        spans = zip(starts[a : a + _STEP].tolist(), ends[a : a + _STEP].tolist(), strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text's bytes: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    votes, shingles = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text, shingle):
        shingles += len(hashes)
        votes += _bit_counts(hashes)
    return int(np.packbits(2 * votes > max(1, shingles), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """Every given row: ``row`` (a struct of the ``carry`` columns, all by default), ``fingerprint`` (a signed long), ``rid``.

    ``rid`` numbers the rows of this run; write the table before using it twice. NULL, empty and
    white-space texts have fingerprint 0; repeated rows each have theirs.
    """
    if carry:
        out = documents.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    else:
        out = documents.select(F.struct("*").alias("row"))
    schema = T.StructType([out.schema["row"], T.StructField("fingerprint", T.LongType()), T.StructField("rid", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece, texts in _texts(arrow_text.with_text(batch, text)):
                prints = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("row"), prints, pa.array(np.arange(rid, rid + len(prints)))], schema.names)
                rid += len(prints)

    return out.mapInArrow(mark, schema)


def posting_masks(bits: int = BITS) -> list[int]:
    """Which positional bytes make the keys: every set of 8 - bits of them, as signed 64-bit masks."""
    sets = combinations(range(8), 8 - bits)
    masks = (sum(0xFF << (8 * p) for p in chosen) for chosen in sets)
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints at most ``bits`` apart into the right components.

    ``prints`` has distinct longs in ``fingerprint``. Within a task a spanning forest stands for the pairs.
    """
    masks = posting_masks(bits)
    keys = F.array(*[F.xxhash64(F.col("fingerprint").bitwiseAND(F.lit(m)), F.lit(j)) for j, m in enumerate(masks)])
    posted = prints.select("fingerprint", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate((held_key, batch.column("key").to_numpy(zero_copy_only=False)))
            value = np.concatenate((held, batch.column("fingerprint").to_numpy(zero_copy_only=False)))
            cut = np.searchsorted(key, key[-1], "left") if len(key) else 0  # the last list may go on
            held_key, held = key[cut:], value[cut:]
            if cut:
                yield _forest(*_list_pairs(key[:cut], value[:cut], bits))
        if len(held):
            yield _forest(*_list_pairs(held_key, held, bits))

    return posted.select("key", "fingerprint").mapInArrow(search, "a long, b long").distinct()


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Pairs that share the guaranteed positional bytes and differ in few enough bits."""
    apart = (a ^ b).view(np.uint64)
    near = np.bitwise_count(apart) <= bits
    shared = (apart[near].view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near[near] = shared >= 8 - bits
    return near


def _list_pairs(key: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside the lists of a sorted run of keys."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, min(int(sizes.max()), 64)):
        a = np.flatnonzero(key[step:] == key[:-step])
        if not len(a):
            break
        near = _close(value[a], value[a + step], bits)
        found.append((value[a[near]], value[a[near] + step]))
    for i in np.flatnonzero(sizes > 64):
        group = value[starts[i] : starts[i] + sizes[i]]
        found += [_forest_arrays(*p) for p in (_block_pairs(group, bits) if len(group) <= LIST_PAIRS else _halfway_links(group, bits))]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _block_pairs(group: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(group), 256):
        part = group[a : a + 256]
        apart = np.bitwise_count((part[:, None] ^ group[None, a:]).view(np.uint64)) <= bits
        x, y = np.nonzero(apart)
        keep = x < y
        yield part[x[keep]], group[a + y[keep]]


def _halfway_links(group: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a long list in time linear in its length.

    Two values at most ``bits`` apart have a value between them that is at most bits // 2 from one and the
    rest from the other; and two values that reach a common one with at most ``bits`` changes together are
    linked. So sorting all values within half the distance, and linking those that meet, finds all links.
    """
    free = int(np.bitwise_or.reduce((group ^ group[0]).view(np.uint64)))
    places = [1 << p for p in range(64) if free >> p & 1]
    near, far = bits // 2, bits - bits // 2
    masks = np.array([sum(c) for n in range(far + 1) for c in combinations(places, n)], np.uint64)
    close = np.array([bin(int(m)).count("1") <= near for m in masks])
    values = group.view(np.uint64)
    blocks = max(1, len(group) * len(masks) // (4 << 20))
    spread = np.uint64(0x9E3779B97F4A7C15)
    for block in range(blocks):
        mids, owners, nears = [], [], []
        for mask, is_near in zip(masks, close, strict=True):
            mid = values ^ mask
            mine = np.flatnonzero(((mid * spread) >> np.uint64(33)) % np.uint64(blocks) == block)
            mids.append(mid[mine])
            owners.append(mine)
            nears.append(np.full(len(mine), is_near))
        mid, owner, is_near = np.concatenate(mids), np.concatenate(owners), np.concatenate(nears)
        order = np.lexsort((~is_near, mid))
        mid, owner, is_near = mid[order], owner[order], is_near[order]
        first = np.flatnonzero(np.concatenate(([True], mid[1:] != mid[:-1])))
        lead = np.repeat(first, np.diff(np.append(first, len(mid))))
        joined = is_near[lead] & (lead != np.arange(len(mid)))  # where none is near, two far ones may be too far apart
        yield group[owner[lead[joined]]], group[owner[joined]]


def _forest_arrays(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value of its group) for the same groups."""
    if not len(a):
        return a, b
    values, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    other = label != np.arange(len(values))
    return values[other], values[label[other]]


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = _forest_arrays(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _component_table(
    documents: DataFrame, doc_id: str, text: str, shingle: int, bits: int, carry: list[str] | None
) -> tuple[DataFrame, DataFrame]:
    """The written rows with their fingerprints, and (fingerprint, component_id, keeper) of every distinct fingerprint."""
    prints = materialise(fingerprints(documents, text, shingle, carry), "fingerprints")
    own = F.struct(F.col("row")[doc_id].isNull().alias("none"), F.col("row")[doc_id].alias("id"), "rid")
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min(own).alias("low")), "distinct-fingerprints")
    joined = components(materialise(links(distinct.select("fingerprint"), bits), "links"))
    known = distinct.join(joined, distinct["fingerprint"] == joined["node"], "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")
    )
    lowest = known.groupBy("root").agg(F.min("low").alias("lowest"))
    table = known.join(lowest, "root").select("fingerprint", F.col("lowest.id").alias("component_id"), F.col("lowest.rid").alias("keeper"))
    return prints, materialise(table, "components")


def groups(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, carry: list[str] | None = None
) -> DataFrame:
    """Every given row with its group: ``row``, ``fingerprint`` (long), ``component_id``, ``kept``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own included; rows without
    doc_id take part and have the smallest known one of their group (NULL if there is none). ``kept`` is
    true for one row of each group: one with that doc_id. The fingerprints are written once to the shared
    folder, with the ``carry`` columns (all by default) as ``row``.
    """
    prints, table = _component_table(documents, doc_id, text, shingle, bits, carry)
    return prints.join(table, "fingerprint").select("row", "fingerprint", "component_id", (F.col("rid") == F.col("keeper")).alias("kept"))


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def report(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per given row."""
    found = groups(documents.select(doc_id, "text"), doc_id, carry=[doc_id])
    return found.select(F.col("row")[doc_id].alias(doc_id), hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    for piece in arrow_text.pieces(batch, "text"):
        data, offsets = arrow_text.buffers(piece.column("text"))
        raw = memoryview(data)
        yield piece, (raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))


def _choice(spark: SparkSession, kept: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Filters batches to the rows whose ``rid`` is among those of ``kept``, without moving the rows.

    A rid holds the number of the task that wrote the row. The kept numbers are written in a folder for
    each such task, and whoever reads a task's rows reads its folder: a few bytes for each row, no shuffle
    of the texts.
    """
    folder = scratch_path(spark, "kept")
    numbers = kept.select(F.shiftright("rid", 33).alias("task"), F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)).alias("number"))
    numbers.repartition("task").sortWithinPartitions("task").write.partitionBy("task").parquet(folder)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            keep = np.zeros(len(rid), bool)
            for task in np.unique(rid >> 33).tolist():
                if task not in known:
                    known = {task: _numbers(system, f"{place}/task={task}")}
                mine = rid >> 33 == task
                keep[mine] = np.isin(rid[mine] & ((1 << 33) - 1), known[task])
            yield batch.filter(pa.array(keep))

    return choose


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose ``rid`` is among those of ``kept``."""
    return rows.mapInArrow(_choice(rows.sparkSession, kept), rows.schema)


def _numbers(system: fs.FileSystem, place: str) -> np.ndarray:
    files = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
    tables = [parquet.read_table(f.path, filesystem=system, columns=["number"], partitioning=None) for f in files if f.path.endswith(".parquet")]
    return np.concatenate([t.column("number").to_numpy() for t in tables]) if tables else np.zeros(0, np.int64)


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each group of ``groups``, the one with the smallest doc_id, with the columns it came with.

    Rows without doc_id give way to any row that has one. Texts aren't shuffled: each task's written rows are
    filtered where they lie.
    """
    prints, table = _component_table(documents, doc_id, text, shingle, bits, None)
    rows = _only(prints.select("row", "rid"), table.select(F.col("keeper").alias("rid")).distinct())
    return rows.select(*[F.col("row")[c].alias(c) for c in documents.columns])
