"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive rows in id order. Ids are cut into blocks of ``BLOCK``; a block stores
its minimum, the differences packed at a width that ``PERCENTILE`` of them fit, and a list of exceptions
(place, whole difference) for the rest. The footer holds where each block starts and the rows' lengths
and ids, so a reader can go to any row. All numbers are little-endian.

    file     b"PFOR" version(u4) blocks... footer footer_bytes(u8) b"PFOR"
    block    minimum(u4) ids(u4) exceptions(u4) width(u4) packed(bytes) places(u4...) differences(u4...)
    footer   blocks(u8) rows(u8) ids(u8) starts(u8...) lengths(u8...) doc_ids(i8...) known(u1...)

Tasks write files of their own under a fresh name to the shared folder and report them; only reported
files are read, so a lost or repeated task leaves at most an unread file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from barriometrics.llm import arrow_text
from barriometrics.llm.encoders import encoder
from barriometrics.session import materialise, scratch_path

BLOCK = 4096
PERCENTILE = 95
FILE_IDS = 8 << 20
MAGIC, VERSION = b"PFOR", 1
_AT_ONCE = 128  # blocks packed together


def _widths(deltas: np.ndarray) -> np.ndarray:
    return np.frexp(deltas.astype(np.float64))[1].astype(np.int64)  # bits of each; 0 for 0


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Encoded blocks of the ids; all but the last hold ``BLOCK`` of them."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    for a in range(0, whole, BLOCK * _AT_ONCE):
        out += _pack_equal(ids[a : min(whole, a + BLOCK * _AT_ONCE)].reshape(-1, BLOCK), percentile)
    if whole < len(ids):
        out += _pack_equal(ids[None, whole:], percentile)
    return out


def _pack_equal(rows: np.ndarray, percentile: int) -> list[bytes]:
    count = rows.shape[1]
    low = rows.min(1)
    deltas = (rows - low[:, None]).astype(np.uint32)
    need = _widths(deltas)
    width = np.sort(need, 1)[:, max(0, -(-count * percentile // 100) - 1)]
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        bits = np.empty((len(same), count, int(w)), np.uint8)
        for b in range(int(w)):
            bits[:, :, b] = deltas[same] >> np.uint32(b) & np.uint32(1)
        packed = np.packbits(bits.reshape(len(same), -1), axis=1, bitorder="little")
        for k, i in enumerate(same):
            places = np.flatnonzero(need[i] > w)
            head = struct.pack("<4I", int(low[i]), count, len(places), int(w))
            out[i] = head + packed[k].tobytes() + places.astype("<u4").tobytes() + deltas[i, places].astype("<u4").tobytes()
    return out


def unpack(blocks: list[bytes]) -> np.ndarray:
    """The ids of encoded blocks, joined."""
    heads = np.array([struct.unpack_from("<4I", b) for b in blocks], np.int64).reshape(-1, 4)
    starts = np.concatenate(([0], np.cumsum(heads[:, 1])))
    out = np.empty(starts[-1], np.uint32)
    kinds, kind = np.unique(heads[:, [1, 3]], axis=0, return_inverse=True)
    for k, (count, w) in enumerate(kinds.tolist()):
        same = np.flatnonzero(kind.reshape(-1) == k)
        size = -(-count * w // 8)
        for a in range(0, len(same), _AT_ONCE):
            part = same[a : a + _AT_ONCE]
            packed = np.frombuffer(b"".join(blocks[i][16 : 16 + size] for i in part), np.uint8).reshape(len(part), size)
            bits = np.unpackbits(packed, axis=1, bitorder="little", count=count * w).reshape(len(part), count, w)
            values = np.zeros((len(part), count), np.uint32)
            for b in range(w):
                values |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            for row, i in zip(values, part, strict=True):
                n = int(heads[i, 2])
                places, wide = np.frombuffer(blocks[i], "<u4", 2 * n, 16 + size).reshape(2, n)
                row[places] = wide
                out[starts[i] : starts[i + 1]] = row + np.uint32(heads[i, 0])
    return out


class FileWriter:
    """Streams rows' ids into one file; memory follows the waiting block run and the row table."""

    def __init__(self, path: str, percentile: int = PERCENTILE):
        system, place = fs.FileSystem.from_uri(path)
        self.stream = system.open_output_stream(place)
        self.stream.write(MAGIC + struct.pack("<I", VERSION))
        self.at, self.waiting, self.held, self.percentile = 8, [], 0, percentile
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.doc_ids: list[int | None] = []
        self.ids = 0

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in pack(ids[:cut], self.percentile):
            self.starts.append(self.at)
            self.stream.write(block)
            self.at += len(block)
        self.waiting, self.held = [ids[cut:]], len(ids) - cut

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK * _AT_ONCE:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        doc_ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        footer = struct.pack("<3Q", len(self.starts), len(self.lengths), self.ids)
        footer += np.array(self.starts, "<u8").tobytes() + np.array(self.lengths, "<u8").tobytes() + doc_ids.tobytes() + known.tobytes()
        self.stream.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.stream.close()


class FileReader:
    """Rows of one file, from any row on, reading a bounded run of blocks at a time."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        (footer_bytes,) = struct.unpack("<Q", tail[:8])
        self.end = size - 12 - footer_bytes
        footer = self.file.read_at(footer_bytes, self.end)
        blocks, rows, self.ids = struct.unpack_from("<3Q", footer)
        arrays = np.frombuffer(footer, "<u8", blocks + 2 * rows, 24)
        self.starts, self.lengths, self.doc_ids = arrays[:blocks], arrays[blocks : blocks + rows].astype(np.int64), arrays[blocks + rows :].view("<i8")
        self.known = np.frombuffer(footer, np.uint8, rows, 24 + 8 * (blocks + 2 * rows)).astype(bool)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))

    def _blocks(self, first: int, last: int) -> np.ndarray:
        bounds = np.append(self.starts, self.end).astype(np.int64)[first : last + 1]
        data = self.file.read_at(int(bounds[-1] - bounds[0]), int(bounds[0]))
        cuts = (bounds - bounds[0]).tolist()
        return unpack([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def rows(self, first: int = 0) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each row."""
        row, held, held_at = first, np.zeros(0, np.uint32), int(self.offsets[first] // BLOCK * BLOCK)
        while row < len(self.lengths):
            a, b = int(self.offsets[row]), int(self.offsets[row + 1])
            if b > held_at + len(held):
                keep = held[max(0, a - held_at) :] if a < held_at + len(held) else np.zeros(0, np.uint32)
                block = (held_at + len(held)) // BLOCK
                more = max(_AT_ONCE, -(-(b - held_at - len(held)) // BLOCK))
                read = self._blocks(block, min(len(self.starts), block + more))
                held_at, held = block * BLOCK - len(keep), np.concatenate((keep, read))
            yield (int(self.doc_ids[row]) if self.known[row] else None), a, held[a - held_at : b - held_at]
            row += 1


def write_token_files(documents: DataFrame, path: str, folder: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every row's whole text and write its ids, in ascending doc_id order over all files.

    Rows without id come first; rows of one id are ordered by a hash of the text. NULL texts are empty and
    have the end id alone. Returns the manifest: partition, number, path, n_rows, n_ids, a row for each file.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
    end = np.array([end_id], np.uint32) if end_id is not None else np.zeros(0, np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, writer, name, number = TaskContext.get().partitionId(), None, "", 0

        def done() -> pa.RecordBatch:
            writer.close()
            row = {"partition": partition, "number": number, "path": name, "n_rows": len(writer.lengths), "n_ids": writer.ids}
            return pa.RecordBatch.from_pylist([row], _MANIFEST)

        for batch in batches:
            for piece in arrow_text.pieces(batch, "text", 4 << 20):
                ids, ends = encoder(path).encode_rows(piece.column("text"))
                for key, a, b in zip(piece.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if writer is None:
                        name = f"{folder}/tokens-{partition:05d}-{number:05d}-{uuid.uuid4().hex}.pfor"
                        writer = FileWriter(name)
                    writer.add(key, np.concatenate((ids[a:b], end)))
                    if writer.ids >= FILE_IDS:
                        yield done()
                        writer, number = None, number + 1
        if writer is not None:
            yield done()

    fs_, place = fs.FileSystem.from_uri(folder)
    fs_.create_dir(place, recursive=True)
    return materialise(rows.select("id", "text").mapInArrow(write, "partition long, number long, path string, n_rows long, n_ids long"), "manifest")


_MANIFEST = pa.schema([("partition", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_ids", pa.int64())])


def read_digests(manifest: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored row, read back from the files.

    The running start over files is taken over the manifest, a row for each file.
    """
    order = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    files = files.select("path", "before").repartition(max(1, manifest.count()))  # a task for each file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                found = [(i, before + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, a, ids in FileReader(name).rows()]
                columns = [pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, f"`{doc_id}` long, start long, n_tokens long, ids_crc32 long")


def report(documents: DataFrame, path: str, end_id: int = 1, folder: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Write every row's ids to files and describe them from there: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or scratch_path(documents.sparkSession, "tokens")
    return read_digests(write_token_files(documents, path, folder, end_id, doc_id), doc_id)
