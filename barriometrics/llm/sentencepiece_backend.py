"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed, and its normaliser, word marker, scores and byte fallback are rebuilt
as a tokenizers-library tokenizer: a unigram model from the pieces' scores, or a BPE model whose merges
are the splits of each piece into two pieces, in the order of the pieces' scores. No piece may hold a
marker after another character for words to be encoded one by one; otherwise whole texts are. New words
are encoded in multithreaded batches, and every text is held against the original library.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Regex, models, normalizers, pre_tokenizers

from barriometrics.llm import arrow_text
from barriometrics.llm.encoders import CACHE_WORDS, joined, remember, whole
from barriometrics.llm.model_file import BPE, BYTE, CONTROL, UNKNOWN, ModelFile

MARKER = "▁"
THREADS = 2


def build(model: ModelFile) -> tokenizers.Tokenizer:
    """The tokenizer of a parsed model file."""
    if model.model_type == BPE:
        ids = {p: i for i, p in enumerate(model.pieces)}
        usable = {p for p, t in zip(model.pieces, model.types, strict=True) if t not in (CONTROL, UNKNOWN, BYTE)}
        ranked = sorted((i for i, p in enumerate(model.pieces) if p in usable and len(p) > 1), key=lambda i: (-model.scores[i], i))
        merges = [(p[:k], p[k:]) for p in (model.pieces[i] for i in ranked) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE(vocab=ids, merges=merges, unk_token=model.pieces[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), model.unk_id, model.byte_fallback)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    built = tokenizers.Tokenizer(core)
    if steps:
        built.normalizer = normalizers.Sequence(steps)
    return built


class Backend:
    """Encodes and decodes texts (UTF-8 bytes); ids are numpy arrays."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = ModelFile.read(path)
        self.tokenizer = build(self.model)
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.by_word = (
            m.add_dummy_prefix and m.escape_whitespaces and not m.remove_extra_whitespaces and not m.charsmap
            and not any(MARKER in p.lstrip(MARKER) for p in m.pieces)
        )
        self.split = build(self.model)  # for words joined by single spaces
        self.split.pre_tokenizer = pre_tokenizers.Split(MARKER, "merged_with_next")
        self.cache: dict[bytes, bytes] = {}
        self.bytes_of = [self._bytes(i) for i in range(len(m.pieces))]

    def _bytes(self, i: int) -> bytes:
        kind, piece = self.model.types[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARKER, " ").encode()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split: list[list[bytes] | None] = []
        for text in texts:
            words = text.split(b" ") if text and self.by_word and MARKER.encode() not in text else None
            split.append(_spaced(words) if words and b"" in words else words)  # runs of spaces stay with the word behind them
        words = list(chain.from_iterable(w for w in split if w))
        found = list(map(self.cache.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = self._new(list(dict.fromkeys([words[i] for i in missing])))
            for i in missing:
                found[i] = new[words[i]]
            remember(self.cache, new, CACHE_WORDS)
        out, at = [], 0
        for text, own in zip(texts, split, strict=True):
            if own is None:
                out.append(np.frombuffer(whole(self.tokenizer, text.decode()) if text else b"", "<u4"))
            else:
                out.append(np.frombuffer(b"".join(found[at : at + len(own)]), "<u4"))
                at += len(own)
        return out

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if w and b" " not in w]
        new = dict(zip(plain, joined(self.split, [w.decode() for w in plain]), strict=True))
        new.update((w, whole(self.tokenizer, w.decode())) for w in words if b" " in w)
        new[b""] = np.array([self.model.pieces.index(MARKER)], "<u4").tobytes()
        return new

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join([self.bytes_of[i] for i in ids.tolist()])
        return text[1:] if self.model.add_dummy_prefix and text[:1] == b" " else text


def _spaced(words: list[bytes]) -> list[bytes]:
    """Words with the further spaces before them; trailing spaces are a last word of spaces."""
    out, spaces = [], b""
    for word in words:
        if word:
            out.append(spaces + word)
            spaces = b""
        else:
            spaces += b" "
    return [*out, spaces[1:]] if spaces else out


@lru_cache(maxsize=2)
def backend(path: str, threads: int) -> Backend:
    """One backend for each worker process and file."""
    return Backend(path, threads)


def encode(documents: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, ids: bool = True, threads: int = THREADS) -> DataFrame:
    """Every given row as ``row`` (a struct of the ``carry`` columns, all by default) with ``encoded``.

    ``encoded``: ids (left out unless asked for), n_tokens, ids_crc32 of them as little-endian unsigned
    32-bit integers, parity (the original library gives the same ids), round_trip (decoding gives the
    text back). NULL and empty texts have no ids; both checks hold for them. Repeated rows each count.
    Ids that the original library gives otherwise are replaced by its own.
    """
    row = F.struct(*carry) if carry else F.struct("*")
    out = documents.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())]
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + fields
    schema = T.StructType([out.schema["row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = backend(path, threads)
        for batch in batches:
            for piece in arrow_text.pieces(batch, "text", 4 << 20):
                data, offsets = arrow_text.buffers(piece.column("text"))
                raw = memoryview(data)
                found: list[np.ndarray] = []
                parity, trips = [], []
                texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                for body, got in zip(texts, tools.encode(texts), strict=True):
                    wanted = np.array(tools.original.encode(body.decode()), np.uint32)
                    parity.append(np.array_equal(got, wanted))
                    found.append(got if parity[-1] else wanted)
                    trips.append(tools.decode(found[-1]) == body)
                sizes = np.array([len(x) for x in found], np.int64)
                columns = [
                    pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array(parity, pa.bool_()), pa.array(trips, pa.bool_()),
                ]
                if ids:
                    flat = np.concatenate(found).astype(np.int32)
                    columns.insert(0, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([piece.column("row"), *columns], schema.names)

    return out.mapInArrow(run, schema).select("row", F.struct(*[f.name for f in fields]).alias("encoded"))


def report(documents: DataFrame, path: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip, one row per given row."""
    found = encode(documents, path, carry=[doc_id], ids=False)
    return found.select(F.col("row")[doc_id].alias(doc_id), "encoded.*")
