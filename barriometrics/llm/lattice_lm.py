"""Subword lattice likelihood: the probability of a text over all its segmentations into known pieces.

The vocabulary is that of an existing subword model file (pieces and byte fallback). Its stored scores
order the pieces but are no probabilities, so they only start the weights, which are then fitted to the
distinct training words by expected counts (forward and backward over every word's lattice, in Spark
tasks; the driver gets one number for each piece). A text is its words, each behind a word marker, and an
end; no piece spans a marker, so the forward recursion over a text is a product over its words, and each
distinct word's marginal is computed once where it is met.

A word seen in training is one more arc over its whole length: it has its count less a discount, and the
discounts together are the weight of the subword arcs. Pieces alone forget which words are frequent.

A text is of one of a few kinds, which are the values of a column such as the language among the training
rows (the ``KINDS`` - 1 most frequent, all others together). Each kind k has its own word counts, and its discounts go to
words of any kind and to the subword arcs, in the shares in which words met once in k are known elsewhere or new:
P(w | k) = (c_k - d_k) / N_k + (d_k V_k / N_k) * ((1 - g_k) c / C + g_k * sum over segmentations of the products of
piece weights), where the first term is for words of k only. With the end's share the probabilities of all words sum
to one. The kind of the text to be scored is not read: its probability is the sum over all kinds of the kind's share of
the training rows times the product over its words.

Beside the marginal there is the add-one unigram base over words, whose counts are joined to the texts.
The most frequent words, at most ``HEAD_WORDS``, go to every task; the others, rare by construction, meet their
counts in a shuffle, so a word that fills a third of the corpus is never a join key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barriometrics.llm import arrow_text
from barriometrics.llm.model_file import ModelFile
from barriometrics.session import materialise

HEAD_WORDS = 300_000
ROUNDS = 2
#: Kinds of texts at most; texts of all further values are one kind.
KINDS = 16
#: Added to the expected count of each piece, so that none has probability zero.
FLOOR = 0.01
MARKER = "▁".encode()
_BLOCK = 400_000  # bytes of words worked on at once


def training(doc_id: Column) -> Column:
    """Rows to learn from; a row without id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


@dataclass
class Pieces:
    """Pieces as byte strings, found by hash of length and bytes; ``log_p`` are natural logarithms.

    Byte b without the marker is piece ``single[b]``; every string of bytes has a segmentation.
    """

    hashes: np.ndarray
    order: np.ndarray
    longest: int
    log_p: np.ndarray

    @staticmethod
    def of(model: ModelFile) -> Pieces:
        texts = dict.fromkeys([MARKER, *(bytes([b]) for b in range(256))])
        score = {}
        for piece, rank in model.normal_pieces():
            body = piece.encode()
            texts[body] = None
            score[body] = rank
        # texts are lower-cased first, so no piece with A-Z can be used
        texts = [t for t in texts if t == arrow_text.LOWER[np.frombuffer(t, np.uint8)].tobytes() and MARKER not in t[1:]]
        hashes = np.array([arrow_text.bytes_hash(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        weight = np.array([1.0 / (10 + max(0.0, -score.get(t, -1e6))) for t in texts])
        return Pieces(hashes[order], order, max(map(len, texts)), np.log(weight / weight.sum()))

    def with_counts(self, counts: np.ndarray) -> Pieces:
        counts = counts + FLOOR
        return Pieces(self.hashes, self.order, self.longest, np.log(counts / counts.sum()))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for none."""
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[near] == hashes, self.order[near], -1)


def _arcs(pieces: Pieces, block: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, words, pieces) of all lattice arcs of words of one length, by end."""
    values, powers, back = arrow_text._powers()
    n, length = block.shape
    sums = np.zeros((length + 1, n), np.uint64)
    np.cumsum(values[block.T] * powers[:length, None], axis=0, out=sums[1:])
    for end in range(1, length + 1):
        for start in range(max(0, end - pieces.longest), end):
            number = pieces.find(arrow_text._mixed((sums[end] - sums[start]) * back[start]))
            which = np.flatnonzero(number >= 0)
            if len(which):
                yield start, end, which, number[which]


def _forward(pieces: Pieces, block: np.ndarray, kept: list | None = None) -> np.ndarray:
    """Log-space forward values (position, word) of words of one length."""
    n, length = block.shape
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0.0
    for start, end, which, number in _arcs(pieces, block):
        if kept is not None:
            kept.append((start, end, which, number))
        alpha[end, which] = np.logaddexp(alpha[end, which], alpha[start, which] + pieces.log_p[number])
    return alpha


def _by_length(words: list[bytes] | np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of words of equal length, in bounded blocks."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if len(same):
            step = max(1, _BLOCK // (int(lengths[same[0]]) + 3))
            for a in range(0, len(same), step):
                yield same[a : a + step]


def _block(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The words as a byte matrix, each behind the marker."""
    body = data[start[:, None] + np.arange(length)]
    return np.concatenate((np.broadcast_to(np.frombuffer(MARKER, np.uint8), (len(start), 3)), body), 1)


def _long_arcs(pieces: Pieces, data: np.ndarray, a: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of one stretch of a long word, and by end and start (the nearest last) piece numbers, -1 for none, and log weights."""
    values, powers, back = arrow_text._powers()
    low = max(0, a - pieces.longest)
    part = data[low : a + step]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
    ends = np.arange(a + 1, min(a + step, len(data)) + 1)
    numbers = np.full((len(ends), pieces.longest), -1)
    for size in range(1, pieces.longest + 1):
        fits = ends - size >= 0
        e = ends[fits] - low
        numbers[fits, pieces.longest - size] = pieces.find(arrow_text._mixed((sums[e] - sums[e - size]) * back[e - size]))
    return ends, numbers, np.where(numbers >= 0, pieces.log_p[numbers], -np.inf)


def _long_word(pieces: Pieces, word: bytes) -> float:
    """Forward recursion over one very long word, keeping only as many values as the longest piece."""
    data = np.frombuffer(MARKER + word, np.uint8)
    recent = np.full(pieces.longest, -np.inf)
    recent[-1] = 0.0
    for a in range(0, len(data), _STRETCH):
        for row in _long_arcs(pieces, data, a, _STRETCH)[2]:
            total = np.logaddexp.reduce(recent + row)
            recent[:-1] = recent[1:]
            recent[-1] = total
    return float(recent[-1])


def _long_counts(pieces: Pieces, word: bytes) -> np.ndarray:
    """Expected piece counts of one very long word: forward and backward values of all positions, arcs by stretches."""
    data, wide = np.frombuffer(MARKER + word, np.uint8), pieces.longest
    alpha = np.full(wide + len(data), -np.inf)  # position p is at wide - 1 + p, so that no start lies before the array
    alpha[wide - 1] = 0.0
    for a in range(0, len(data), _STRETCH):
        for k, row in enumerate(_long_arcs(pieces, data, a, _STRETCH)[2], a):
            alpha[wide + k] = np.logaddexp.reduce(alpha[k : wide + k] + row)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0.0
    total = np.zeros(len(pieces.log_p))
    for a in reversed(range(0, len(data), _STRETCH)):
        ends, numbers, logs = _long_arcs(pieces, data, a, _STRETCH)
        for k in range(len(ends) - 1, -1, -1):
            before = slice(a + k, a + k + wide)
            beta[before] = np.logaddexp(beta[before], logs[k] + beta[wide + a + k])
        row, column = np.nonzero(numbers >= 0)
        share = np.exp(alpha[a + row + column] + logs[row, column] + beta[wide + a + row] - alpha[-1])
        total += np.bincount(numbers[row, column], share, len(total))
    return total


_STRETCH = 65_536
_LONG = 512


def log_marginals(pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, marker included, over all segmentations."""
    lengths = end - start
    out = np.empty(len(start))
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = _long_word(pieces, data[start[i] : end[i]].tobytes())
    short = np.flatnonzero(lengths <= _LONG)
    for same in _by_length(short, lengths[short]):
        rows = short[same]
        out[rows] = _forward(pieces, _block(data, start[rows], int(lengths[rows[0]])))[-1]
    return out


def expected_counts(pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected piece counts of words with their counts, over all segmentations of words of any length."""
    total = np.zeros(len(pieces.log_p))
    lengths = end - start
    for i in np.flatnonzero(lengths > _LONG):
        total += count[i] * _long_counts(pieces, data[start[i] : end[i]].tobytes())
    short = np.flatnonzero(lengths <= _LONG)
    for same in _by_length(short, lengths[short]):
        rows = short[same]
        arcs: list = []
        alpha = _forward(pieces, _block(data, start[rows], int(lengths[rows[0]])), arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        for a, b, which, number in reversed(arcs):
            arc = pieces.log_p[number] + beta[b, which]
            total += np.bincount(number, np.exp(alpha[a, which] + arc - alpha[-1, which]) * count[rows[which]], minlength=len(total))
            beta[a, which] = np.logaddexp(beta[a, which], arc)
    return total


def word_counts(documents: DataFrame, kinds: int = 1, text: str = "text", kind: str = "kind") -> DataFrame:
    """(h, word, c, c0, c1, ...): how often each word occurs in all given texts, and in those of each kind.

    ``kind`` numbers them from 0. Words fold inside tasks before the shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrow_text.pieces(batch, "text", 8 << 20):
                found = arrow_text.words(piece.column("text"), arrow_text.SPACED)
                of_row = piece.column("kind").to_numpy(zero_copy_only=False)
                of_word = of_row[found.row]
                for k in np.unique(of_row):
                    mine = np.flatnonzero(of_word == k)
                    hashes, first, counts = np.unique(found.hash[mine], return_index=True, return_counts=True)
                    first = mine[first]
                    words = _strings(found.data, found.start[first], found.end[first])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), k, np.int32)), pa.array(hashes.view(np.int64)), words, pa.array(counts)], ["kind", "h", "word", "c"]
                    )

    rows = documents.select(F.col(text).cast("string").alias("text"), F.col(kind).cast("int").alias("kind"))
    found = rows.mapInArrow(count, "kind int, h long, word binary, c long")
    of_kind = [F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(kinds)]
    return found.groupBy("h", "word").agg(F.sum("c").alias("c"), *of_kind)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    lengths = end - start
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[index])]).cast(pa.binary())


def fit(counts: DataFrame, model: ModelFile, rounds: int = ROUNDS) -> Pieces:
    """Piece weights after ``rounds`` of expected counts over all distinct words, each counting once.

    The pieces stand for what words are like, frequent or not, as they are to give new words their share.
    """
    spark = counts.sparkSession
    pieces = Pieces.of(model)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                data, offsets = arrow_text.buffers(batch.column("word").cast(pa.large_binary()).view(pa.large_string()))
                found = expected_counts(shared.value, data, offsets[:-1], offsets[1:], np.ones(len(offsets) - 1))
                total = found if total is None else total + found
            if total is not None:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

        found = counts.select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(pieces.log_p))
        total[found["piece"].to_numpy(np.int64)] = found["n"].to_numpy()
        pieces = pieces.with_counts(total)
    return pieces


def _size_class(count: str) -> Column:
    return F.floor(F.log2(count) * 8)


def _head_class(counts: DataFrame, head: int) -> int:
    """The smallest class of counts from which on there are at most ``head`` words. Classes are few hundred at most."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(_size_class("c").alias("k")).agg(F.count("*").alias("n")).collect()}
    total, lowest = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > head:
            break
        lowest = k
    return lowest


@dataclass
class Kind:
    """One kind's share of the training rows and of its own tokens; logarithms are to base 10."""

    log_prior: float
    discount: float
    tokens: int
    share: float  # of the discounts
    new: float  # part of them for the subword arcs
    log_end: float

    @staticmethod
    def of(rows: int, of_rows: int, words: int, distinct: int, once: int, twice: int, new: int, alone: bool) -> Kind:
        """``new`` of the ``once`` words that this kind has once occur nowhere else."""
        tokens = words + rows
        discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        share = discount * distinct / tokens if distinct else 0.5
        part = 1.0 if alone else min(0.98, max(0.05, new / max(1, once)))
        prior = float(np.log10(rows / of_rows)) if rows else 0.0
        return Kind(prior, discount, max(1, tokens), share, part, float(np.log10(rows / tokens if distinct else 0.5)))

    def log_words(self, own: np.ndarray, all_: np.ndarray, words: int, subword: np.ndarray) -> np.ndarray:
        """Of known words, by their counts in this kind and in all, and the natural log of their subword marginals."""
        first = np.where(own > 0, own - self.discount, 0.0) / self.tokens
        return np.log10(first + self.share * ((1 - self.new) * all_ / max(1, words) + self.new * np.exp(subword)))

    def log_word(self, own: Column, all_: Column, words: int, subword: Column) -> Column:
        """The same for columns, ``subword`` to base 10; a NULL count is a new word."""
        first = F.when(own > 0, (own - self.discount) / float(self.tokens)).otherwise(0.0)
        known = F.log10(first + self.share * (all_ * ((1 - self.new) / max(1, words)) + F.pow(F.lit(10.0), subword) * self.new))
        return F.when(all_.isNull(), subword + float(np.log10(self.share * self.new))).otherwise(known)


def _log_sum(parts: list[Column]) -> Column:
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return top + F.log10(sum((F.pow(F.lit(10.0), p - top) for p in parts[1:]), F.pow(F.lit(10.0), parts[0] - top)))


def scores(
    documents: DataFrame, model: ModelFile, doc_id: str = "doc_id", text: str = "text", head: int = HEAD_WORDS, rounds: int = ROUNDS, kind: str | None = "lang"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row's whole text.

    Learns from rows whose crc32(doc_id) mod 7 is not 2; a row without id is learnt from and not held out.
    A NULL or empty text is its end alone. Repeated rows each count and each have a row. ``kind`` names the column
    that tells training texts apart (None: one kind); a NULL there is a value like others. With nothing to
    learn from, counts are 0, the piece weights are the file's order, and words and the end have half each. Scores are log10 probabilities.
    """
    spark = documents.sparkSession
    value = F.lit("") if kind is None else F.coalesce(F.col(kind).cast("string"), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), training(F.col(doc_id)).alias("learn"), value.alias("value"))
    learnt = rows.where("learn")
    ends = learnt.count()
    largest = learnt.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(KINDS - 1).collect()
    sizes = [r["n"] for r in largest]
    if sum(sizes) < ends or not sizes:
        sizes.append(ends - sum(sizes))
    number = F.lit(len(sizes) - 1)
    for k, r in enumerate(largest):
        number = F.when(F.col("value") == r["value"], k).otherwise(number)
    own = [f"c{k}" for k in range(len(sizes))]
    counts = materialise(word_counts(learnt.select("text", number.alias("kind")), len(sizes)), "words")
    once = lambda c: F.col(c) == 1
    facts = [
        x for c in own
        for x in (F.coalesce(F.sum(c), F.lit(0)), F.count_if(F.col(c) > 0), F.count_if(once(c)), F.count_if(F.col(c) == 2), F.count_if(once(c) & once("c")))
    ]
    words, distinct, *found = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *facts).first()
    n, v = words + ends, distinct + (ends > 0)
    log_floor = -float(np.log10(n + v + 1))
    kinds = [Kind.of(size, ends, *found[5 * k : 5 * k + 5], alone=len(sizes) == 1) for k, size in enumerate(sizes)]
    pieces = fit(counts, model, rounds)
    top = counts.where(_size_class("c") >= _head_class(counts, head)).select("h", "word", "c", *own).toArrow().combine_chunks()
    data, offsets = arrow_text.buffers(top.column("word").combine_chunks().cast(pa.large_binary()).view(pa.large_string()) if top.num_rows else pa.array([], pa.string()))
    subword = log_marginals(pieces, data, offsets[:-1], offsets[1:])
    head_hash = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(head_hash)
    counted = {c: top.column(c).to_numpy()[order] for c in ("c", *own)}
    head_scores = [kinds[k].log_words(counted[c], counted["c"], words, subword[order]) for k, c in enumerate(own)]
    shared = spark.sparkContext.broadcast((pieces, head_hash[order], counted["c"], head_scores))
    end_base = float(np.log10(ends + 1) + log_floor)
    names = [f"s{k}" for k in range(len(kinds))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, head_hash, head_count, head_scores = shared.value
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in arrow_text.pieces(batch, "text"):
                found = arrow_text.words(part.column("text"), arrow_text.SPACED)
                hashes, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
                near = np.minimum(np.searchsorted(head_hash, hashes), max(0, len(head_hash) - 1))
                in_head = head_hash[near] == hashes if len(head_hash) else np.zeros(len(hashes), bool)
                rare = np.flatnonzero(~in_head)
                subword = np.zeros(len(hashes))
                subword[rare] = log_marginals(pieces, found.data, found.start[first[rare]], found.end[first[rare]]) / np.log(10)
                base = np.zeros(len(hashes))
                base[in_head] = np.log10(head_count[near[in_head]] + 1.0) + log_floor
                size, row = found.rows, found.row
                sums = []
                for kind, of_head in zip(kinds, head_scores):
                    known = np.zeros(len(hashes))
                    known[in_head] = of_head[near[in_head]]
                    sums.append(pa.array(np.bincount(row, known[which], size) + (kind.log_end + kind.log_prior)))
                tail = np.flatnonzero(~in_head[which])
                tail_rows, tail_h = row[tail], hashes[which[tail]].view(np.int64)
                offsets = np.searchsorted(tail_rows, np.arange(size + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + size)), part.column("id"), part.column("learn"),
                        pa.array(found.counts() + 1), pa.array(np.bincount(row, in_head[which], size).astype(np.int64) + (ends > 0)),
                        pa.array(np.bincount(row, base[which], size) + end_base),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(tail_h), pa.array(subword[which[tail]])], ["h", "f"])),
                        *sums,
                    ],
                    ["rid", "id", "learn", "n_tokens", "n_known", "base", "tail", *names],
                )
                rid += size

    schema = T.StructType(
        [
            T.StructField("rid", T.LongType()), rows.schema["id"], rows.schema["learn"], T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()),
            T.StructField("tail", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("f", T.DoubleType())]))),
            *[T.StructField(c, T.DoubleType()) for c in names],
        ]
    )
    scored = materialise(rows.drop("value").mapInArrow(score, schema), "lattice-scores")
    tail = scored.select("rid", F.inline("tail")).join(counts.select("h", "c", *own), "h", "left")
    base = F.log10(F.coalesce("c", F.lit(0)) + 1.0) + F.lit(log_floor)
    tail = tail.groupBy("rid").agg(
        F.sum(base).alias("tail_base"), F.count("c").alias("tail_known"),
        *[F.sum(kinds[k].log_word(F.col(c), F.col("c"), words, F.col("f"))).alias(f"tail_{names[k]}") for k, c in enumerate(own)],
    )
    total = [F.col(c) + F.coalesce(f"tail_{c}", F.lit(0.0)) for c in names]
    return scored.drop("tail").join(tail, "rid", "left").select(
        F.col("id").alias(doc_id), (~F.col("learn")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        _log_sum(total).alias("score"),
    )
