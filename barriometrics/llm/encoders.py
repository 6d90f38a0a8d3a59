"""Encoders inside tasks: a tokenizers-library tokenizer behind a bounded cache of words.

Where a tokenizer drops white space and never looks across it, a text's ids are those of its words in
turn. A task then splits a piece at ASCII white space, looks its distinct words up by their hashes in sorted
arrays, and gives the library only the words it has not met, in batches. When the arrays are full, words
not met for longest go, so memory is bounded. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tokenizers

from barriometrics.llm import arrow_text

CACHE_WORDS = 600_000
#: Words and stems held in arrays, about 45 bytes each.
KNOWN_WORDS = 2_000_000
KNOWN_STEMS = 1_000_000
_JOINED = 512


def whole(tokenizer: tokenizers.Tokenizer, text: str) -> bytes:
    """The ids of one text as little-endian unsigned 32-bit bytes."""
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def joined(tokenizer: tokenizers.Tokenizer, words: list[str]) -> list[bytes]:
    """The ids of each word, for a tokenizer that never looks across a space.

    Words are encoded joined by spaces, many in one text, which the library does several times faster
    than one by one; where a token starts in the text tells its word.
    """
    out: list[bytes] = []
    runs = [words[a : a + _JOINED] for a in range(0, len(words), _JOINED)]
    for a in range(0, len(runs), 32):
        part = runs[a : a + 32]
        for run, found in zip(part, tokenizer.encode_batch([" ".join(r) for r in part], add_special_tokens=False), strict=True):
            begins = np.cumsum([0, *(len(w) + 1 for w in run)]) - 1  # the space before each word
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            cuts = np.searchsorted(at, begins, "left")
            cuts[0], cuts[-1] = 0, len(at)
            ids = np.array(found.ids, "<u4").tobytes()
            cuts = (4 * cuts).tolist()
            out += [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes, as the library gives them without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        settings["truncation"] = settings["padding"] = None
        self.tokenizer = tokenizers.Tokenizer.from_str(json.dumps(settings))
        self.by_word = drops_white_space(settings)
        self.apart = self.by_word and splits_marks(settings)
        self.known = WordIds(KNOWN_WORDS)
        self.stems = WordIds(KNOWN_STEMS)

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows' texts, one behind the other, and where each row's begin (with the end)."""
        if not self.by_word:
            data, offsets = arrow_text.buffers(column)
            texts = (data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            found = [np.frombuffer(whole(self.tokenizer, t), "<u4") for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
        words = arrow_text.words(column, arrow_text.SPACED, lower=False)
        key, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        start, size = self.known.lookup(key)
        if len(new := np.flatnonzero(size < 0)):
            self.known.add(key[new], *self._new(words.data, words.start[first[new]], words.end[first[new]]))
            start, size = self.known.lookup(key)
        sizes = size[place]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.known.ids[_spread(start[place], sizes)]
        rows = np.concatenate(([0], np.cumsum(words.counts())))
        return ids, ends[rows]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, ends = self.encode_rows(pa.array([t.decode() for t in texts], pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of unseen words, one behind the other, and how many each has.

        Letters and the marks behind them are encoded apart, as the library does, so that a stem is met once.
        Only words of plain Latin letters and ASCII marks are taken apart: no apostrophes, which begin
        contractions, and no characters that the normaliser could join or change in another way.
        """
        cut = _stem_ends(data, start, end) if self.apart else np.zeros(len(start), np.int64)
        plain = cut > 0
        # Two parts for each word, the second empty unless marks follow a stem.
        starts = np.stack((start, np.where(plain, start + cut, end)), 1).ravel()
        ends = np.stack((np.where(plain, start + cut, end), end), 1).ravel()
        there = ends > starts
        body, at = _spaced(data, starts[there], ends[there])
        lowered = np.repeat(np.repeat(plain, 2)[there], (ends - starts)[there] + 1)
        body = np.where(lowered, arrow_text.LOWER[body], body)
        parts = arrow_text.words(_one_row(body), arrow_text.SPACED, lower=False)
        key, first, place = np.unique(parts.hash, return_index=True, return_inverse=True)
        if len(new := np.flatnonzero(self.stems.lookup(key)[1] < 0)):
            raw = body.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(at[first[new]].tolist(), (at + (ends - starts)[there])[first[new]].tolist(), strict=True)]
            found = joined(self.tokenizer, texts)
            self.stems.add(key[new], np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)
        begin, size = self.stems.lookup(key)
        sizes = np.zeros(len(starts), np.int64)
        sizes[there] = size[place]
        flat = self.stems.ids[_spread(begin[place], size[place])]
        return flat, sizes.reshape(-1, 2).sum(1)


def _stem_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For words of plain letters and then marks the bytes of their letters, else 0."""
    body, at = _spaced(data, start, end)
    lead = body == 0xC3
    follow = np.concatenate(([False], lead[:-1])) & _LATIN[body]
    letter = _LETTER[body] | follow | (lead & np.concatenate((follow[1:], [False])))
    letters, marks = (np.concatenate(([0], np.cumsum(x))) for x in (letter, _MARK[body]))
    size = end - start
    count = letters[at + size] - letters[at]
    plain = (count + marks[at + size] - marks[at] == size) & (letters[at + count] - letters[at] == count)
    return np.where(plain, count, 0)


def _table(pattern: bytes) -> np.ndarray:
    return np.array([re.fullmatch(pattern, bytes([b])) is not None for b in range(256)])


#: Latin letters in UTF-8 (A-Z, a-z, and behind the byte C3 À-ÿ without × and ÷), ASCII marks other than the apostrophe.
_LETTER, _LATIN, _MARK = _table(rb"[A-Za-z]"), _table(rb"[\x80-\x96\x98-\xB6\xB8-\xBF]"), _table(rb"[!-&(-/:-@\[-`{-~]")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, joined."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges, a space behind each, and where each begins."""
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[_spread(at, size)] = data[_spread(start, size)]
    return out, at


def _one_row(body: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(body)], np.int64)), pa.py_buffer(np.ascontiguousarray(body)))


class WordIds:
    """The ids of words by their 64-bit hashes, in sorted arrays; when full it forgets those not met for longest."""

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.key = np.zeros(0, np.uint64)
        self.start, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each hash begin, and how many they are; -1 for unknown ones."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = self.key[at] == key
        self.turn += 1
        self.met[at[found]] = self.turn
        return self.start[at], np.where(found, self.size[at], -1)

    def add(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds new hashes, in ascending order, with their words' ids and how many each has."""
        if len(self.key) + len(key) > self.most and len(self.key):
            self._forget()
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, ids))
        order = np.argsort(np.concatenate((self.key, key)), kind="stable")
        joined_ = ((self.key, key), (self.start, start), (self.size, size), (self.met, np.full(len(key), self.turn)))
        self.key, self.start, self.size, self.met = (np.concatenate(pair)[order] for pair in joined_)

    def _forget(self) -> None:
        """Keeps what the last lookup met, and of the rest the half met more lately."""
        keep = self.met >= min(self.turn, int(np.median(self.met)) + 1)
        self.key, size, start, self.met = self.key[keep], self.size[keep], self.start[keep], self.met[keep]
        self.size, self.start = size, np.cumsum(size) - size
        self.ids = self.ids[_spread(start, size)]


def remember(cache: dict, new: dict, most: int) -> None:
    """Add entries; a full cache first forgets its older half."""
    if len(cache) + len(new) > most:
        for key in list(islice(cache, len(cache) // 2)):
            del cache[key]
    cache.update(new)


def drops_white_space(settings: dict) -> bool:
    """Whether the first thing before the merges is to keep matches that hold no white space."""
    first = settings.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [{}])[0] if first.get("type") == "Sequence" else first
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    pattern = (first.get("pattern") or {}).get("Regex", "")
    steps = settings.get("normalizer") or {}
    steps = steps.get("normalizers", [steps]) if steps else []
    plain = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("content") == " ") for s in steps)
    tokens = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in settings.get("added_tokens", []))
    return bool(kept and plain and tokens and r"[^\s" in pattern and " " not in pattern)


def splits_marks(settings: dict) -> bool:
    """Whether lower-cased runs of letters and runs of marks are taken apart before the merges."""
    lowers = any(s.get("type") == "Lowercase" for s in (settings.get("normalizer") or {}).get("normalizers", []))
    pattern = json.dumps(settings["pre_tokenizer"])
    return lowers and r"[\\p{L}]+" in pattern and r"[^\\s\\p{L}\\p{N}]+" in pattern


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def version(path: str) -> str:
    """Digest of the tokenizer file and the library's version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()[:32]
