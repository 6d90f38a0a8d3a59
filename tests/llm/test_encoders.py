"""Word encoders against the library, also while their arrays forget."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from barriometrics.llm import encoders

WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", "Wal", "ÉTÉ", "é", "Ãÿ", "×", "÷", "'", "'s", "I'LL", "!", "?!", "...", "-", "_", "~{", "1", "2024", "日本", "😀", "́", "<|endoftext|>", "\x00", "\x1c", " ", "ß", "İ", "Ĳ"]


def texts(seed, count):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4)))
    return ["".join(word() + rng.choice([" ", "  ", "\n", "\t \x0b"]) for _ in range(rng.randint(0, 30))) for _ in range(count)] + ["", None, " \n"]


def agrees(own, library, rows):
    ids, ends = own.encode_rows(pa.array(rows, pa.string()))
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == expected


def test_rows_are_encoded_as_by_the_library():
    own, library = encoders.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for seed in range(4):
        agrees(own, library, texts(seed, 300))
    assert own.by_word and own.apart


def test_full_arrays_forget_and_stay_right():
    own, library = encoders.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    own.known.most, own.stems.most = 400, 150
    for seed in range(8):
        agrees(own, library, texts(seed, 60))
    assert len(own.known.key) < 1_500 and np.all(np.diff(own.known.key.astype(object)) > 0)
    assert own.known.size.sum() == len(own.known.ids)
