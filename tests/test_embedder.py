"""The default embedder's vectors are those of one trigram after another, and it is not slow by the character."""

import time
import zlib

import numpy as np

from memspan.operators import models


def one_by_one(texts, dimension):
    out = np.zeros((len(texts), dimension), np.float32)
    for row, value in zip(out, texts, strict=True):
        padded = f"  {value.lower()}  "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            row[h % dimension] += 1.0 if h & 0x10000 else -1.0
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def test_vectors_are_those_of_single_trigrams(monkeypatch):
    texts = ["", "a", "The fox\nand 12", "Straße İstanbul", "日本語のテキスト", "áé𝄞😀 x", "\x00\x7f\x80߿ࠀ￿", "abc " * 500 + "ü"]
    for dimension in (64, 7):
        assert np.array_equal(models.hashed_trigrams(texts, dimension), one_by_one(texts, dimension))
    monkeypatch.setattr(models, "TRIGRAMS", 3)
    assert np.array_equal(models.hashed_trigrams(texts), one_by_one(texts, 64))


def test_long_texts_are_not_hashed_one_trigram_at_a_time():
    value = "several words of a text " * 20_000
    began = time.process_time()
    one_by_one([value], 64)
    slow = time.process_time() - began
    began = time.process_time()
    models.hashed_trigrams([value])
    assert time.process_time() - began < slow / 2
