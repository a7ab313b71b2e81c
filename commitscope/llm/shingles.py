"""Word shingles and text hashes, shared by the near-duplicate passes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

SEED = 42


def shingles(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's runs of ``width`` words, in order; a shorter text has one, a text without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    line = b" ".join(words)
    if n <= 1:
        return np.array([h(line, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return np.fromiter([h(line[s:e], seed) for s, e in zip((end - size)[:n].tolist(), end[width - 1 :].tolist())], np.uint64, n)


def body_of(text: str):
    """Hash that tells the texts of rows with one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
