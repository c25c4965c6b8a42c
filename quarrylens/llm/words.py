"""Word runs as the data description defines them: unbroken letters or digits of any script, lower case."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingle_hashes(tokens: list[str], width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` words, in text order."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(" ".join(tokens[i : i + width])) for i in range(n)), dtype=np.uint64, count=n)
