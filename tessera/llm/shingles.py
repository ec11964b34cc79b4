"""Word shingles of whole texts as 64-bit hashes, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words kept per Python worker before the memo starts afresh.
MEMO_WORDS = 400_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)


class WordMemo(dict):
    """Word (bytes) to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_memo = WordMemo()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` in order, A-Z lower-cased (bytes.split and bytes.lower are ASCII-only)."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter sequence of words is one shingle; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    span = min(k, len(w))
    n = len(w) - span + 1
    h = np.full(n, span, np.uint64) * GOLDEN
    with np.errstate(over="ignore"):
        for j in range(span):
            h = mix64(h + w[j : j + n] + GOLDEN)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b|, for sorted sets without repeats."""
    if not len(a) or not len(b):
        return False
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * shared >= num * (len(a) + len(b) - shared)
