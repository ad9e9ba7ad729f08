"""Counts over the words and lines of one text, shared by the quality operators."""

from __future__ import annotations

import numpy as np

#: White space of the contracts; bytes.split() cuts at just these.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes, spread (splitmix64's finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Python's own hashes: equal within a process, which is all that counting within a text needs."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n words."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _STEP + mixed(h[i : len(h) - n + 1 + i])
    return mixed(out)


def repeated_words(h: np.ndarray, n: int = 5) -> int:
    """Words that lie in a window of n words which the text has twice or more."""
    if len(h) <= n:
        return 0
    w = windows(h, n)
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def spaces(text: str) -> int:
    return sum(map(text.count, SPACE))


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def worded_lines(text: str) -> list[str]:
    """The \\n-split lines that have a word."""
    return [x for x in text.split("\n") if x.strip(SPACE)]
