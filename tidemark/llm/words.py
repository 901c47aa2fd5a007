"""64-bit hashes of words and word windows, a few hundred thousand words at a time.

A word is a maximal run without space or tab..carriage return; A-Z is lower-cased. A word of up to seven bytes is hashed by its bytes and length as one number, mixed, so that no two such words agree; a longer word's hash is eight bytes of its BLAKE2b digest, found once for each distinct word that a worker remembers.
"""

from __future__ import annotations

import hashlib

import numpy as np

TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Most distinct long words that a worker remembers, and their bytes, before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 1 << 25
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


class Digests(dict):
    """Eight bytes of the digest of each word."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.held += len(word)
        return out


_known = Digests()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for every pair; 0 for an empty word."""
    size = end - start
    padded = raw + bytes(8)
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix((eight[start] & _MASK[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56)))
    long = np.flatnonzero(size > 7)
    out[long] = np.fromiter((_known[raw[a:b]] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return out


class Words:
    """The words of some texts in order. bounds[k]:bounds[k+1] are those of text k; start and end index data."""

    def __init__(self, texts: list[bytes], keep: np.ndarray | None = None):
        """keep: a 256-entry flag table; other bytes are no part of a word's hash (a word of such bytes alone has hash 0)."""
        raw = b" ".join(texts).translate(TO_LOWER) + b" "
        self.data = np.frombuffer(raw, np.uint8)
        space = IS_SPACE[self.data].view(np.int8)
        edge = np.diff(space, prepend=np.int8(1))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if keep is None:
            self.hash = word_hashes(raw, self.start, self.end)
        else:
            held = keep[self.data]
            rank = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum(held, out=rank[1:])
            self.hash = word_hashes(self.data[held].tobytes(), rank[self.start], rank[self.end])
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=at[1:])
        self.bounds = np.searchsorted(self.start, at)


def span_index(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1 ... (size[0] numbers), then those of at[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbours of h, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
    return mix(out)


def shingle_set(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of one text's word hashes; fewer words than width make one shingle, none make none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(windows(h, min(width, len(h))))
