"""Best-fit packing of tokenised documents into fixed-length sequences.

A document's ids are cut from the end into full pieces; its first piece holds what is left. Pieces are dealt into shards of about `per_shard` documents; each shard packs its own with vector best fit under three capacities (tokens, documents, attention cost) and so leaves at most one badly filled sequence. A shard holds a few numbers per piece, never the ids.

Defined results: a null or empty text is one piece holding the end id alone; repeated rows (also repeated or null doc_ids) are separate documents; an empty table gives no rows; a document longer than a sequence fills whole sequences but for its first piece. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, runs, small_batches
from tidemark.llm.words import mix, span_index

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int"
#: Most distinct words whose ids a worker remembers, and their bytes, before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 1 << 26
#: Bytes of text that are looked up together.
TOGETHER = 1 << 21


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. cost bounds the sum of squared piece lengths, the attention work under block-diagonal masks."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


#: Bytes of a word that its two numbers hold.
HELD = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def span_names(raw: bytes, start: np.ndarray, end: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of raw[start:end] for every pair: its first eight bytes and, beyond these, its last eight, as numbers; length and mark as one number; a hash of all. The numbers are the whole span where it has at most `HELD` bytes; of longer ones bytes must be compared."""
    size = end - start
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    head = eight[start] & _MASK[np.minimum(size, 8)]
    tail = np.where(size > 8, eight[np.maximum(end - 8, 0)], np.uint64(0))
    kind = 2 * size + mark
    hashed = head ^ mix(tail + kind.astype(np.uint64) * _MIX)
    for k in np.flatnonzero(size > HELD).tolist():
        hashed[k] ^= np.uint64(int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest(), "little"))
    return head, tail, kind, mix(hashed)


class WordTokenizer:
    """A byte-level BPE tokenizer applied to space-led words, each distinct word once.

    Such a tokenizer never merges across the start of a space-led word, so where every space stands alone between other characters, a text's ids are those of its words in a row. Other texts, and those with an added token's text, are encoded whole. Words are found by 64-bit hashes in sorted arrays and compared by their bytes, those of up to `HELD` bytes as two numbers and a length; a text with a word that shares its hash with another one is encoded whole. New words are encoded together in one text, where each begins with the only ids that start with a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.letters, self.written = np.zeros(1 << 16, np.uint8), 0  # the words of more than HELD bytes, one after another
        self.word, self.kind = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.head, self.tail = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: bytes) -> bool:
        return bool(text) and text[0] != 32 and text[-1] != 32 and b"  " not in text and not any(x in text for x in self.added)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        fast = [k for k, x in enumerate(texts) if self.plain(x)]
        slow = [k for k, x in enumerate(texts) if x and not self.plain(x)]
        for k, ids in zip(slow, self.whole([texts[k].decode() for k in slow]), strict=True):
            out[k] = ids
        for lo, hi in runs([texts[k] for k in fast], TOGETHER):
            for k, ids in zip(fast[lo:hi], self._words([texts[k] for k in fast[lo:hi]]), strict=True):
                out[k] = ids
        return out

    def _words(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b" " + b" ".join(texts)
        data = np.frombuffer(raw, np.uint8)
        start = np.flatnonzero(data == 32)
        end = np.append(start[1:], len(data))
        lengths = np.array([len(x) + 1 for x in texts])
        first = np.searchsorted(start, np.cumsum(lengths) - lengths)
        leading = np.zeros(len(start), np.int64)
        leading[first] = 1  # the same letters without a space before them are another word
        *names, hashed = span_names(raw, start, end, leading)
        inverse, keys = pd.factorize(hashed)
        sample = np.empty(len(keys), np.int64)
        sample[inverse[::-1]] = np.arange(len(start))[::-1]
        found = np.searchsorted(self.keys, keys)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == keys[known]
        if not known.all():
            if len(self.keys) > REMEMBERED or self.written > REMEMBERED_BYTES:
                self._forget()
                known[:] = False
            self._learn(raw, data, start, end, keys[~known], sample[~known], leading[sample[~known]] > 0, names)
            found = np.searchsorted(self.keys, keys)
        other = self._others(data, start, end, sample, inverse, found, names)
        at, size = self.at[found][inverse], self.size[found][inverse]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(at - ends + size, size) + np.arange(ends[-1])]
        cuts = np.append(ends - size, ends[-1])[np.append(first, len(start))]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in np.unique(np.searchsorted(first, np.flatnonzero(other), "right") - 1).tolist():
            out[k] = self.whole([texts[k].decode()])[0]
        return out

    def _others(self, data, start, end, sample, inverse, found, names) -> np.ndarray:
        """Which words are not the remembered one of the same hash. All words are compared with their sample, the samples with what is remembered."""
        long = end - start

        def differ(a, size, pool, b) -> np.ndarray:
            """Whether data[a:a+size] and pool[b:b+size] do."""
            unequal = data[span_index(a, size)] != pool[span_index(b, size)]
            total = np.append(0, np.cumsum(unequal))
            ends = np.cumsum(size)
            return total[ends] > total[ends - size]

        of_sample, out = np.zeros(len(sample), bool), np.zeros(len(start), bool)
        for x, held in zip(names, (self.head, self.tail, self.kind), strict=True):
            of_sample |= x[sample] != held[found]
            out |= x != x[sample][inverse]
        at = np.flatnonzero(~of_sample & (long[sample] > HELD))
        of_sample[at] = differ(start[sample[at]], long[sample[at]], self.letters, self.word[found[at]])
        at = np.flatnonzero(~out & (long > HELD))
        out[at] = differ(start[at], long[at], data, start[sample[inverse[at]]])
        return of_sample[inverse] | out

    def _learn(self, raw, data, start, end, keys, sample, leading, names) -> None:
        order = np.argsort(leading, kind="stable")
        keys, sample, n_led = keys[order], sample[order], int((~leading).sum())
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        texts = [raw[start[s] : end[s]].decode() for s in sample[:n_led]]
        for ids in self.whole(["".join(texts[lo : lo + 512]) for lo in range(0, n_led, 512)]):
            begin = np.flatnonzero(self.leads[ids])
            parts.append(ids)
            sizes.append(np.diff(np.append(begin, len(ids))))
        bare = self.whole([raw[start[s] + 1 : end[s]].decode() for s in sample[n_led:]])
        parts += bare
        sizes.append(np.array([len(x) for x in bare], np.int64))
        size, ids = np.concatenate(sizes), np.concatenate(parts)
        if len(size) != len(keys):
            raise ValueError("the tokenizer doesn't keep words apart")
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(ids) + self.used // 2, "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        order = np.argsort(keys)
        put = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.size = np.insert(self.keys, put, keys[order]), np.insert(self.at, put, at[order]), np.insert(self.size, put, size[order])
        self.head, self.tail, self.kind = (np.insert(held, put, x[sample[order]]) for held, x in zip((self.head, self.tail, self.kind), names, strict=True))
        long = np.where(end[sample] - start[sample] > HELD, end[sample] - start[sample], 0)
        if self.written + long.sum() > len(self.letters):
            self.letters = np.concatenate([self.letters[: self.written], np.zeros(int(long.sum()) + self.written // 2, np.uint8)])
        self.letters[self.written : self.written + long.sum()] = data[span_index(start[sample], long)]
        word = self.written + np.cumsum(long) - long
        self.written += int(long.sum())
        self.word = np.insert(self.word, put, word[order])


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that tasks after the first find the words known; single-threaded, as tasks are what runs side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: only the first may be shorter than `most`."""
    first = n % most or min(n, most)
    return [(0, first), *((s, most) for s in range(first, n, most))]


def by_norm(lengths: np.ndarray, cap: Capacity) -> list[list[int]]:
    """Each piece, longest first, goes to the open sequence whose weighted residual norm after it is least."""
    top = np.array([cap.tokens, cap.documents, cap.cost], float)
    w = np.array(cap.weights)
    rest = np.empty((max(len(lengths), 1), 3))
    bins: list[list[int]] = []
    open_ids = np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if len(lengths) else 0
    since = 0
    for i in order:
        d = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        if since > 64:  # sequences that the smallest piece doesn't fit need no more looks
            open_ids, since = open_ids[(rest[open_ids] >= [least, 1, least * least]).all(axis=1)], 0
        after = rest[open_ids] - d
        fits = (after >= 0).all(axis=1)
        since += 1
        if fits.any():
            norm = ((after / top) ** 2 @ w) + np.where(fits, 0, np.inf)
            b = int(open_ids[int(np.argmin(norm))])
            bins[b].append(int(i))
            rest[b] -= d
        else:
            rest[len(bins)] = top - d
            open_ids = np.append(open_ids, len(bins))
            bins.append([int(i)])
    return bins


def by_dot(lengths: np.ndarray, cap: Capacity) -> list[list[int]]:
    """Sequences are filled one by one; each takes the fitting piece whose weighted dot-product with what is left is largest."""
    top = np.array([cap.tokens, cap.documents, cap.cost], float)
    w = np.array(cap.weights)
    kinds, inverse = np.unique(lengths, return_inverse=True)
    waiting = [list(np.flatnonzero(inverse == k)[::-1]) for k in range(len(kinds))]
    left = np.array([len(x) for x in waiting])
    demand = np.stack([kinds, np.ones(len(kinds)), kinds.astype(float) ** 2], axis=1) if len(kinds) else np.zeros((0, 3))
    bins: list[list[int]] = []
    while left.any():
        live = np.flatnonzero(left)
        rest, held = top.copy(), []
        while True:
            fits = live[(demand[live] <= rest).all(axis=1) & (left[live] > 0)]
            if not len(fits):
                break
            k = int(fits[int(np.argmax((demand[fits] / top) @ (w * rest / top)))])
            held.append(int(waiting[k].pop()))
            left[k] -= 1
            rest -= demand[k]
        if not held:
            raise ValueError("a piece is larger than an empty sequence")
        bins.append(held)
    return bins


def best_fit(lengths: np.ndarray, cap: Capacity) -> list[list[int]]:
    """The better of the two vector rules; pieces that fill a sequence stand alone."""
    full = lengths >= cap.tokens
    at = np.flatnonzero(~full)
    packed = by_dot(lengths[at], cap)
    if len(packed) > -(-int(lengths[at].sum()) // cap.tokens):  # more than the least possible
        packed = min(by_norm(lengths[at], cap), packed, key=len)
    return [[int(i)] for i in np.flatnonzero(full)] + [[int(at[i]) for i in b] for b in packed]


def tokenised_pieces(docs: DataFrame, tokenizer: str, shards: int, end_id: int = 2, most: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves."""

    def run(batches):
        encode = _tokenizer(tokenizer).encode
        end = np.array([end_id], "<u4")
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), byte_texts(batch.column(1))
            for lo, hi in runs(texts, TOGETHER):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[lo:hi], encode(texts[lo:hi]), strict=True):
                    ids = np.concatenate([ids, end])
                    turn += 1
                    for k, (start, n) in enumerate(cut(len(ids), most)):
                        part = ids[start : start + n]
                        rows.append((doc_id, k, start, n, zlib.crc32(part.tobytes()), turn % shards, *([part.tolist()] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()] + ([pa.list_(pa.int32())] if with_ids else [])
    names = [x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else [])
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), end_id: int = 2, per_shard: int = 8192, with_ids: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    shards = max(1, math.ceil(docs.count() / per_shard))
    found = tokenised_pieces(docs, tokenizer, shards, end_id, cap.tokens, with_ids)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in out.split(", ")]

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = part["length"].to_numpy(np.int64)
        seq, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for b, held in enumerate(best_fit(lengths, cap)):
            seq[held] = b
            offset[held] = np.cumsum(lengths[held]) - lengths[held]
        return part.assign(sequence_id=(np.int64(part["shard"].iloc[0]) << 32) + seq, offset=offset)[names]

    return found.groupBy("shard").applyInPandas(place, out)
