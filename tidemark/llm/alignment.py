"""Two tokenizers' tokens of the same texts, aligned by byte offsets in lockstep.

A byte-level BPE tokenizer (A) encodes a space and the text, a piece model (B) the text, before which it puts that space itself. Where tokens of both end at the same byte, a group ends; tokens whose byte ranges overlap are linked. One NumPy vector holds the A and B pointers of all lanes of a batch: each step links what they point at, marks a cut where both end together, moves the pointer of the token that ends first (both at a cut), and lanes that have ended leave the vector. A lane is a document, or a stretch of one: a text is cut at single spaces before other characters, where tokens of both always begin, so that a long document advances in many lanes and a batch needs few steps. The ids of a piece of text between two such places are found once per worker; pieces are told apart by their text.

The corpus-wide count of a linked id pair is a keyed aggregate over the distinct pairs of each document. The COMMON pairs of most documents, a table of bounded size, are joined back by broadcast, all others by shuffle, where no key is hot. An A id's highest count is a table of vocabulary size.

Defined results: a text that is null or empty, or whose tokens don't join to the space and the text, has no tokens, zeros, and an empty groups_sha256; repeated rows, also with repeated or null doc_ids, are documents of their own; an empty table gives no rows; special tokens' strings are plain text; texts may have any length. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_folder, most_frequent, small_batches
from tidemark.llm.words import span_index

#: Id pairs whose counts are broadcast.
COMMON = 1 << 18
#: Pieces of text whose ids a worker remembers, and their bytes, before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 300_000, 1 << 25
#: Pieces of a lane; characters of text that are aligned together.
LANE, TOGETHER = 64, 1 << 20
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


class Side:
    """The tokens of remembered pieces, one after another: ids, and their ends within the piece."""

    def __init__(self):
        self.ids, self.ends = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.at, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, found: list, lengths: np.ndarray) -> None:
        """found: the ids of each new piece; lengths: bytes of each id."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.int64, int(size.sum()))
        ends = np.cumsum(lengths[ids])
        before = np.append(0, ends)[np.cumsum(size) - size]
        if self.used + len(ids) > len(self.ids):
            room = np.zeros(len(ids) + self.used // 2, np.int64)
            self.ids, self.ends = np.concatenate([self.ids[: self.used], room]), np.concatenate([self.ends[: self.used], room])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.used : self.used + len(ids)] = ends - np.repeat(before, size)
        self.at, self.size = np.concatenate([self.at, self.used + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.used += len(ids)

    def of(self, pieces: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends of the pieces' tokens in a row, a piece's bytes beginning at `begin`; how many each piece has."""
        size = self.size[pieces]
        index = span_index(self.at[pieces], size)
        return self.ids[index], self.ends[index] + np.repeat(begin, size), size


class Pair(dict):
    """Both tokenizers. As a dictionary: the number of each remembered piece of text, which is given without the space before it."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters, spare = {}, iter(range(256, 512))  # bytes that are no visible Latin-1 character are written as letters from 256 on, in order
        for x in range(256):
            shown = 33 <= x <= 126 or 161 <= x <= 172 or x >= 174
            letters[chr(x) if shown else chr(next(spare))] = x
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else b""
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            t = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(_BYTE.fullmatch(t)[1], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        apart = not any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.b_bytes) and self.b.normalize("a  b ﬁ ") == "▁a▁▁b▁ﬁ▁"
        self.cuts = _CUT if apart and "ByteLevel(add_prefix_space=False" in repr(self.a.pre_tokenizer) and self.a.normalizer is None else None
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.side_a, self.side_b, self.length, self.good, self.new, self.held = Side(), Side(), np.zeros(0, np.int64), np.zeros(0, bool), [], 0

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' pieces in a row; how many each text has. All are then remembered."""
        if len(self) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        cut = [self.cuts.split(x) if self.cuts else [x] for x in texts]
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        out = np.fromiter((self[p] for x in cut for p in x), np.int64, int(size.sum()))
        if self.new:
            led = [" " + x for x in self.new]
            a = [e.ids for e in self.a.encode_batch_fast(led, add_special_tokens=False)]
            b = self.b.encode(self.new, num_threads=1)
            raw = [x.encode() for x in led]
            same = [b"".join([self.a_bytes[i] for i in x]) == w == b"".join([self.b_bytes[i] for i in y]) and all(self.a_bytes[i] for i in x) for w, x, y in zip(raw, a, b, strict=True)]
            self.side_a.add(a, self.a_size)
            self.side_b.add(b, self.b_size)
            self.length = np.concatenate([self.length, np.fromiter(map(len, raw), np.int64, len(raw))])
            self.good = np.concatenate([self.good, np.array(same, bool)])
            self.held += sum(map(len, raw))
            self.new = []
        return out, size


@functools.lru_cache(maxsize=1)
def _pair(byte_level: str, pieces: str) -> Pair:
    """One per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(byte_level, pieces)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Advances all lanes together. a_end, b_end: where tokens end; a, b: each lane's first tokens; stop: one past its last A token. Returns the A and B tokens of every link, and those that end together.

    All numbers are positions in one flat row of tokens, and both ends of a lane agree.
    """
    links_a, links_b, cuts_a, cuts_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = a < stop
    a, b, stop = a[live], b[live], stop[live]
    while len(a):
        links_a.append(a)
        links_b.append(b)
        ahead = a_end[a] - b_end[b]
        cut = ahead == 0
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + (ahead <= 0), b + (ahead >= 0)
        live = a < stop
        if not live.all():  # lanes that have ended leave
            a, b, stop = a[live], b[live], stop[live]
    return tuple(np.concatenate(x) for x in (links_a, links_b, cuts_a, cuts_b))


def _digits(n: int) -> np.ndarray:
    """Row i: the decimal digits of i, zero bytes, and one byte left for a separator."""
    width = len(str(max(n - 1, 0)))
    return np.array([str(i).encode() for i in range(n)], f"S{width + 1}").view(np.uint8).reshape(n, width + 1)


class Aligner:
    """Aligns lists of texts."""

    def __init__(self, byte_level: str, pieces: str):
        self.pair = _pair(byte_level, pieces)
        n_a, n_b = len(self.pair.a_bytes), len(self.pair.b_bytes)
        self.n_b, self.n_pairs, self.digits = n_b, n_a * n_b, _digits(max(n_a, n_b))

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Per text: n_a, n_b, n_groups, n_links, groups (as bytes), n_pairs; and pair and times of the distinct id pairs of all texts in a row. A pair is a * (B's vocabulary size) + b."""
        pair, n = self.pair, len(texts)
        numbers, size = pair.numbers(texts)
        owner = np.repeat(np.arange(n), size)
        fits = np.bincount(owner, ~pair.good[numbers], n) == 0
        fits &= np.array([bool(x) for x in texts], bool)
        numbers, owner = numbers[fits[owner]], owner[fits[owner]]
        length = pair.length[numbers]
        begin = np.cumsum(length) - length
        a_ids, a_end, a_size = pair.side_a.of(numbers, begin)
        b_ids, b_end, b_size = pair.side_b.of(numbers, begin)
        a_at, b_at = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        first = np.searchsorted(owner, owner)  # each document's first piece
        lanes = np.flatnonzero((np.arange(len(owner)) - first) % LANE == 0)
        stops = np.append(a_at[lanes[1:]], len(a_ids)) if len(lanes) else lanes
        links_a, links_b, cuts_a, cuts_b = lockstep(a_end, b_end, a_at[lanes], b_at[lanes], stops)
        a_owner, b_owner = np.repeat(owner, a_size), np.repeat(owner, b_size)
        count = lambda x: np.bincount(x, minlength=n)
        link_owner = a_owner[links_a]
        keys, times = np.unique(link_owner * self.n_pairs + a_ids[links_a] * self.n_b + b_ids[links_b], return_counts=True)
        return {"n_a": count(a_owner), "n_b": count(b_owner), "n_groups": count(a_owner[cuts_a]), "n_links": count(link_owner), "groups": self._groups(a_ids, b_ids, cuts_a, cuts_b, a_owner, b_owner, n), "n_pairs": count(keys // self.n_pairs), "pair": keys % self.n_pairs, "times": times}

    def _groups(self, a_ids, b_ids, cuts_a, cuts_b, a_owner, b_owner, n: int) -> list[bytes]:
        """Each document's groups written out: a1,a2|b1;a3|b2,b3."""
        a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
        a_last[cuts_a], b_last[cuts_b] = True, True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        per_a, per_b = np.bincount(a_group, minlength=len(cuts_a)), np.bincount(b_group, minlength=len(cuts_a))
        before = np.append(0, np.cumsum(per_b))
        a_place = np.arange(len(a_ids)) + before[a_group]
        b_place = np.arange(len(b_ids)) + np.cumsum(per_a)[b_group]
        written = np.empty((len(a_ids) + len(b_ids), self.digits.shape[1]), np.uint8)
        written[a_place], written[b_place] = self.digits[a_ids], self.digits[b_ids]
        written[a_place, -1], written[b_place, -1] = np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))
        sizes = np.zeros(n, np.int64)
        np.add.at(sizes, a_owner, (self.digits[a_ids] != 0).sum(axis=1) + 1)
        np.add.at(sizes, b_owner, (self.digits[b_ids] != 0).sum(axis=1) + 1)
        flat = written.reshape(-1)
        flat = flat[flat != 0].tobytes()
        ends = np.cumsum(sizes)
        return [flat[e - s : e - 1] if s else b"" for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = f"row long, doc_id long, {_COUNTS}, pairs array<struct<pair: long, times: long>>"


def aligned(docs: DataFrame, byte_level: str, pieces: str, with_groups: bool = False) -> DataFrame:
    """One row per document: a row number of its own, doc_id, its counts, the digest of its groups, its distinct id pairs; with_groups adds the groups themselves."""

    def run(batches):
        aligner, row = Aligner(byte_level, pieces), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, held = lo + 1, len(texts[lo])
                while hi < len(texts) and held + len(texts[hi]) <= TOGETHER:
                    held += len(texts[hi])
                    hi += 1
                x = aligner.align(texts[lo:hi])
                offsets = pa.array(np.append(0, np.cumsum(x["n_pairs"])), pa.int32())
                pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x["pair"], pa.int64()), pa.array(x["times"], pa.int64())], ["pair", "times"]))
                digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in x["groups"]], pa.string())
                columns = [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), *(pa.array(x[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), digests, pairs]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
                if with_groups:
                    columns, names = [*columns, pa.array([g.decode() for g in x["groups"]], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names)
                row += hi - lo
                lo = hi

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED + (", groups string" if with_groups else ""))


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """pair, n_docs (documents that hold it linked), best (n_docs is its A id's highest)."""
    counts = found.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")).withColumn("a", F.floor(F.col("pair") / n_b))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, byte_level: str, pieces: str, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    import sentencepiece

    spark = docs.sparkSession
    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()
    aligned(docs, byte_level, pieces).write.parquet(path := fresh_folder(spark, "aligned"))
    found = spark.read.schema(ALIGNED).parquet(path)
    pair_counts(found, n_b).write.parquet(path := fresh_folder(spark, "pairs"))
    counts = spark.read.schema("pair long, n_docs long, best boolean").parquet(path)
    top = F.broadcast(most_frequent(counts, "n_docs", common))
    links = found.select("row", F.inline("pairs"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    near = links.join(top, "pair").groupBy("row").agg(*sums)
    far = links.join(top.select("pair"), "pair", "left_anti").join(counts, "pair").groupBy("row").agg(*sums)
    both = near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs").join(both, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
