"""A hierarchical Pitman-Yor language model, trained and applied where the words are.

Restaurants: one for every word that stands before another (or a text's begin), however many there are; all share one parent, the unigram restaurant, whose base is uniform over the training vocabulary and one unknown word.

Seating is sampled by blocked Gibbs steps: a dish's customers leave a restaurant together, with the customers that their tables sent to the parent, and sit down again one after the other, each by the Chinese-restaurant probabilities; a new table sends a customer to the parent. A restaurant's number of tables is that of the sweep before, and the parent's seating that of the round before. Predictive probabilities are averaged over the samples. Chance is a hash of dish, sweep and customer, so that scores depend on the rows alone and not on how they are stored or spread.

Data flow. A batch of neighbouring documents sends each bucket of contexts its distinct (context, word) pairs with their training counts, once per batch however often they occur. A bucket seats whole restaurants; a context with more than `HOT` tokens is dealt over several buckets by word, and its parts tell each other their totals in the same exchange that carries tables to the unigram restaurant, which is dealt over `homes` by word. Requests are stored by bucket, so that no exchange finds or moves them again. After `rounds` exchanges the buckets answer with the pairs' probabilities, which a batch adds up per document. What moves grows with the input; to the driver come eight sums and at most `RARE` words, of which blobs name the 65,535 most frequent by rank.

Defined results: a null or empty text has one token, its end; repeated rows count and are scored each; a null doc_id is hashed as empty text; an empty table gives no rows. With no training token every count is 0 and the model is its uniform base. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, materialise, pieces, release, runs, small_batches
from tidemark.llm.words import Words, mix

#: Words are known by 56 bits of their hash; this one is a text's end and also what stands before its first word.
END = np.uint64(0xE5D)
#: Bytes of text in a batch.
BATCH = 6 << 20
#: Tokens of a context beyond which it is dealt over several buckets (of the `OTHER` most frequent words).
HOT = 1 << 18
RARE = 1 << 20
#: Most words that blobs name by rank; also the mark of a word that has none.
OTHER = (1 << 16) - 1
_STEP, _SWEEP, _PART, _TAG = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_56 = np.uint64((1 << 56) - 1)


@dataclass(frozen=True)
class Sampling:
    burn_in: int = 2
    samples: int = 4
    rounds: int = 2
    strength: float = 1.0
    seed: int = 7


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; first all lowest bytes, then all second ones, and so on, as high bytes are mostly zero."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes.tolist(), map(np.dtype, types), strict=True):
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words with an end after each text, and the number of tokens of each text."""
    hashes, sizes = [], []
    for lo, hi in runs(texts):
        words = Words(texts[lo:hi])
        size = np.diff(words.bounds) + 1
        stop = np.cumsum(size) - 1
        h = np.full(int(size.sum()), END)
        inside = np.ones(len(h), bool)
        inside[stop] = False
        h[inside] = words.hash >> np.uint64(8)
        hashes.append(h)
        sizes.append(size)
    return np.concatenate(hashes), np.concatenate(sizes)


def _batches(batches, bytes_each: int = BATCH):
    """(number, doc_ids, texts) of neighbouring rows; the number is the same whenever the partition is computed again."""
    ids: list = []
    texts: list[bytes] = []
    size, k = 0, TaskContext.get().partitionId() << 24
    for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
        for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            if size and size + len(text) > bytes_each:
                yield k, ids, texts
                ids, texts, size, k = [], [], 0, k + 1
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + 1
    if ids:
        yield k, ids, texts


def _held_out(ids: list, modulus: int, rest: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == rest for i in ids])


def _word_counts(batches):
    for _, _, texts in _batches(batches):
        at, word = pd.factorize(tokens(texts)[0])
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at))], ["word", "n"])


class Known:
    """The most frequent words, which blobs name by rank, and the parts that hot contexts are dealt in. Their number is bounded; what is not among them is named by its hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hot: int):
        self.words = words[:OTHER]
        self.order = np.argsort(self.words)
        self.parts = np.maximum(1, -(-counts[:OTHER] // hot)).astype(np.uint64)

    def rank(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), OTHER, np.uint16)
        at = self.order[np.minimum(np.searchsorted(self.words, words, sorter=self.order), len(self.words) - 1)]
        return np.where(self.words[at] == words, at, OTHER).astype(np.uint16)

    def parts_of(self, rank: np.ndarray) -> np.ndarray:
        return np.append(self.parts, np.ones(OTHER + 1 - len(self.parts), np.uint64))[rank]

    def short(self, words: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as ranks and, in order, those that have none."""
        return rank, words[rank == OTHER]

    def full(self, rank: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.append(self.words, np.zeros(OTHER + 1 - len(self.words), np.uint64))[rank]
        out[rank == OTHER] = others
        return out


@dataclass
class Batch:
    """The distinct pairs of some documents, by bucket and context, and every token's pair."""

    context: np.ndarray
    word: np.ndarray
    context_rank: np.ndarray
    word_rank: np.ndarray
    edges: np.ndarray
    pair: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], buckets: int, known: Known) -> Batch:
        h, sizes = tokens(texts)
        w, words = pd.factorize(h)
        # The word before a text's first word is the end of the text before; that of the very first is the last end.
        pair, keys = pd.factorize(np.roll(w, 1) * len(words) + w)
        at, w = keys // len(words), keys % len(words)
        rank, mixed = known.rank(words), mix(words)
        part = mixed[w] % known.parts_of(rank)[at]
        bucket = mix(words[at] + part * _PART) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.int64) * len(words) + at)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        at, w = at[order], w[order]
        return cls(words[at], words[w], rank[at], rank[w], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)), place[pair], sizes)


def _requests(buckets: int, known: Known, modulus: int, rest: int):
    def run(batches):
        for k, ids, texts in _batches(batches):
            b = Batch.of(texts, buckets, known)
            train = np.repeat(~_held_out(ids, modulus, rest), b.sizes)
            trained = np.bincount(b.pair, weights=train, minlength=len(b.word)).astype(np.uint32)
            rows, blobs = [], []
            for x in np.flatnonzero(np.diff(b.edges)).tolist():
                i, j = b.edges[x], b.edges[x + 1]
                context = b.context[i:j]
                first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                rows.append(x)
                blobs.append(pack(*known.short(context[first], b.context_rank[i:j][first]), np.diff(np.append(first, j - i)).astype(np.uint32), *known.short(b.word[i:j], b.word_rank[i:j]), trained[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["batch", "bucket", "pairs"])

    return run


def _streams(buckets: int, known: Known, modulus: int, rest: int):
    """Each document's pairs, whose order doesn't matter, sorted and as differences."""

    def run(batches):
        for k, ids, texts in _batches(batches):
            b = Batch.of(texts, buckets, known)
            owner = np.repeat(np.arange(len(ids)), b.sizes)
            pair = np.sort(owner * len(b.word) + b.pair) - owner * len(b.word)
            step = np.diff(pair, prepend=0)
            begin = np.append(0, np.cumsum(b.sizes)[:-1])
            step[begin] = pair[begin]
            blob = pack(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), _held_out(ids, modulus, rest), b.sizes.astype(np.uint32), step.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([blob], pa.binary())], ["batch", "stream"])

    return run


def _times(n: int, step: np.uint64) -> np.uint64:
    return np.uint64(n * int(step) & 0xFFFFFFFFFFFFFFFF)


def chance(key: np.ndarray, customer: int) -> np.ndarray:
    """A number in 0..1 for each key and customer."""
    return (mix(key + _times(customer, _STEP)) >> np.uint64(11)).astype(float) * 2.0**-53


def seat_on(n: int, t: float, c: int, a: float, d: float, key: np.uint64) -> float:
    """Tables of one dish once customers n + 1 to c have come to the t tables of the first n.

    Where newcomers seldom open a table, the next who does is drawn at once: that none opens one between n and m has probability gamma(m - dt) gamma(n - dt + a) / (gamma(n - dt) gamma(m - dt + a)), which is solved for m.
    """
    while n < c:
        end = min(c, n + 4096)
        for u in (mix(key + np.arange(n, end, dtype=np.uint64) * _STEP) >> np.uint64(11)).tolist():
            x = n - d * t
            if a * 64 < x:
                left = math.log((u + 0.5) * 2.0**-53)
                now = math.lgamma(x) - math.lgamma(x + a)
                none = lambda m, t=t, now=now: math.lgamma(m - d * t) - math.lgamma(m - d * t + a) - now
                if none(c) >= left:
                    return t
                lo, hi = n, c  # nobody up to lo, somebody up to hi
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if none(mid) >= left else (lo, mid)
                n, t = hi, t + 1
                break  # the chances that follow belong to other customers
            t += u * 2.0**-53 * (x + a) < a
            n += 1
    return t


def seat(customers: np.ndarray, new: np.ndarray, d: float, key: np.ndarray, few: int = 64) -> np.ndarray:
    """Tables after seating each dish's customers one after the other; new: the weight of an own table against n - d * tables for the taken ones. Many dishes go side by side, the few largest on by themselves, by the same probabilities."""
    order = np.argsort(-customers, kind="stable")
    c, a, k = customers[order], new[order], key[order]
    t = (c > 0).astype(float)
    n = 1
    while (live := int(np.searchsorted(-c, -n, "left"))) > few:
        t[:live] += chance(k[:live], n) * (n - d * t[:live] + a[:live]) < a[:live]
        n += 1
    for i in range(live):
        t[i] = seat_on(n, float(t[i]), int(c[i]), float(a[i]), d, k[i])
    out = np.empty(len(c), np.int64)
    out[order] = t
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Numbers to 16 significant bits: single-precision floats without their lowest byte."""
    return (x.astype(np.float32).view(np.uint32) + np.uint32(128)) >> np.uint32(8)


def discount(ones: float, twos: float) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


@dataclass(frozen=True)
class Sums:
    """Of the whole model: training tokens and their kinds, customers and tables of the unigram restaurant, dishes of one and of two customers at either level."""

    train: int = 0
    kinds: int = 0
    customers: int = 0
    tables: int = 0
    ones0: int = 0
    twos0: int = 0
    ones1: int = 0
    twos1: int = 0

    def root(self, c: np.ndarray, t: np.ndarray, how: Sampling) -> np.ndarray:
        """Unigram probabilities of dishes with c customers at t tables."""
        d = discount(self.ones0, self.twos0)
        return (c - d * t + (how.strength + d * self.tables) / (self.kinds + 1)) / (how.strength + self.customers)


class Bucket:
    """All that the batches asked about the contexts of one bucket, and the seating of these restaurants."""

    def __init__(self, blobs: list[bytes], known: Known, how: Sampling):
        asked = [unpack(x, np.uint16, np.uint64, np.uint32, np.uint16, np.uint64, np.uint32) for x in blobs]
        self.how, self.n_pairs = how, [len(a[3]) for a in asked]
        context, self.contexts = pd.factorize(np.concatenate([known.full(*a[:2]) for a in asked]))
        context = np.repeat(context, np.concatenate([a[2] for a in asked]))
        word, self.words = pd.factorize(np.concatenate([known.full(*a[3:5]) for a in asked]))
        self.asked, keys = pd.factorize(context * len(self.words) + word)
        self.c = np.bincount(self.asked, weights=np.concatenate([a[5] for a in asked]), minlength=len(keys)).astype(np.int64)
        self.ctx, self.word = keys // len(self.words), keys % len(self.words)
        self.key = mix(self.contexts[self.ctx] * _PART + self.words[self.word])
        self.t = np.minimum(self.c, 1)
        self.split = np.flatnonzero(known.parts_of(known.rank(self.contexts)) > 1)
        self.elsewhere = np.zeros((2, len(self.contexts)), np.int64)

    def per_context(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each restaurant, those in other buckets included."""
        return tuple(np.bincount(self.ctx, weights=x, minlength=len(self.contexts)) + y for x, y in zip((self.c, self.t), self.elsewhere, strict=True))

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, training counts and tables to be summed over buckets: of each word, then of each context that is dealt over buckets."""
        words = [np.bincount(self.word, weights=x, minlength=len(self.words)).astype(np.int64) for x in (self.c, self.t)]
        parts = [np.bincount(self.ctx, weights=x, minlength=len(self.contexts)).astype(np.int64)[self.split] for x in (self.c, self.t)]
        tags = mix(self.contexts[self.split] ^ _TAG) & _56
        return np.concatenate([self.words, tags]), *(np.concatenate([w, p]) for w, p in zip(words, parts, strict=True))

    def hear(self, count: np.ndarray, c0: np.ndarray, t0: np.ndarray, sums: Sums) -> None:
        """Takes the sums of what was told, in the same order: training counts, tables (the parent's customers) and, for words, the parent's tables."""
        n = len(self.words)
        own = self.told()
        for k, total in enumerate((count, c0)):
            self.elsewhere[k, self.split] = total[n:] - own[k + 1][n:]
        self.count, self.c0, self.t0, self.sums = count[:n], c0[:n], t0[:n], sums

    def sweep(self, k: int) -> None:
        d, rest = discount(self.sums.ones1, self.sums.twos1), np.maximum(self.c0[self.word] - self.t, 0)
        parent = self.sums.root(rest, np.minimum(self.t0[self.word], rest), self.how)
        tables = self.per_context()[1]
        again = np.flatnonzero(self.c > 1)  # one customer always has one table
        self.t[again] = seat(self.c[again], ((self.how.strength + d * tables[self.ctx]) * parent)[again], d, self.key[again] + _times(self.how.seed * 1000 + k, _SWEEP))

    def probability(self) -> np.ndarray:
        """Predictive probability of every pair."""
        d, (customers, tables) = discount(self.sums.ones1, self.sums.twos1), self.per_context()
        root = self.sums.root(self.c0, self.t0, self.how)
        return (self.c - d * self.t + (self.how.strength + d * tables[self.ctx]) * root[self.word]) / (self.how.strength + customers[self.ctx])


def home_tables(key: np.ndarray, customers: np.ndarray, sums: Sums | None, how: Sampling, k: int) -> np.ndarray:
    """Tables of the unigram restaurant's dishes; one each before anything is known."""
    if sums is None:
        return np.minimum(customers, 1)
    d = discount(sums.ones0, sums.twos0)
    return seat(customers, np.full(len(key), (how.strength + d * sums.tables) / (sums.kinds + 1)), d, mix(key) + _times(how.seed * 1000 + 500 + k, _SWEEP))


def known_words(docs: DataFrame) -> Known:
    """The most frequent words of the documents. Only words of at least a `RARE`-th of all tokens, which are at most `RARE`, come to the driver."""
    counts = materialise(docs.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") * RARE >= tokens).toPandas().sort_values(["n", "word"], ascending=[False, True])[:OTHER]
    return Known(rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), HOT)


def dealt(asked: DataFrame, buckets: int) -> DataFrame:
    """Requests, stored where their buckets are: found and shuffled once, however often they are grouped by bucket."""
    conf, name = asked.sparkSession.conf, "spark.sql.adaptive.enabled"
    adaptive = conf.get(name)
    conf.set(name, "false")  # an adaptive plan doesn't tell how its result is dealt
    try:
        return materialise(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket"))
    finally:
        conf.set(name, adaptive)


SUMS = tuple(Sums.__dataclass_fields__)


def score(docs: DataFrame, modulus: int = 5, rest: int = 1, how: Sampling = Sampling(), bucket_mb: float = 6) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows with crc32(doc_id) % modulus = rest are held out of training. The rows of a partition must come in the same order whenever it is computed, as those of files do."""
    buckets = pieces(docs, bucket_mb, 4)
    homes = max(4, buckets // 2)
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known_words(docs)
    asked = dealt(docs.mapInArrow(_requests(buckets, known, modulus, rest), "batch long, bucket int, pairs binary"), buckets)

    def tell(bucket: int, b: Bucket) -> pd.DataFrame:
        keys, count, tables = b.told()
        is_tag = np.arange(len(keys)) >= len(b.words)
        home = (mix(keys) % np.uint64(homes)).astype(np.int64)
        rows = []
        for x in np.unique(home):
            at = np.flatnonzero(home == x)
            rows.append((int(x), bucket, pack(keys[at], is_tag[at], count[at], tables[at]), 0, 0))
        rows[0] = (*rows[0][:3], int((b.c == 1).sum()), int((b.c == 2).sum()))
        return pd.DataFrame(rows, columns=["home", "bucket", "told", "ones1", "twos1"])

    def heard(bucket: Bucket, back: pd.DataFrame, sums: Sums) -> Bucket:
        keys = bucket.told()[0]
        home = (mix(keys) % np.uint64(homes)).astype(np.int64)
        out = np.zeros((3, len(keys)), np.int64)
        out[:, np.argsort(home, kind="stable")] = np.concatenate([np.stack(unpack(x, np.int64, np.int64, np.int64)) for x in back.sort_values("home")["sums"]], axis=1)
        bucket.hear(*out, sums)
        return bucket

    def exchange(told: DataFrame, before: Sums | None, k: int) -> tuple[DataFrame, Sums]:
        def sum_up(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("bucket")
            got = [unpack(x, np.uint64, bool, np.int64, np.int64) for x in part["told"]]
            keys, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            tag = np.zeros(len(keys), bool)
            tag[at] = np.concatenate([g[1] for g in got])
            count, customers = (np.bincount(at, weights=np.concatenate([g[j] for g in got]), minlength=len(keys)).astype(np.int64) for j in (2, 3))
            tables = np.zeros(len(keys), np.int64)
            tables[~tag] = home_tables(keys[~tag], customers[~tag], before, how, k)
            edges = np.append(0, np.cumsum([len(g[0]) for g in got]))
            back = [pack(count[x], customers[x], tables[x]) for x in (at[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True))]
            c, c0 = count[~tag], customers[~tag]
            sums = (c.sum(), (c > 0).sum(), c0.sum(), tables.sum(), (c0 == 1).sum(), (c0 == 2).sum(), part["ones1"].sum(), part["twos1"].sum())
            out = pd.DataFrame({"bucket": part["bucket"], "home": part["home"], "sums": back, **{n: 0 for n in SUMS}})
            return pd.concat([out, pd.DataFrame([{"bucket": -1, "home": int(part["home"].iloc[0]), "sums": b"", **{n: int(x) for n, x in zip(SUMS, sums, strict=True)}}])])

        back = materialise(told.groupBy("home").applyInPandas(sum_up, "bucket int, home int, sums binary, " + ", ".join(f"{n} long" for n in SUMS)))
        total = back.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in SUMS]).first()
        release(docs.sparkSession)
        return back.filter("bucket >= 0").select("bucket", "home", "sums"), Sums(**total.asDict())

    def opened(part: pd.DataFrame) -> tuple[pd.DataFrame, Bucket]:
        part = part.sort_values("batch")
        return part, Bucket(part["pairs"].tolist(), known, how)

    told_schema = "home int, bucket int, told binary, ones1 long, twos1 long"
    first = asked.groupBy("bucket").applyInPandas(lambda part: tell(int(part["bucket"].iloc[0]), opened(part)[1]), told_schema)
    back, sums = exchange(first, None, 0)

    def rehearse(sums: Sums):
        def run(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            b = heard(opened(part)[1], answers, sums)
            for s in range(how.burn_in):
                b.sweep(s)
            return tell(int(part["bucket"].iloc[0]), b)

        return run

    for k in range(1, how.rounds):
        told = asked.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInPandas(rehearse(sums), told_schema)
        back, sums = exchange(told, sums, k)

    def answer(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        part, b = opened(part)
        heard(b, answers, sums)
        mean = np.zeros(len(b.c))
        for s in range(how.burn_in + how.samples):
            b.sweep(100 + s)
            if s >= how.burn_in:
                mean += b.probability() / how.samples
        log, count = rounded(np.log10(mean))[b.asked], b.count[b.word].astype(np.uint64)[b.asked]
        at = np.append(0, np.cumsum(b.n_pairs))
        return pd.DataFrame({"batch": part["batch"], "bucket": part["bucket"], "answer": [pack(log[i:j], count[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]})

    answers = asked.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInPandas(answer, "batch long, bucket int, answer binary")
    streams = docs.mapInArrow(_streams(buckets, known, modulus, rest), "batch long, stream binary")

    def add_up(stream: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        ids, unnamed, held, sizes, step = unpack(stream["stream"].iloc[0], np.int64, bool, bool, np.uint32, np.uint32)
        got = [unpack(x, np.uint32, np.uint64) for x in answer.sort_values("bucket")["answer"]]
        log = (np.concatenate([g[0] for g in got]) << np.uint32(8)).view(np.float32).astype(float)
        count = np.concatenate([g[1] for g in got]).astype(float)
        base = np.log10((count + 0.5) / (sums.train + 0.5 * (sums.kinds + 1)))
        sizes = sizes.astype(np.int64)
        begin = np.append(0, np.cumsum(sizes)[:-1])
        total = np.cumsum(step.astype(np.int64))
        pair = total - np.repeat(total[begin] - step[begin], sizes)
        summed = lambda x: np.add.reduceat(x[pair], begin)
        out = pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": sizes, "n_known": summed((count > 0).astype(np.int64)), "train_tokens": sums.train, "base_score": summed(base), "score": summed(log)})
        out["doc_id"] = out["doc_id"].astype("Int64").mask(unnamed)
        return out

    out = streams.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = materialise(out)
    release(docs.sparkSession)
    return out
