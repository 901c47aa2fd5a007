"""Near-duplicate documents: an LSH forest proposes, full shingle sets decide, links make components.

1. Documents with equal shingle sets collapse into one representative, the smallest doc_id.
2. A representative has a MinHash signature of 128 values. The forest has 32 trees; a tree is a fixed order of signature positions, by which its rows are sorted. Rows that share a prefix of `FIRST` values are a region: a link at similarity s is missed by all trees with probability (1-s**4)**32, 5e-6 at 0.75.
3. Every representative is compared with the first of the smallest region that any tree puts it in. Most links of a group come from this, one comparison each.
4. Of regions that still hold several components each tree's sorted order is walked: a row is compared with the `reach` rows before it, its neighbours of the longest common prefix, so that depth adapts to how crowded a region is.
5. Regions that hold several components even so are searched whole. One of at most `region` rows yields its pairs between components. The rows of larger ones are joined with each other by an exact prefix filter, whatever their number: shingles are ordered by how rare they are, and of two linked sets the smaller one's first shingles of about a seventh and the larger one's of about a quarter meet in one shingle, at places that leave room for enough more. Crowded regions lose nothing.
6. Comparisons use full shingle sets; 100 * intersection >= 75 * union links. In steps 4 and 5 pairs inside a region are compared only if their signatures agree in at least four standard deviations fewer places than expected at the threshold (3e-5 to lose a link there).

Pairs inside a component are never made. Hot keys are counted map-side before they are joined, and adaptive execution splits skewed joins.

Defined results: null or empty text, or text without words, has n_shingles 0 and is linked with nothing; its component is its own doc_id. Fewer than five words are one shingle. Rows that repeat a doc_id are one document, whose texts may link to others each. A null doc_id belongs to no component (null) and is kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import byte_texts, materialise, pieces, runs, small_batches, summed
from tidemark.llm.graph import components
from tidemark.llm.words import Words, shingle_set

HASHES, TREES = 128, 32
#: Values that a region's rows share at least, and values by which a tree's order sorts further.
FIRST, FURTHER = 4, 12
#: Bits of the membership filter that spares most documents the second tokenisation.
FILTER_BITS = 1 << 23
#: Counters of the shingle counts that order shingles in the prefix filter; any order is right, a rare-first one is fast.
COUNTERS = 1 << 20
#: Parts in which tasks' counts are added up.
COUNT_PARTS = 256
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ORDERS = np.stack([_rng.permutation(HASHES)[: FIRST + FURTHER] for _ in range(TREES)])


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash of a nonempty set: the least of each of 128 hash orders."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        least = np.minimum(least, (x[lo : lo + 512, None] * _MULTIPLY + _ADD).min(axis=0))
    return least


def region_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature, the key of its region in each tree."""
    key = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(FIRST)
    key = np.broadcast_to(key, (len(signatures), TREES))
    for k in range(FIRST):
        key = (key ^ signatures[:, _ORDERS[:, k]].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        key = key ^ (key >> np.uint64(29))
    return key


def _sign(width: int):
    import hashlib

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), byte_texts(batch.column(1))
            for lo, hi in runs(texts):
                words = Words(texts[lo:hi])
                n, mark, sig = [], [], []
                for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                    s = shingle_set(words.hash[a:b], width)
                    n.append(len(s))
                    mark.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "mark", "sig"])

    return run


def _keys(batches):
    """Rows (key, rid) of every tree, from (rid, sig)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rid = batch.column(0).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
        for lo in range(0, len(rid), 4096):
            keys = region_keys(sig[lo : lo + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rid[lo : lo + 4096], TREES))], ["key", "rid"])


def _places(batches):
    """Rows (key, further, rid, comp, low) of the trees whose keys are given, from (rid, comp, sig, keys). further: the values that follow in the tree's order, as bytes that sort like them; low: the lowest byte of each value, enough to count agreements."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            rids, comps, sigs, lists = (c.to_pylist() for c in batch.slice(lo, 1024).columns)
            sig = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES)
            keys = region_keys(sig).view(np.int64)
            row, tree = np.nonzero(np.stack([np.isin(o, k) for o, k in zip(keys, lists, strict=True)]))
            further = sig[row[:, None], _ORDERS[tree, FIRST:]].astype(">u4")
            low = sig.astype(np.uint8)
            of = lambda x: pa.array(np.asarray(x, np.int64)[row])
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, tree]), pa.array([x.tobytes() for x in further], pa.binary()), of(rids), of(comps), pa.array([low[i].tobytes() for i in row], pa.binary())], ["key", "further", "rid", "comp", "low"])


def agreeing(percent: int) -> float:
    """Least number of equal signature places of a pair worth comparing."""
    p = percent / 100
    return HASHES * p - 4 * (HASHES * p * (1 - p)) ** 0.5


def _neighbours(reach: int, percent: int):
    """(a, b): the rows of a sorted order and those up to `reach` before them in the same region, of other components, whose signatures agree enough. Neighbours on different tasks are left to the search of regions."""
    enough = agreeing(percent)

    def run(batches):
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)] + [np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)]
            cols = cols if tail is None else [np.concatenate([t, c]) for t, c in zip(tail, cols, strict=True)]
            key, rid, comp, low = cols
            a, b = [], []
            for step in range(1, reach + 1):
                at = np.flatnonzero((key[step:] == key[:-step]) & (comp[step:] != comp[:-step]))
                at = at[(low[at] == low[at + step]).sum(axis=1) >= enough]
                a.append(np.minimum(rid[at], rid[at + step]))
                b.append(np.maximum(rid[at], rid[at + step]))
            tail = [c[-reach:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _sets_of(wanted: np.ndarray, width: int):
    """(rid, shingles) of the documents that the membership filter lets through."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(bloom.lets_through(wanted, ids))
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            texts = byte_texts(batch.column(1))
            for lo, hi in runs(texts):
                words = Words(texts[lo:hi])
                sets = [shingle_set(words.hash[a:b], width).tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["rid", "shingles"])

    return run


def linked(n_a: int, n_b: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (n_a + n_b - shared)


def _compare(percent: int):
    """(a, b, sa, sb) to the pairs that are linked."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, sx, sy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) and linked(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True)), percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _pairs_between(percent: int):
    """Lists of (rid, comp, low) of small regions to the pairs whose components differ and whose signatures agree in enough places: at the threshold, four standard deviations fewer than expected. low holds the lowest byte of each value; values that agree agree there, so no pair is lost by it."""
    enough = agreeing(percent)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                rid = np.array([m["rid"] for m in members])
                comp = np.array([m["comp"] for m in members])
                sig = np.frombuffer(b"".join(m["low"] for m in members), np.uint8).reshape(-1, HASHES)
                i, j = np.nonzero(np.triu(comp[:, None] != comp[None, :]))
                close = (sig[i] == sig[j]).sum(axis=1) >= enough
                a.append(np.minimum(rid[i], rid[j])[close])
                b.append(np.maximum(rid[i], rid[j])[close])
            cat = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cat[:, 0])), pa.array(np.ascontiguousarray(cat[:, 1]))], ["a", "b"])

    return run


def _counters(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) % COUNTERS


def _counted(batches) -> tuple[np.ndarray, np.ndarray]:
    """Counters of the shingles of a column of sets, and their counts."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for s in batch.column(0).to_pylist():
            np.add.at(total, _counters(np.frombuffer(s, np.uint64)), 1)
    at = np.flatnonzero(total)
    return at, total[at].astype(float)


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles stand in a column of sets, by counter; COUNTERS numbers come to the driver, however many shingles there are. A task's counts are at most `COUNT_PARTS` rows."""
    out = np.zeros(COUNTERS, np.int64)
    at, n = summed(sets, _counted, COUNT_PARTS)
    out[at] = n
    return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles of a set of n must meet those of a linked set that is no smaller, and of one that is no larger."""
    return n + (-2 * percent * n // (100 + percent)) + 1, n + (-percent * n // 100) + 1


def _prefixes(percent: int, counts: np.ndarray):
    """(rid, comp, shingles) to (shingle, rid, comp, n, at, leads) of each set's prefix; leads: within the prefix that meets larger sets."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for rid, comp, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(blob, np.uint64)
                n = len(s)
                if not n:
                    continue
                short, long = prefix_lengths(n, percent)
                first = s[np.lexsort((s, counts[_counters(s)]))[:long]].view(np.int64)
                at = np.arange(len(first))
                for c, x in zip(cols, (first, np.full(len(first), rid), np.full(len(first), comp), np.full(len(first), n), at, at < short), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["shingle", "rid", "comp", "n", "at", "leads"])

    return run


def _crowd_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of sets (rid, comp, shingles) of different components that can be linked, and few others."""
    counts = _shingle_counts(sets.select("shingles"))
    first = materialise(sets.select("rid", "comp", "shingles").mapInArrow(_prefixes(percent, counts), "shingle long, rid long, comp long, n long, at long, leads boolean"))
    # Pairs inside a shingle's main component are never made.
    per = first.groupBy("shingle", "comp").agg(F.count("*").alias("c"), F.max("leads").alias("leads"))
    mixed = per.groupBy("shingle").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.max("leads").alias("any")).filter("comps > 1 and any").select("shingle", "main")
    rows = materialise(first.join(mixed, "shingle").withColumn("stray", F.col("comp") != F.col("main")).drop("main"))
    x, y = (rows.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("rid", "comp", "n", "at", "leads", "stray")]) for k in "xy")
    x = x.filter("leads_x")
    able = f"comp_x <> comp_y and n_x <= n_y and 100 * n_x >= {percent} * n_y and {100 + percent} * least(n_x - at_x, n_y - at_y) >= {percent} * (n_x + n_y)"
    both = x.filter("stray_x").join(y, "shingle").filter(able).unionByName(x.filter("not stray_x").join(y.filter("stray_y"), "shingle").filter(able))
    return both.select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, region: int = 48, reach: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_sign(width), "doc_id long, n_shingles long, mark binary, sig binary"))
    named = signed.filter("doc_id is not null and mark is not null")
    reps = materialise(named.groupBy("mark").agg(F.min(F.struct("doc_id", "sig")).alias("m")).select("mark", F.col("m.doc_id").alias("rid"), F.col("m.sig").alias("sig")))

    keys = materialise(reps.select("rid", "sig").mapInArrow(_keys, "key long, rid long").transform(_crowded))
    leaders = keys.groupBy("rid").agg(F.min("leader").alias("leader"))
    wanted = bloom.build(keys.select("rid").distinct(), FILTER_BITS)
    parts = pieces(docs, 8, 4)
    sets = docs.filter("doc_id is not null").mapInArrow(_sets_of(wanted, width), "rid long, shingles binary")
    sets = materialise(sets.join(keys.select("rid").distinct(), "rid", "left_semi").repartition(parts, "rid").dropDuplicates(["rid", "shingles"]))

    def check(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")), "b")
        both = one.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")), "a")
        return materialise(both.select("a", "b", "sa", "sb").mapInArrow(_compare(percent), "a long, b long"))

    def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows (key, rid, comp, n) of regions with several components."""
        with_comp = rows.join(labels, rows["rid"] == labels["node"], "left").select("key", "rid", F.coalesce("component", "rid").alias("comp"))
        several = with_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
        return materialise(with_comp.join(several, "key"))

    found = check(leaders.filter("leader <> rid").select(F.col("leader").alias("a"), F.col("rid").alias("b")))
    rows = mixed(keys.select("key", "rid"), components(found))

    signatures = reps.select("rid", "sig")
    placed = lambda r: r.groupBy("rid").agg(F.first("comp").alias("comp"), F.collect_list("key").alias("keys")).join(signatures, "rid").select("rid", "comp", "sig", "keys").mapInArrow(_places, "key long, further binary, rid long, comp long, low binary")
    order = placed(rows).repartitionByRange(parts, "key", "further", "rid").sortWithinPartitions("key", "further", "rid")
    near = materialise(order.select("key", "rid", "comp", "low").mapInArrow(_neighbours(reach, percent), "a long, b long").distinct())
    found = found.unionByName(check(near))

    rows = mixed(rows.select("key", "rid"), components(found))
    listed = placed(rows.filter(F.col("n") <= region)).groupBy("key").agg(F.collect_list(F.struct("rid", "comp", "low")).alias("m"))
    within = materialise(listed.select("m").mapInArrow(_pairs_between(percent), "a long, b long").distinct())
    found = found.unionByName(check(within))

    crowds = rows.filter(F.col("n") > region)
    if crowds.take(1):
        crowd = mixed(crowds.select("key", "rid"), components(found)).select("rid", "comp").distinct()
        crowd = materialise(sets.join(crowd, "rid").select("rid", "comp", "shingles"))
        found = found.unionByName(check(materialise(_crowd_pairs(crowd, percent))))

    # Documents that share a set, and rows that share a doc_id, belong together.
    same = named.join(reps.select("mark", "rid"), "mark").select("doc_id", "rid").filter("doc_id <> rid").select(F.col("rid").alias("a"), F.col("doc_id").alias("b"))
    final = components(found.unionByName(same))
    joined = signed.select("doc_id", "n_shingles").join(final, signed["doc_id"] == final["node"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _crowded(keys: DataFrame) -> DataFrame:
    """(key, rid, leader) of the keys that several rows have; the leader is the least rid of the key."""
    several = keys.groupBy("key").agg(F.min("rid").alias("leader"), F.max("rid").alias("last")).filter("leader <> last").select("key", "leader")
    return keys.join(several, "key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all columns; of rows that repeat a doc_id one stays."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    null, named = left.filter("doc_id is null"), left.filter("doc_id is not null")
    return named.dropDuplicates(["doc_id"]).unionByName(null)
