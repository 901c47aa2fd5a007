"""The prefix trie of conversations, by van Emde Boas recursion.

A conversation is a path of turns from the root. The trie's height, a power of two, is cut at half depth: the prefixes that end at the cut are named, which splits the trie into an upper one and a forest of lower ones below the named prefixes; all of these are cut again at their half depths, in one step, until each holds a single turn. A prefix is named by the smallest conv_id that begins with it. Two conversations have the same name at a cut if they had the same one at the cut above and the same turns between; those are compared by SHA-256 digests, joined in pairs once for each block length. A step names the cuts of its length alone, so all steps together handle each turn about once.

Totals of subtrees go the other way: those of lower tries of height h are grafted onto the upper tries of height h above them, whose nodes add what hangs below them, then 2 h and so on. A step adds at most a row for every two turns.

Nothing gathers a conversation or a node's members in one task: turns are numbered by a range sort over all conversations; joins on hot prefixes have one row a prefix on their other side; the ids that a node's digest covers are streamed in order, in blocks.

Defined results: turns are ordered by turn (null first), and where that is equal by role, then text; a null role or text is empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; an empty table has no root and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.operators.ordered import with_index

#: Ids of a node that are written as one text before they are hashed.
BLOCK = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that tell (role, text) from any other turn."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), dig and n_bytes of every turn."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", F.octet_length("text").cast("long").alias("n_bytes"), turn_digest(F.col("role"), F.col("text")).alias("dig"))
    placed = with_index(rows, order=["conv_id", "turn", "role", "text"]).select("conv_id", "idx", "n_bytes", "dig")
    first = placed.groupBy("conv_id").agg(F.min("idx").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("idx") - F.col("first")).alias("pos"), "n_bytes", "dig")


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: conv_id, d (from 1), n_bytes, dig of every turn; conv_id and length of each."""
    turns = numbered(conversations)
    paths = materialise(turns.select("conv_id", (F.col("pos") + 1).alias("d"), "n_bytes", "dig"))
    return paths, paths.groupBy("conv_id").agg(F.max("d").alias("length"))


def regrown(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns taken from conversation c - c % family (all if it has fewer, none if it is absent), h being crc32 of the decimal id modulo `most`. Same columns as sequences()."""
    turns = materialise(numbered(conversations))
    lengths = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("own"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    c = lengths.select("conv_id", "own", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % family).alias("giver"))
    c = materialise(c.join(lengths.select(F.col("conv_id").alias("giver"), F.col("own").alias("theirs")), "giver", "left").withColumn("taken", F.least("head", F.coalesce("theirs", F.lit(0)))))
    given = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "giver").join(c.select("conv_id", "giver", "taken"), "giver").filter("pos < taken")
    kept = turns.join(c.select("conv_id", "head", "taken"), "conv_id").filter("pos >= head")
    paths = given.select("conv_id", (F.col("pos") + 1).alias("d"), "n_bytes", "dig").unionByName(kept.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("d"), "n_bytes", "dig"))
    return materialise(paths), c.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))


def named_prefixes(paths: DataFrame, ids: DataFrame, steps: int) -> DataFrame:
    """conv_id, depth and name of every prefix, the empty one included. Paths have fewer than 2 ** steps turns."""
    blocks = [paths.select("conv_id", (F.col("d") - 1).alias("i"), "dig")]
    even = F.col("i") % 2 == 0
    for _ in range(1, steps):  # digests of whole blocks of 2, 4, 8 ... turns
        pair = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i2")).agg(F.max(F.when(even, F.col("dig"))).alias("a"), F.max(F.when(~even, F.col("dig"))).alias("b"))
        blocks.append(materialise(pair.filter("a IS NOT NULL AND b IS NOT NULL").select("conv_id", F.col("i2").alias("i"), F.unhex(F.sha2(F.concat("a", "b"), 256)).alias("dig"))))
    smallest = ids.agg(F.min("conv_id").alias("name"))
    names = materialise(ids.select("conv_id", F.lit(0).cast("long").alias("depth")).crossJoin(F.broadcast(smallest)))
    for j in reversed(range(steps)):  # every trie of height 2 h is cut after h turns
        h = 1 << j
        cut = names.join(blocks[j].filter(even).select("conv_id", (F.col("i") * h).alias("depth"), "dig"), ["conv_id", "depth"])
        # Written, so that the join below deals its sides anew and a hot prefix can be split.
        same = materialise(cut.groupBy("depth", "name", "dig").agg(F.min("conv_id").alias("new")))
        below = cut.join(same, ["depth", "name", "dig"]).select("conv_id", (F.col("depth") + h).alias("depth"), F.col("new").alias("name"))
        names = materialise(names.unionByName(below))
    return names


def grafted(nodes: DataFrame, names: DataFrame, steps: int, values: list[str]) -> DataFrame:
    """depth, name and the sums of the values over each node's subtree. nodes: depth, name and a node's own values."""
    total = nodes.select("depth", "name", *values)
    for j in range(steps):
        h = 1 << j
        at = F.floor(F.col("depth") / (2 * h)).alias("at")
        lower = total.filter(F.col("depth") % (2 * h) == h).select(F.col("name").alias("conv_id"), at, *values)
        upper = names.filter(F.col("depth") % (2 * h) < h).select("conv_id", at, "depth", "name")
        hung = lower.join(upper, ["conv_id", "at"]).select("depth", "name", *values)
        total = materialise(total.unionByName(hung).groupBy("depth", "name").agg(*[F.sum(v).alias(v) for v in values]))
    return total


def ends(names: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, name and ends_sha256 of every node where conversations end."""
    ending = names.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("depth", "name", "conv_id")

    def written(batches):
        """Runs of ids of a node as one text each."""
        for batch in batches:
            out: list[tuple] = []
            for depth, name, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not out or out[-1][:2] != (depth, name) or len(out[-1][3]) == BLOCK:
                    out.append((depth, name, c, []))
                out[-1][3].append(str(c))
            yield pa.RecordBatch.from_pylist([{"depth": a, "name": b, "first": c, "ids": ",".join(x)} for a, b, c, x in out], schema=pa.schema([("depth", pa.int64()), ("name", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    def hashed(batches):
        """The texts of a node in order, hashed as they come; only the digest is held."""
        now, digest = None, None
        schema = pa.schema([("depth", pa.int64()), ("name", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for depth, name, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (depth, name) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (depth, name), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, digest.hexdigest()), strict=True))], schema=schema)

    texts = ending.sort("depth", "name", "conv_id").mapInArrow(written, "depth long, name long, first long, ids string")
    return texts.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(hashed, "depth long, name long, ends_sha256 string")


def trie(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    lengths = materialise(lengths)
    height = lengths.agg(F.max("length")).first()[0] or 0
    steps = max(1, height.bit_length())
    names = named_prefixes(paths, lengths, steps)
    own = names.filter("conv_id = name")
    up = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_conv_id"))
    members = names.groupBy("depth", "name").agg(F.count("*").alias("n_convs"))
    nodes = own.join(up, ["conv_id", "depth"], "left").join(paths.select("conv_id", F.col("d").alias("depth"), "n_bytes"), ["conv_id", "depth"], "left").select("depth", "name", "parent_conv_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(members, ["depth", "name"]).join(children, ["depth", "name"], "left").na.fill(0, ["n_children"])
    nodes = materialise(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}))
    total = grafted(nodes, names, steps, ["n_leaves", "saved_tokens"])
    out = nodes.drop("n_leaves", "saved_tokens", "n_bytes").join(total, ["depth", "name"]).join(ends(names, lengths), ["depth", "name"], "left")
    return out.select(F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


ORACLE_SQL = """
WITH RECURSIVE o AS (
  SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS own FROM o GROUP BY c),
h AS (SELECT c, own, c - c % 5 AS giver, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT)) % 9 AS head FROM n),
t AS (SELECT h.*, least(head, coalesce(g.own, 0)) AS taken FROM h LEFT JOIN n AS g ON g.c = h.giver),
p AS (SELECT t.c, o.pos + 1 AS d, o.role, o.text FROM t JOIN o ON o.c = t.giver AND o.pos < t.taken
  UNION ALL SELECT t.c, o.pos - t.head + t.taken + 1, o.role, o.text FROM t JOIN o ON o.c = t.c AND o.pos >= t.head),
l AS (SELECT t.c, count(p.d) AS length FROM t LEFT JOIN p ON p.c = t.c GROUP BY t.c),
k AS (SELECT c, CAST(0 AS BIGINT) AS d, CAST((SELECT min(c) FROM n) AS BIGINT) AS name, CAST(0 AS BIGINT) AS bytes FROM n
  UNION ALL SELECT k.c, k.d + 1, CAST(min(k.c) OVER (PARTITION BY k.d, k.name, p.role, p.text) AS BIGINT), CAST(strlen(p.text) AS BIGINT) FROM k JOIN p ON p.c = k.c AND p.d = k.d + 1),
m AS (SELECT d, name, count(*) AS n_convs, max(bytes) AS bytes FROM k GROUP BY d, name),
v AS (SELECT m.*, u.name AS parent FROM m LEFT JOIN k AS u ON u.c = m.name AND u.d = m.d - 1),
w AS (SELECT v.*, coalesce(x.n, 0) AS n_children FROM v LEFT JOIN (SELECT d - 1 AS d, parent, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL) AS x ON x.d = v.d AND x.parent = v.name),
s AS (SELECT k.d, k.name, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved FROM w JOIN k ON k.c = w.name AND k.d <= w.d GROUP BY k.d, k.name),
e AS (SELECT k.d, k.name, string_agg(CAST(k.c AS VARCHAR), ',' ORDER BY k.c) AS ids FROM k JOIN l ON l.c = k.c AND l.length = k.d GROUP BY k.d, k.name)
SELECT w.name AS conv_id, w.d AS depth, w.parent AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN s ON s.d = w.d AND s.name = w.name LEFT JOIN e ON e.d = w.d AND e.name = w.name"""
