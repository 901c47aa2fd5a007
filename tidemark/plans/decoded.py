"""Queries of composed decoders over events that are written as frames of several kinds and cut into pieces of seven bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import decoders as D
from tidemark.functions import records
from tidemark.operators.ordered import spread
from tidemark.plans.inputs import events

#: A tag, then what the tag says: a text with its length before it, or a number and a list of as many of its digits as a count says.
FRAME = D.record(tag=D.kept(D.uint(1), lambda t: t in (1, 2)), seq=D.uint(4), body=D.choice("tag", {1: D.then(D.uint(1), D.utf8), 2: D.record(cents=D.uint(4), count=D.uint(1), digits=D.after(lambda r: D.repeat(r["count"], D.uint(1))))}))
_FLAT = D.emitted(D.many(FRAME), lambda r: D.emits([{"seq": r["seq"], "said": r["body"]} if r["tag"] == 1 else {"seq": r["seq"], "cents": r["body"]["cents"], "digits": r["body"]["digits"]}]))


def _pieces(s, d):
    """(user_id, off, data): each user's frames one after another, in pieces of seven bytes."""
    e = events(s, d, "user_id", "event_type", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    text = F.concat(records.encode([("n", 1, "uint")], {"n": F.length("event_type")}), F.col("event_type").cast("binary"))
    digits = F.col("cents").cast("string")
    number = F.concat(records.encode([("c", 4, "uint"), ("n", 1, "uint")], {"c": F.col("cents"), "n": F.length(digits)}), F.unhex(F.regexp_replace(digits, "(.)", "0$1")))
    frame = F.concat(records.encode([("t", 1, "uint"), ("s", 4, "uint")], {"t": F.when(F.col("event_type") == "click", 1).otherwise(2), "s": F.col("seq")}), F.when(F.col("event_type") == "click", text).otherwise(number))
    whole = e.withColumn("frame", frame).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.hex("frame").alias("h")))).alias("x")).select("user_id", F.unhex(F.array_join(F.transform("x", lambda p: p["h"]), "")).alias("all"))
    cut = spread(whole, F.lit(0), F.floor((F.octet_length("all") - 1) / 7), "k")
    return cut.select("user_id", (F.col("k") * 7).alias("off"), F.substring(F.col("all"), (F.col("k") * 7 + 1).cast("int"), F.lit(7)).alias("data"))


_E = "(SELECT user_id, event_id AS seq, event_type, CAST(floor(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"
query("decode_choice", f"SELECT user_id, n, seq, CASE WHEN event_type = 'click' THEN event_type END AS said, CASE WHEN event_type <> 'click' THEN cents END AS cents, CASE WHEN event_type <> 'click' THEN list_sum(list_transform(string_split(CAST(cents AS VARCHAR), ''), lambda x: CAST(x AS BIGINT))) END AS digits FROM {_E}")(
    lambda s, d: D.decode_pieces(_pieces(s, d), _FLAT, "seq long, said string, cents long, digits array<long>", key="user_id", strict=True).withColumn("digits", F.aggregate("digits", F.lit(0).cast("long"), lambda a, x: a + x))
)
#: A mark of its own, then the numbers among the frames, quietly up to the first number above 9000.
_UPTO = D.append(D.emits([{"seq": -1}]), D.emitted(D.many(D.kept(FRAME, lambda r: r["tag"] == 1 or r["body"]["cents"] <= 9000), quiet=True), lambda r: D.emits([{"seq": r["seq"]}] if r["tag"] == 2 else [])))
query("decode_until_bad", f"WITH f AS (SELECT user_id, min(seq) AS stop FROM {_E} WHERE event_type <> 'click' AND cents > 9000 GROUP BY user_id), r AS (SELECT DISTINCT user_id, -1 AS seq FROM {_E} UNION ALL SELECT e.user_id, e.seq FROM {_E} AS e LEFT JOIN f USING (user_id) WHERE event_type <> 'click' AND (stop IS NULL OR e.seq < stop)) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS BIGINT) AS n, CAST(seq AS BIGINT) AS seq FROM r")(
    lambda s, d: D.decode_pieces(_pieces(s, d), _UPTO, "seq long", key="user_id")
)
