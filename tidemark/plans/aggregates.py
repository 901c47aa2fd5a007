"""Queries of checksums and digests of whole sequences, and of calls in flight."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import combining
from tidemark.operators import concurrent
from tidemark.plans.inputs import events, table

_E = "(SELECT user_id, event_id AS seq, event_type, value FROM events)"
#: CRC-32 of text t, bit by bit.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, len({t}) + 1), lambda i: [CAST(ascii(substr({t}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"


def _typed(s, d):
    return events(s, d, "user_id", F.col("event_type").cast("binary").alias("data"))


query("crc_by_user", f"SELECT user_id, CAST(len(t) AS BIGINT) AS n_bytes, {_CRC.format(t='t')} AS crc FROM (SELECT user_id, string_agg(event_type, '' ORDER BY seq) AS t FROM {_E} GROUP BY user_id)")(lambda s, d: combining.crc_sequence(_typed(s, d), "data", key="user_id"))
#: All documents' bytes in order; SQL has no checksum that is fast enough for them, pytest compares the same function with zlib.
query("crc_of_documents")(lambda s, d: combining.crc_sequence(table(s, d, "documents").select(F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("data")), "data"))
query("digest_by_language", "SELECT lang, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY lang")(lambda s, d: combining.digest_sequence(table(s, d, "documents").select("lang", F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("data")), "data", key="lang"))
query("observe_digest", f"SELECT user_id, seq, 0 AS part, event_type AS data FROM {_E} UNION ALL SELECT user_id, NULL, 1, md5(string_agg(event_type, '' ORDER BY seq)) FROM {_E} GROUP BY user_id")(
    lambda s, d: combining.with_digest(_typed(s, d), "data", "md5", key="user_id").withColumn("data", F.when(F.col("part") == 1, F.lower(F.hex("data"))).otherwise(F.col("data").cast("string")))
)


async def _slowly(v):
    """Stands for a call that waits."""
    import asyncio

    await asyncio.sleep(0)
    return v * 2 + 1


for _name, _f, _ordered in (("par_eval_map", lambda v: v * 2 + 1, True), ("par_eval_map_unordered", lambda v: v * 2 + 1, False), ("map_async", _slowly, True), ("map_async_unordered", _slowly, False)):
    query(_name, f"SELECT seq, value, value * 2 + 1 AS made FROM {_E}")(lambda s, d, f=_f, o=_ordered: concurrent.par_eval_map(events(s, d, "value"), "value", f, "double", "made", 16, o))
