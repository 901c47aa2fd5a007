"""Queries of binary records, captures, files and byte ranges: what is written is read back, and SQL says what must come."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import records
from tidemark.operators.grouping import chunk_n
from tidemark.operators.ordered import with_index
from tidemark.operators.storage import fresh_folder
from tidemark.operators.timeseries import micros
from tidemark.plans.inputs import events, table
from tidemark.sources import captures, files, ranges

E = "(SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 64 AS chunk, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 64 AS INTEGER) AS record_no FROM events)"
LAYOUT = [("seq", 8, "uint"), ("us", 8, "int"), ("cents", 4, "int"), ("code", 1, "bytes")]
GROUP = ["user_id", "chunk"]


def _encoded(s, d):
    """Blocks of up to 64 records of a user."""
    e = chunk_n(events(s, d, "user_id", "ts", "value", "event_type"), 64, key="user_id")
    rows = e.select(*GROUP, "seq", micros("ts").alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.substring("event_type", 1, 1).cast("binary").alias("code"))
    return records.joined(rows.select(*GROUP, "seq", records.encode(LAYOUT).alias("data")), GROUP, F.col("data"))


_HEX = "string_agg(printf('%016x%016x', seq, us) || lower(right('0000000' || to_hex(CASE WHEN cents < 0 THEN 4294967296 + cents ELSE cents END), 8)) || lower(hex(encode(left(event_type, 1)))), '' ORDER BY seq)"
query("records_encode", f"SELECT user_id, chunk, md5({_HEX}) AS hex FROM {E} GROUP BY user_id, chunk")(lambda s, d: _encoded(s, d).select(*GROUP, F.md5(F.lower(F.hex("data"))).alias("hex")))
query("records_many", f"SELECT user_id, chunk, record_no, seq, us, cents, left(event_type, 1) AS code FROM {E}")(lambda s, d: records.explode(_encoded(s, d), records.many(F.col("data"), LAYOUT), GROUP).withColumn("code", F.col("code").cast("string")))
query("records_try_many", f"SELECT user_id, chunk, record_no, seq FROM (SELECT *, bool_and(cents < 9500) OVER (PARTITION BY user_id, chunk ORDER BY seq) AS ok FROM {E}) WHERE ok")(
    lambda s, d: records.explode(_encoded(s, d), records.many(F.col("data"), LAYOUT, lambda r: r["cents"] < 9500, quiet=True), GROUP).select(*GROUP, "record_no", "seq")
)
query("records_once", f"SELECT user_id, chunk, min(seq) AS seq, arg_min(us, seq) AS us, CAST(21 * (count(*) - 1) AS BIGINT) AS rest, coalesce(max(seq) FILTER (record_no = 1), -1) AS second FROM {E} GROUP BY user_id, chunk")(
    lambda s, d: _encoded(s, d).select(*GROUP, *[records.once(F.col("data"), LAYOUT)[0][c].alias(c) for c in ("seq", "us")], F.length(records.once(F.col("data"), LAYOUT)[1]).cast("long").alias("rest"), F.coalesce(records.once(records.once(F.col("data"), LAYOUT)[1], LAYOUT, quiet=True)[0]["seq"], F.lit(-1)).alias("second"))
)
_COUNTED = [("n", 2, "uint"), ("user", 4, "uint")]


def _counted(s, d):
    whole = _encoded(s, d).select(*GROUP, F.concat(records.encode(_COUNTED, {"n": F.length("data") / 21, "user": F.col("user_id")}), F.col("data"), F.lit(b"tail")).alias("data"))
    return whole.select(*GROUP, records.counted(F.col("data"), _COUNTED, "n", LAYOUT).alias("c")).select(*GROUP, F.col("c.header.n").alias("n"), F.col("c.header.user").alias("user"), F.element_at("c.records", -1)["seq"].alias("last"))


query("records_counted", f"SELECT user_id, chunk, count(*) AS n, user_id AS user, max(seq) AS last FROM {E} GROUP BY user_id, chunk")(_counted)
query("records_isolate", f"SELECT user_id, chunk, min(seq) AS seq, arg_min(us, seq) AS us FROM {E} GROUP BY user_id, chunk")(
    lambda s, d: _encoded(s, d).select(*GROUP, records.decode(records.isolate(F.col("data"), 8), LAYOUT[:1])["seq"].alias("seq"), records.decode(records.ignore(F.col("data"), 8), LAYOUT[1:])["us"].alias("us"))
)
query("records_framed", "SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS record_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line")).transform(lambda x: records.joined(x.select("doc_id", "seq", records.framed(F.col("line").cast("binary")).alias("data")), ["doc_id"], F.col("data"))).select("doc_id", F.posexplode(records.frames(F.col("data"))).alias("record_no", "line")).withColumn("line", F.col("line").cast("string"))
)

_MAC = [("dst", 6, "uint"), ("src", 6, "uint"), ("type", 2, "uint")]
_IP = [("vihl", 1, "uint"), ("tos", 1, "uint"), ("total", 2, "uint"), ("id", 2, "uint"), ("frag", 2, "uint"), ("ttl", 1, "uint"), ("protocol", 1, "uint"), ("sum", 2, "uint"), ("from", 4, "uint"), ("to", 4, "uint")]
_TCP = [("sport", 2, "uint"), ("dport", 2, "uint"), ("sequence", 4, "uint"), ("ack", 4, "uint"), ("offset", 1, "uint"), ("flags", 1, "uint"), ("window", 2, "uint"), ("tsum", 2, "uint"), ("urgent", 2, "uint")]
_UDP = [("sport", 2, "uint"), ("dport", 2, "uint"), ("length", 2, "uint"), ("usum", 2, "uint")]


def _frames(s, d):
    """(seq, ts, data): a TCP segment for each click, a UDP datagram for every other event, with the event's type as payload. Every third header has four bytes of options; no-operations, that is. A source address ends with the user's lowest 16 bits."""
    e = events(s, d, "ts", "user_id", "event_type")
    n = F.length("event_type")
    tcp, options = F.col("event_type") == "click", F.col("seq") % 3 == 0
    header = F.when(options, 24).otherwise(20)
    body = F.when(tcp, n + 20).otherwise(n + 8)
    ip = {"vihl": 64 + header / 4, "tos": F.lit(0), "total": header + body, "id": F.col("seq") % 65536, "frag": F.lit(0), "ttl": F.lit(64), "protocol": F.when(tcp, 6).otherwise(17), "sum": F.lit(0), "from": F.lit(0x0A000000) + F.col("user_id"), "to": F.lit(0xC0A80001)}
    tcp_fields = {"sport": 1024 + F.col("user_id") % 1000, "dport": F.lit(443), "sequence": F.col("seq"), "ack": F.col("seq") + 1, "offset": F.lit(0x50), "flags": F.lit(0x18), "window": F.lit(4096), "tsum": F.lit(0), "urgent": F.lit(0)}
    udp_fields = {"sport": 1024 + F.col("user_id") % 1000, "dport": F.lit(53), "length": n + 8, "usum": F.lit(0)}
    bare = F.concat(records.encode(_IP, ip), F.when(options, F.lit(b"\1\1\1\1")).otherwise(F.lit(b"")))
    rows = e.withColumn("bare", bare).withColumn("sum", captures.checksum(F.col("bare"), 0, F.length("bare")))
    whole = F.concat(records.encode(_MAC, {"dst": F.lit(0xFFFFFFFFFFFF), "src": F.lit(0x020000000000) + F.col("user_id") % 65536, "type": F.lit(0x0800)}), F.substring("bare", 1, 10), records.encode([("sum", 2, "uint")]), F.substring(F.col("bare"), F.lit(13), F.length("bare") - 12), F.when(tcp, records.encode(_TCP, tcp_fields)).otherwise(records.encode(_UDP, udp_fields)), F.col("event_type").cast("binary"))
    return rows.select("ts", whole.alias("data"))


def _captured(kind):
    def run(s, d):
        captures.register(s)
        _frames(s, d).write.format(kind).mode("append").save(folder := fresh_folder(s, kind))
        return s.read.format(kind).load(folder)

    return run


def _headers(s, d):
    out = captures.with_transport(captures.with_headers(_captured("pcap")(s, d)))
    at = F.coalesce("tcp.payload_at", "udp.payload_at")
    return out.select(micros("ts").alias("us"), "incl_len", captures.named(F.col("link"), captures.LINKS).alias("link"), "eth.src", F.col("ip.src").alias("ip_src"), "ip.protocol", F.length("ip_options").cast("long").alias("options"), "ip_intact", F.coalesce("tcp.src", "udp.src").alias("port"), "tcp.sequence", "tcp.flags.psh", "tcp.flags.syn", F.col("udp.length").alias("datagram"), F.substring(F.col("data"), (at + 1).cast("int"), F.length("data")).cast("string").alias("payload"))


_N = "length(event_type)"
query("pcap_headers", f"SELECT epoch_us(ts) AS us, CAST(14 + CASE WHEN event_id % 3 = 0 THEN 24 ELSE 20 END + CASE WHEN event_type = 'click' THEN 20 ELSE 8 END + {_N} AS BIGINT) AS incl_len, 'ethernet' AS link, '02:00:00:00:' || lower(right('00' || to_hex(user_id // 256), 2)) || ':' || lower(right('00' || to_hex(user_id % 256), 2)) AS src, '10.' || user_id // 65536 || '.' || user_id // 256 % 256 || '.' || user_id % 256 AS ip_src, CASE WHEN event_type = 'click' THEN 6 ELSE 17 END AS protocol, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END AS options, true AS ip_intact, 1024 + user_id % 1000 AS port, CASE WHEN event_type = 'click' THEN event_id END AS sequence, CASE WHEN event_type = 'click' THEN true END AS psh, CASE WHEN event_type = 'click' THEN false END AS syn, CASE WHEN event_type <> 'click' THEN {_N} + 8 END AS datagram, event_type AS payload FROM events")(_headers)
query("pcapng_roundtrip", f"SELECT epoch_us(ts) AS us, CAST(14 + CASE WHEN event_id % 3 = 0 THEN 24 ELSE 20 END + CASE WHEN event_type = 'click' THEN 20 ELSE 8 END + {_N} AS BIGINT) AS n, CAST(1 AS INTEGER) AS link FROM events")(
    lambda s, d: _captured("pcapng")(s, d).select(micros("ts").alias("us"), F.length("data").cast("long").alias("n"), "link")
)


def _blocks(s, d):
    captures.register(s)
    _frames(s, d).coalesce(1).write.format("pcapng").mode("append").save(folder := fresh_folder(s, "blocks"))
    return s.read.format("pcapng_blocks").load(folder).groupBy(captures.named(F.col("kind"), captures.BLOCKS).alias("kind")).agg(F.count("*").alias("n"))


query("pcapng_blocks", "SELECT 'section' AS kind, 1 AS n UNION ALL SELECT 'interface', 1 UNION ALL SELECT 'enhanced packet', count(*) FROM events HAVING count(*) > 0")(_blocks)


def _lines(s, d):
    rows = events(s, d, F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))
    files.write_lines(rows, folder := fresh_folder(s, "lines"), "line")
    return folder


_WORDS = "event_type || ' ' || user_id"
query("write_lines_read_lines", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, {_WORDS} AS value FROM events")(
    lambda s, d: with_index(files.written(s, f"{_lines(s, d)}/part-*").filter("value <> ''").select(F.struct("file", "pos").alias("o"), "value"), "o").drop("o")
)
query("files_attributes", f"SELECT '.txt' AS extension, false AS is_empty, CAST(sum(length({_WORDS}) + 1) AS BIGINT) AS bytes FROM events HAVING count(*) > 0")(
    lambda s, d: files.attributes(s, _lines(s, d), "part-*").groupBy("extension", "is_empty").agg(F.sum("length").alias("bytes")).filter("not is_empty")
)


def _one_file(s, d):
    """The lines as one file: a writer of one task, as a file has one writer."""
    events(s, d, F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line")).sort("seq").select("line").coalesce(1).write.text(folder := fresh_folder(s, "file"))
    return f"{folder}/part-*"


_ALL = f"(SELECT string_agg({_WORDS} || chr(10), '' ORDER BY event_id) AS t FROM events)"
query("byte_ranges", f"SELECT i AS off, substr(t, CAST(i + 1 AS BIGINT), 1000) AS piece FROM {_ALL}, LATERAL (SELECT unnest(range(0, length(t), 1000)) AS i)")(lambda s, d: ranges.read(s, _one_file(s, d), chunk=1000, span=16_000).select("off", F.col("data").cast("string").alias("piece")))
query("read_range", f"SELECT substr(t, 101, 900) AS piece FROM {_ALL}")(lambda s, d: files.read_range(s, _one_file(s, d), 100, 1000).select(F.col("data").cast("string").alias("piece")))
query("read_until", f"SELECT i AS off, substr(t, CAST(i + 1 AS BIGINT), least(64, 777 - i)) AS piece FROM {_ALL}, LATERAL (SELECT unnest(range(500, least(length(t), 777), 64)) AS i)")(lambda s, d: ranges.read(s, _one_file(s, d), 500, 777, 64).select("off", F.col("data").cast("string").alias("piece")))
