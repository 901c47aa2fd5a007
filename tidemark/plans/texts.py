"""Queries of the text, hash and compression functions, on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import compression, hashing, text
from tidemark.plans.inputs import table
from tidemark.sources import files



def _docs(name, sql, columns):
    query(name, f"SELECT doc_id, {sql} FROM documents" if sql else None)(lambda s, d: table(s, d, "documents").select("doc_id", *columns(F.col("text"))))


query("text_lines", "SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS line_no, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS x FROM documents WHERE text <> '')")(lambda s, d: text.explode_lines(table(s, d, "documents"), "text", ["doc_id"]))
_docs("text_utf8_roundtrip", "md5(text) AS back, CAST(strlen(text) AS INTEGER) AS n", lambda T: [F.md5(text.utf8_decode(text.utf8_encode(T))).alias("back"), F.length(text.utf8_encode(T)).alias("n")])
_docs("text_utf16_roundtrip", "md5(text) AS back", lambda T: [F.md5(text.decode(text.encode(T, "utf-16be"), "utf-16be")).alias("back")])
_docs("text_hex", "lower(hex(encode(text))) AS hex", lambda T: [text.hex_encode(text.utf8_encode(T)).alias("hex")])
_docs("text_hex_roundtrip", "md5(text) AS back", lambda T: [F.md5(text.hex_decode(text.hex_encode(text.utf8_encode(T)))).alias("back")])
_docs("text_base64", "base64(encode(text)) AS b64", lambda T: [text.base64_encode(text.utf8_encode(T)).alias("b64")])
_docs("text_base64_url_roundtrip", "rtrim(translate(base64(encode(text)), '+/', '-_'), '=') AS b64, md5(text) AS back", lambda T: [text.base64_encode(text.utf8_encode(T), url=True, padding=False).alias("b64"), F.md5(text.base64_decode(text.base64_encode(text.utf8_encode(T), url=True, padding=False), url=True)).alias("back")])
_docs("text_chars", "CAST(length(text) AS INTEGER) AS n, substr(text, 1, 1) AS first, true AS same", lambda T: [F.size(text.chars(T)).alias("n"), F.get(text.chars(T), 0).alias("first"), (text.from_chars(text.chars(T)) == T).alias("same")])
_docs("hash_digests", "md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256", lambda T: [*[hashing.digest(text.utf8_encode(T), a).alias(a) for a in ("md5", "sha1", "sha256")]])
_docs("hash_long_digests", None, lambda T: [*[hashing.digest(text.utf8_encode(T), a).alias(a) for a in ("sha384", "sha512")], *[hashing.digest(text.utf8_encode(T), a).alias(a.replace("-", "_").replace("/", "_")) for a in ("sha3-256", "sha512/256")]])
_PAD = lambda pad: "unhex('" + bytes(b ^ pad for b in b"key".ljust(64, b"\0")).hex() + "')"
_docs("hash_hmac", f"sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(text)))) AS mac", lambda T: [hashing.hmac(text.utf8_encode(T), b"key", "sha256").alias("mac")])
_docs("checksum_crc32", None, lambda T: [hashing.crc32(text.utf8_encode(T)).alias("crc")])
_docs("checksum_crc32c", None, lambda T: [hashing.crc32c(text.utf8_encode(T)).alias("crc")])
_docs("gzip_roundtrip", "md5(text) AS back", lambda T: [F.md5(compression.gunzip(compression.deflate(text.utf8_encode(T), "gzip"))["content"]).alias("back")])
_docs("deflate_roundtrip", "md5(text) AS back", lambda T: [F.md5(compression.inflate(compression.deflate(text.utf8_encode(T), "raw"), "raw")).alias("back")])
query("rotate_by_size", "SELECT doc_id AS seq, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS file FROM documents")(lambda s, d: files.rotated(table(s, d, "documents").select(F.col("doc_id").alias("seq"), "lang", "text"), "text", 65536, key="lang").select("seq", "file"))
query("rotate_by_size_whole", "SELECT doc_id AS seq, coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS file FROM documents")(lambda s, d: files.rotated(table(s, d, "documents").select(F.col("doc_id").alias("seq"), "text"), "text", 65536).select("seq", "file"))
