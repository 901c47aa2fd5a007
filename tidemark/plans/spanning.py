"""Queries of streams in pieces: documents and events cut at places that have nothing to do with their content."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import grouping, pieces
from tidemark.operators.ordered import spread
from tidemark.operators.storage import fresh_folder
from tidemark.plans.inputs import table
from tidemark.sources import files


#: Pieces that are cut from one row.
MANY = 64


def pieced(docs, column: str, length, size: int, number: str):
    """A row for each piece of `size` of a text (of bytes), numbered from 0. Long pieces are cut first, as each row holds, and is searched from the beginning of, what its piece is cut from."""
    part = lambda rows, at, n: rows.withColumn(column, F.substring(F.col(column), (F.col(at) * n + 1).cast("int"), F.lit(n)))
    long = part(spread(docs, F.lit(0), F.floor((length(column) - 1) / (size * MANY)), "__m"), "__m", size * MANY)
    short = part(spread(long, F.lit(0), F.floor((length(column) - 1) / size), "__k"), "__k", size)
    return short.withColumn(number, F.col("__m") * MANY + F.col("__k")).drop("__m", "__k")


def cut(s, d, size: int, column: str = "data"):
    """Each document's bytes in pieces of `size`: doc_id, lang, off, data."""
    docs = table(s, d, "documents").select("doc_id", "lang", F.col("text").cast("binary").alias(column))
    return pieced(docs, column, F.octet_length, size, "__n").select("doc_id", "lang", (F.col("__n") * size).alias("off"), column)


@query("decode_pieces", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS whole FROM documents WHERE length(text) > 0")
def decode_pieces(s, d):
    """Code points across pieces of five bytes: the pieces' texts together are the document."""
    whole = pieces.whole(pieces.decode_utf8(cut(s, d, 5).drop("lang"), key="doc_id"), key="doc_id")
    return whole.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("whole"))


_LINES = "SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents WHERE length(text) > 0), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)"
query("lines_of_pieces", _LINES)(lambda s, d: pieces.lines(pieces.decode_utf8(cut(s, d, 64), key="doc_id"), key="doc_id"))


@query("read_lines_ranged", "SELECT CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line FROM (SELECT string_split(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id), chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def read_lines_ranged(s, d):
    """All documents in one file, whose lines are found by tasks that read parts of it."""
    table(s, d, "documents").sort("doc_id").select(F.coalesce("text", F.lit(""))).coalesce(1).write.text(folder := fresh_folder(s, "file"))
    return files.read_lines(s, f"{folder}/part-*", chunk=5000, span=100_000).select(F.col("line_no").cast("long").alias("line_no"), "line")


_STRADDLING = "SELECT lang, piece, count(*) AS n FROM (SELECT lang, unnest(string_split(t, '. ')) AS piece, unnest(range(1, len(string_split(t, '. ')) + 1)) AS i, len(string_split(t, '. ')) AS last FROM (SELECT lang, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY lang)) WHERE i < last OR piece <> '' GROUP BY lang, piece"


@query("resplit_straddling", _STRADDLING)
def resplit_straddling(s, d):
    """All texts of a language joined and split at a delimiter of two characters, many of which lie across the rows of 50 characters that are given."""
    docs = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "lang", "text")
    rows = pieced(docs, "text", F.length, 50, "n").select("lang", F.struct("doc_id", "n").alias("seq"), "text")
    return grouping.resplit(rows, ". ", key="lang").groupBy("lang", "piece").agg(F.count("*").alias("n"))
