"""Byte and text streams in pieces that are cut anywhere: code points, line ends and lines that lie across pieces.

A stream is the pieces of a key (a file, say) in the order of a column. What a piece must know of its neighbours is short: the three bytes before and after it for UTF-8, the character before it for line ends. These rims are exchanged over narrow rows that are sorted by key and order together, so that one large file is spread over tasks like many small ones; the pieces themselves are moved once.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.grouping import meeting
from tidemark.operators.ordered import near
from tidemark.operators.packed import by_steps, offsets, orders, packed, unpacked, with_few

# The well-formed beginnings of UTF-8 code points of two to four bytes (Unicode, table 3-7), by their first two bytes.
_TWO, _PAIRS3, _PAIRS4, _MORE = "[\u00c2-\u00df]", "(?:\u00e0[\u00a0-\u00bf]|[\u00e1-\u00ec\u00ee\u00ef][\u0080-\u00bf]|\u00ed[\u0080-\u009f])", "(?:\u00f0[\u0090-\u00bf]|[\u00f1-\u00f3][\u0080-\u00bf]|\u00f4[\u0080-\u008f])", "[\u0080-\u00bf]"
#: An unfinished code point at the end of bytes, and the longest beginning of one at their start. Bytes are written as Latin-1 characters.
_OPEN = f"(?:[\u00c2-\u00f4]|{_PAIRS3}|{_PAIRS4}{_MORE}?)\\z"
_BEGUN = f"\\A(?:{_PAIRS4}{_MORE}{{0,2}}|{_PAIRS3}{_MORE}?|{_TWO}{_MORE}|[\u00c2-\u00f4])"


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _rims(pieces: DataFrame, keys: list[str], order: str, columns, reach: int) -> DataFrame:
    """Narrow rows with what `columns` makes of their neighbours' __o and others."""
    return near(pieces, columns, reach, reach, [*keys, order])


def _same(w, n: int, keys: list[str], value: str, empty) -> Column:
    """The value of the n-th row before (after, if n is negative) where that is of the same key."""
    at = F.lag(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")), n).over(w) if n > 0 else F.lead(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")), -n).over(w)
    fits = at.isNotNull()
    for i, k in enumerate(keys):
        fits = fits & at[f"k{i}"].eqNullSafe(F.col(k))
    return F.when(fits, at["v"]).otherwise(empty)


_TAKEN: list[tuple[int, int]] = []


def _note(e: UnicodeDecodeError) -> tuple[str, int]:
    _TAKEN.append((e.start, e.end))
    return "\ufffd", e.end


codecs.register_error("tidemark-noted", _note)


def _repaired(body: bytes, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """body with U+FFFD for what is no UTF-8, and where in it code points begin that begin at the places `cuts` of body or after them."""
    _TAKEN.clear()
    out = body.decode("utf-8", "tidemark-noted").encode()
    starts, ends = np.array(_TAKEN, np.int64).T
    raw = np.frombuffer(body + b"a", np.uint8)
    last = np.searchsorted(starts, cuts, "right") - 1
    cuts = np.where((last >= 0) & (cuts > starts[last]) & (cuts < ends[last]), ends[last], cuts)
    for _ in range(3):
        cuts = cuts + ((raw[cuts] & 0xC0 == 0x80) & ~np.isin(cuts, starts))
    grown = np.append(0, np.cumsum(3 - (ends - starts)))
    return out, cuts + grown[np.searchsorted(starts, cuts, "left")]


def _texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts of the pieces of runs: __value without the first __skip bytes and with __rest, each code point with the piece that it begins in."""
    listed, value = batch.column("__sizes"), batch.column("__value")
    bounds, at = offsets(listed), offsets(value)
    bounds, n = bounds - bounds[0], len(batch)
    sizes = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.append(0, np.cumsum(sizes))
    skips, rests = batch.column("__skip").to_pylist(), batch.column("__rest").to_pylist()
    data = memoryview(value.buffers()[2])
    bodies, begins, mended, base = [], np.zeros(len(sizes) + 1, np.int64), [], 0
    ends = np.zeros(n, np.int64)
    for k in range(n):
        a, b, skip = bounds[k], bounds[k + 1], skips[k]
        body = bytes(data[at[k] + skip : at[k + 1]]) + rests[k]
        cuts = np.maximum(before[a:b] - before[a] - skip, 0)
        try:
            body.decode()
        except UnicodeDecodeError:
            body, cuts = _repaired(body, cuts)
            mended.append((a, b, cuts + base))
        begins[a:b] = cuts + base
        bodies.append(body)
        base += len(body)
        ends[k] = base
    whole = b"".join(bodies)
    begins[-1] = base
    raw, until = np.frombuffer(whole + b"a", np.uint8), np.append(np.repeat(ends, np.diff(bounds)), base)
    for _ in range(3):
        begins += (begins < until) & (raw[begins] & 0xC0 == 0x80)
    for a, b, cuts in mended:
        begins[a:b] = cuts
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(whole)])


def decode_utf8(pieces: DataFrame, data: str = "data", order: str = "off", key: str | list[str] | None = None, text: str = "text") -> DataFrame:
    """pieces with text in place of data: the code points that begin in a piece, whole, also where they end in later ones. What is no UTF-8 becomes U+FFFD just as if the stream were decoded as one. Empty and null pieces have no text and go."""
    keys = [key] if isinstance(key, str) else list(key or [])
    kept = [c for c in pieces.columns if c not in (data, text)]
    runs = packed(pieces.filter(F.octet_length(data) > 0).select(*kept, data), keys, order, data)
    size, bytes_ = F.octet_length("__value"), "`__value`"
    narrow = runs.select(*keys, "__lo", F.substring("__value", 1, 3).alias("__head"), F.expr(f"substring({bytes_}, greatest(octet_length({bytes_}) - 2, 1))").alias("__tail"), size.alias("__size"))
    empty = F.lit(b"")

    def columns(w) -> dict[str, Column]:
        before = _latin(F.concat(*[_same(w, n, keys, "__tail", empty) for n in (3, 2, 1)]))
        after = _latin(F.concat(*[_same(w, -n, keys, "__head", empty) for n in (1, 2, 3)]))
        return {"__before": before, "__after": after}

    right = lambda c: c.substr(F.greatest(F.length(c) - 2, F.lit(1)), F.lit(3))
    rims = _rims(narrow, keys, "__lo", columns, 3).withColumns({"__before": right(F.col("__before")), "__head": _latin(F.col("__head")), "__tail": _latin(F.col("__tail"))})
    going_on = lambda open_, following: F.when(open_ == "", 0).otherwise(F.length(F.regexp_extract(F.concat(open_, following), _BEGUN, 0)) - F.length(open_))
    unfinished = lambda c: F.regexp_extract(c, _OPEN, 0)
    rims = rims.withColumns({"__open": unfinished(F.col("__before")), "__left": unfinished(right(F.concat("__before", "__tail")))})
    rims = rims.withColumns({"__skip": going_on(F.col("__open"), F.concat("__head", "__after")), "__need": F.when(F.length("__left") <= F.col("__size"), going_on(F.col("__left"), F.col("__after"))).otherwise(0)})
    rims = rims.filter("__skip > 0 or __need > 0").select(F.struct(*keys, F.col("__lo").alias("__order")).alias("__o"), "__skip", F.encode(F.col("__after").substr(F.lit(1), F.col("__need")), "ISO-8859-1").alias("__rest"))
    joined = with_few(runs.withColumn("__own", F.struct(*keys, F.col("__lo").alias("__order"))), rims, F.col("__own").eqNullSafe(F.col("__o")))
    joined = joined.withColumns({"__skip": F.coalesce("__skip", F.lit(0)), "__rest": F.coalesce("__rest", empty)}).drop("__own", "__o", "__hi")
    kind = {f.name: f.dataType for f in pieces.schema.fields}
    whole = by_steps(kind[order])

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        listed = batch.column("__sizes")
        each = pa.array(np.repeat(np.arange(len(batch)), np.diff(offsets(listed))))
        own = lambda c: batch.column(c).take(each) if c in keys else orders(batch, whole) if c == order else batch.column(c).flatten()
        return [*map(own, kept), _texts(batch)]

    return unpacked(joined, [*[(c, kind[c]) for c in kept], (text, StringType())], rows)


def whole(pieces: DataFrame, text: str = "text", order: str = "off", key: str | list[str] | None = None) -> DataFrame:
    """(key, text): each key's texts joined in order, as one value."""
    keys = [key] if isinstance(key, str) else list(key or [])
    runs = packed(pieces.select(*keys, order, text), keys, order, text).select(*keys, F.struct(F.col("__lo").alias("o"), F.col("__value").cast("string").alias("t")).alias("__x"))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__x")), lambda x: x["t"]), "").alias(text))


def lines(pieces: DataFrame, text: str = "text", order: str = "off", key: str | list[str] | None = None) -> DataFrame:
    """(key, line_no, line): the lines of each key's texts joined in order. LF, CRLF (also across pieces) and lone CR end lines; what follows the last one is a line too. No text has no line. A line that no piece ends may be as long as the stream."""
    keys = [key] if isinstance(key, str) else list(key or [])
    runs = packed(pieces.filter(F.length(text) > 0).select(*keys, order, text), keys, order, text)
    held = runs.select(*keys, F.col("__lo").alias(order), F.col("__value").cast("string").alias("__t"))
    rims = _rims(held.select(*keys, order, F.startswith("__t", F.lit("\n")).alias("__begin"), F.right("__t", F.lit(1)).alias("__end")), keys, order, lambda w: {"__before": _same(w, 1, keys, "__end", F.lit(""))}, 1)
    rims = rims.filter((F.col("__before") == "\r") & F.col("__begin")).select(F.struct(*keys, order).alias("__at"), F.lit(True).alias("__cut"))
    rows = with_few(held.withColumn("__o", F.struct(*keys, order)), rims, F.col("__o").eqNullSafe(F.col("__at")))
    own = F.when(F.col("__cut"), F.col("__t").substr(F.lit(2), F.length("__t"))).otherwise(F.col("__t"))
    met = meeting(rows.select("__o", F.split(own, "\r\n|\n|\r", -1).alias("__parts")), keys, indexed=True)
    return met.select(*[F.col(f"__any.{c}").alias(c) for c in keys], F.col("__index").alias("line_no"), F.col("__p").alias("line"))
