"""Binary records as column expressions: fields at offsets, records one after another, length-prefixed frames, and the way back to bytes.

A layout is a list of (name, bytes, kind): "uint" and "int" are big-endian numbers as longs (a uint of 8 bytes up to 2**63 - 1), "bytes" stays as it is. Decoding takes bytes and gives structs; what is too short decodes to null, and the strict forms raise an error at run time where the quiet ones stop.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays

Layout = list[tuple[str, int, str]]


def width(layout: Layout) -> int:
    return sum(n for _, n, _ in layout)


def field(data: Column, at, n: int, kind: str = "uint") -> Column:
    """One field at an offset, null beyond the end."""
    place = at if isinstance(at, Column) else F.lit(at)
    piece = F.substring(data, (place + 1).cast("int"), F.lit(n))
    if kind == "bytes":
        return F.when(F.length(piece) == n, piece)
    number = F.conv(F.hex(piece), 16, -10 if kind == "int" and n == 8 else 10).try_cast("long")
    if kind == "int" and n < 8:
        number = F.when(number >= 1 << (8 * n - 1), number - (1 << (8 * n))).otherwise(number)
    return F.when(F.length(piece) == n, number)


def bit(data: Column, at, k: int) -> Column:
    """Bit k (0 is the highest) of the byte at an offset."""
    return F.shiftright(field(data, at, 1), 7 - k) % 2 == 1


def decode(data: Column, layout: Layout, at=0) -> Column:
    fields, k = [], 0
    for name, n, kind in layout:
        fields.append(field(data, (at if isinstance(at, Column) else F.lit(at)) + k, n, kind).alias(name))
        k += n
    return F.when(F.length(data) >= (at if isinstance(at, Column) else F.lit(at)) + k, F.struct(*fields))


def _or_error(value: Column, message: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)))


def once(data: Column, layout: Layout, quiet: bool = False) -> tuple[Column, Column]:
    """The first record and the bytes after it. Too few bytes are an error or, if quiet, no record and all of the bytes."""
    value = decode(data, layout)
    rest = F.when(F.length(data) >= width(layout), data.substr(F.lit(width(layout) + 1), F.length(data))).otherwise(data)
    return (value if quiet else _or_error(value, "a record is cut short")), rest


def many(data: Column, layout: Layout, good=None, quiet: bool = False, most: Column | None = None) -> Column:
    """All records (the first `most`) as an array; an incomplete last one is left out. Where good(record) fails, an error or, if quiet, the end."""
    size = width(layout)
    n = F.floor(F.length(data) / size).cast("int")
    n = n if most is None else F.least(n, most.cast("int"))
    found = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: decode(data, layout, k * size))
    if good is None:
        return found
    return arrays.take_while(found, lambda r: F.coalesce(good(r), F.lit(False))) if quiet else F.when(F.forall(found, lambda r: F.coalesce(good(r), F.lit(False))), found).otherwise(F.raise_error(F.lit("a bad record")))


def counted(data: Column, header: Layout, count: str, layout: Layout) -> Column:
    """struct(header, records): a header that says how many records follow; fewer are an error."""
    head, rest = once(data, header)
    found = many(rest, layout, most=head[count])
    return F.struct(head.alias("header"), F.when(F.size(found) == head[count], found).otherwise(F.raise_error(F.lit("records are missing"))).alias("records"))


def isolate(data: Column, n: int) -> Column:
    """The first n bytes, so that what decodes them can't read on; fewer are an error."""
    return F.when(F.length(data) >= n, F.substring(data, 1, n)).otherwise(F.raise_error(F.lit(f"fewer than {n} bytes")))


def ignore(data: Column, n: int) -> Column:
    """The bytes after the first n; fewer are an error."""
    return F.when(F.length(data) >= n, data.substr(F.lit(n + 1), F.length(data))).otherwise(F.raise_error(F.lit(f"fewer than {n} bytes")))


def or_else(value: Column, other: Column) -> Column:
    """Another decoding where the first gives nothing; both of one type."""
    return F.coalesce(value, other)


def explode(df: DataFrame, records: Column, keep: list[str]) -> DataFrame:
    """A row per record: keep, record_no and the record's fields."""
    return df.select(*keep, F.posexplode(records).alias("record_no", "__r")).select(*keep, "record_no", "__r.*")


def frames(data: Column, prefix: int = 4, at: int = 0, n: int | None = None, mask: int = -1, whole: bool = False) -> Column:
    """Messages as an array of bytes, each after a header of `prefix` bytes (in it, if whole) that holds the message's length: n bytes at an offset, of which mask says the bits. An incomplete last message is left out. Where messages begin is found in Arrow batches, they are cut in the JVM."""
    n = prefix - at if n is None else n

    @F.pandas_udf("array<struct<at:int,n:int>>")
    def places(values: pd.Series) -> pd.Series:
        def of(b):
            if b is None:
                return None
            k, out = 0, []
            while k + prefix <= len(b):
                size = int.from_bytes(b[k + at : k + at + n], "big") & mask
                if k + prefix + size > len(b):
                    break
                out.append({"at": k if whole else k + prefix, "n": size + prefix if whole else size})
                k += prefix + size
            return out

        return values.map(of)

    return F.transform(places(data), lambda p: F.substring(data, p["at"] + 1, p["n"]))


def _hex(value: Column, n: int, kind: str, quiet: bool) -> Column:
    """2n hexadecimal digits; what doesn't fit is an error or, if quiet, null."""
    if kind == "bytes":
        fits, made = F.length(value) == n, F.hex(value)
    else:
        v = value.cast("long")
        least, most = (0, (1 << min(8 * n, 63)) - 1) if kind == "uint" else (-(1 << (8 * n - 1)), (1 << (8 * n - 1)) - 1)
        fits, made = (v >= F.lit(least)) & (v <= F.lit(most)), F.substring(F.lpad(F.hex(v), 16, "0"), 17 - 2 * n, 2 * n)
    return F.when(fits, made) if quiet else F.when(fits, made).otherwise(F.raise_error(F.lit("a value doesn't fit its field")))


def encode(layout: Layout, values: dict[str, Column] | None = None, quiet: bool = False) -> Column:
    """A record's bytes from columns of the fields' names (or the columns given)."""
    return F.unhex(F.concat(*[_hex((values or {}).get(name, F.col(name)), n, kind, quiet) for name, n, kind in layout]))


def framed(data: Column, prefix: int = 4) -> Column:
    """A message after its length."""
    return F.concat(encode([("n", prefix, "uint")], {"n": F.length(data)}), data)


def joined(df: DataFrame, keys: list[str], data: Column, order: str = "seq", name: str = "data") -> DataFrame:
    """(keys, data): each group's bytes one after another in order. A group is one value, so groups must be as small as that: number blocks first."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(data).alias("h"))))
    return df.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(pairs, lambda p: p["h"]), "")).alias(name))
