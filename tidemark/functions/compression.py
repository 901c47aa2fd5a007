"""Deflate and gzip of binary columns, and gzip members with their header fields."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"zlib": 15, "raw": -15, "gzip": 31}


def deflate(data: Column, form: str = "zlib", level: int = 6) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            z = zlib.compressobj(level, zlib.DEFLATED, BITS[form])
            return z.compress(bytes(b)) + z.flush()

        return x.map(one)

    return run(data)


def inflate(data: Column, form: str = "zlib") -> Column:
    """All members in a row; an incomplete or damaged one is an error."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            rest, out = bytes(b), []
            while rest:
                z = zlib.decompressobj(BITS[form])
                out.append(z.decompress(rest) + z.flush())
                if not z.eof:
                    raise ValueError("compressed data ends too soon")
                rest = z.unused_data if form == "gzip" else b""
            return b"".join(out)

        return x.map(one)

    return run(data)


def gunzip(data: Column) -> Column:
    """struct(content, mtime, name, comment) of a gzip file's first header and all its content."""

    @F.pandas_udf("content binary, mtime timestamp, name string, comment string")
    def run(x: pd.Series) -> pd.DataFrame:
        def one(b):
            if b is None:
                return None, None, None, None
            b = bytes(b)
            flags, stamp = b[3], struct.unpack_from("<I", b, 4)[0]
            at = 10
            if flags & 4:
                at += 2 + struct.unpack_from("<H", b, at)[0]
            texts = []
            for bit in (8, 16):
                end = b.index(0, at) if flags & bit else at
                texts.append(b[at:end].decode("latin-1") if flags & bit else None)
                at = end + 1 if flags & bit else at
            rest, out = b, []
            while rest:
                z = zlib.decompressobj(31)
                out.append(z.decompress(rest) + z.flush())
                if not z.eof:
                    raise ValueError("compressed data ends too soon")
                rest = z.unused_data
            return b"".join(out), pd.Timestamp(stamp, unit="s") if stamp else None, *texts

        return pd.DataFrame([one(b) for b in x], columns=["content", "mtime", "name", "comment"])

    return run(data)
