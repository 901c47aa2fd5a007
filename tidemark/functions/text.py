"""Text codecs and lines as column expressions; only charsets that Spark doesn't know go through Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATIVE = {"us-ascii", "iso-8859-1", "utf-8", "utf-16be", "utf-16le", "utf-16", "utf-32"}


def utf8_decode(data: Column) -> Column:
    """Bad bytes become U+FFFD; a leading byte-order mark goes."""
    text = F.make_valid_utf8(data.cast("string"))
    return F.when(F.startswith(text, F.lit("﻿")), text.substr(F.lit(2), F.length(text))).otherwise(text)


def utf8_encode(text: Column) -> Column:
    return text.cast("binary")


def decode(data: Column, charset: str) -> Column:
    if charset.lower() == "utf-8":
        return utf8_decode(data)
    if charset.lower() in NATIVE:
        return F.decode(data, charset)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return run(data)


def encode(text: Column, charset: str) -> Column:
    if charset.lower() in NATIVE:
        return F.encode(text, charset)

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else t.encode(charset, "replace"))

    return run(text)


def lines(text: Column) -> Column:
    """LF, CRLF and lone CR end lines; what follows the last one is a line too. Empty text has no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\r\n|\n|\r", -1))


def lines_limited(text: Column, most: int) -> Column:
    """Lines, or an error at run time where one is longer than most."""
    found = lines(text)
    return F.when(F.exists(found, lambda x: F.length(x) > most), F.raise_error(F.lit(f"a line is longer than {most}"))).otherwise(found)


def chars(text: Column) -> Column:
    """Code points, each as a string."""
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def from_chars(chars_: Column) -> Column:
    return F.array_join(chars_, "")


_STANDARD, _URL = "+/", "-_"


def base64_encode(data: Column, url: bool = False, padding: bool = True) -> Column:
    out = F.replace(F.replace(F.base64(data), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    out = F.translate(out, _STANDARD, _URL) if url else out
    return out if padding else F.rtrim(out, F.lit("="))


def base64_decode(text: Column, url: bool = False) -> Column:
    """White space is skipped; null where text isn't valid base64."""
    plain = F.regexp_replace(text, r"\s", "")
    plain = F.translate(plain, _URL, _STANDARD) if url else plain
    body = F.rtrim(plain, F.lit("="))
    pad = F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int"))
    good = body.rlike("^[A-Za-z0-9+/]*$") & (F.length(body) % 4 != 1) & (plain == body) | (plain == F.concat(body, pad)) & body.rlike("^[A-Za-z0-9+/]*$")
    return F.when(good, F.unbase64(F.concat(body, pad)))


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_decode(text: Column) -> Column:
    """Digits in either case, white space skipped, an 0x in front allowed; null where text isn't valid."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\s|_", ""), "^0[xX]", "")
    return F.when(plain.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(plain))


def explode_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
