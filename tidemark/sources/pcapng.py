"""What pcapng blocks say besides packets: option lists, interfaces with their clocks' resolution, interface statistics and name resolution, as column expressions over blocks of either byte order.

A block is (kind, little, body): little says whether its section is little-endian, body is what stands between the block's two lengths. Lists whose entries say how long they are (options, name records) are walked by one fold over as many steps as the body can have entries; all of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.records import field
from tidemark.sources.captures import ENHANCED, INTERFACE, PCAPNG_SECTION

# Block types and option codes of the format.
NAMES, STATISTICS = 4, 5
IF_NAME, IF_DESCRIPTION, IF_TSRESOL, IF_TSOFFSET = 2, 3, 9, 14
ISB_STARTTIME, ISB_ENDTIME, ISB_IFRECV, ISB_IFDROP = 2, 3, 4, 5
NRB_IPV4, NRB_IPV6 = 1, 2
MICROS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed, and written into the plan, once though body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(data: Column, at, n: int, little: Column) -> Column:
    """An unsigned number of n bytes (of eight, up to 2 ** 63 - 1) in the block's byte order; null beyond the end."""
    place = at if isinstance(at, Column) else F.lit(at)
    swapped = lambda h: F.concat(*[F.substring(h, 2 * (n - k) - 1, 2) for k in range(n)])
    return let(F.hex(F.substring(data, (place + 1).cast("int"), F.lit(n))), lambda h: F.when(F.length(h) == 2 * n, F.conv(F.when(little, swapped(h)).otherwise(h), 16, 10).try_cast("long")))


def _padded(n: Column) -> Column:
    return (F.floor((n + 3) / 4) * 4).cast("int")


_ENTRY = "array<struct<code:int,value:binary>>"


def entries(body: Column, start, little: Column) -> Column:
    """struct(list, end): the entries (code, value) from an offset on, each a code and a length of two bytes and a value that is filled up to four; code 0 or the body's end ends the list, and `end` is where that is. An entry that reaches beyond the body ends the list too and isn't in it."""
    begin = (start if isinstance(start, Column) else F.lit(start)).cast("int")
    first = F.struct(begin.alias("at"), F.lit(False).alias("done"), F.array().cast(_ENTRY).alias("list"))

    def step(s: Column, _: Column) -> Column:
        head = F.struct(number(body, s["at"], 2, little).cast("int").alias("code"), number(body, s["at"] + 2, 2, little).cast("int").alias("n"))

        def after(e: Column) -> Column:
            ended = s["done"] | e["code"].isNull() | e["n"].isNull() | (e["code"] == 0) | (s["at"] + 4 + e["n"] > F.length(body))
            stops = F.when(~s["done"] & (e["code"] == 0), s["at"] + 4).otherwise(s["at"])
            more = F.array(F.struct(e["code"].alias("code"), F.substring(body, s["at"] + 5, e["n"]).alias("value")))
            return F.when(ended, F.struct(stops.alias("at"), F.lit(True).alias("done"), s["list"].alias("list"))).otherwise(F.struct((s["at"] + 4 + _padded(e["n"])).cast("int").alias("at"), F.lit(False).alias("done"), F.concat(s["list"], more).alias("list")))

        return let(head, after)

    steps = F.sequence(F.lit(0), F.greatest(F.floor((F.length(body) - begin) / 4), F.lit(0)).cast("int"))
    return F.aggregate(steps, first, step, lambda s: F.struct(s["list"].alias("list"), s["at"].alias("end")))


def option(options: Column, code: int) -> Column:
    """The value of the first option of a code, null without one."""
    return F.get(F.filter(options, lambda o: o["code"] == code), 0)["value"]


def interface(body: Column, little: Column) -> Column:
    """struct of an interface block: link, snap, name, description, per_second (the clock's units in a second), offset (seconds to add)."""

    def said(options: Column) -> Column:
        # The highest bit says whether the rest is a power of two or of ten.
        per_second = let(field(option(options, IF_TSRESOL), 0, 1), lambda r: F.when(r.isNull(), F.lit(MICROS)).when(r >= 128, F.pow(F.lit(2.0), r - 128)).otherwise(F.pow(F.lit(10.0), r)).cast("long"))
        return F.struct(
            number(body, 0, 2, little).cast("int").alias("link"), number(body, 4, 4, little).alias("snap"), option(options, IF_NAME).cast("string").alias("name"), option(options, IF_DESCRIPTION).cast("string").alias("description"), per_second.alias("per_second"), F.coalesce(number(option(options, IF_TSOFFSET), 0, 8, little), F.lit(0)).alias("offset")
        )

    return let(entries(body, 8, little)["list"], said)


def ticks(data: Column, at, little: Column) -> Column:
    """A time in units of its interface's clock: two numbers of four bytes, the higher one first in either byte order."""
    place = at if isinstance(at, Column) else F.lit(at)
    return number(data, place, 4, little) * (1 << 32) + number(data, place + 4, 4, little)


def statistics(body: Column, little: Column) -> Column:
    """struct of an interface statistics block: interface, at, started, ended (ticks), received, dropped (packets)."""
    return let(
        entries(body, 12, little)["list"],
        lambda o: F.struct(
            number(body, 0, 4, little).cast("int").alias("interface"), ticks(body, 4, little).alias("at"), ticks(option(o, ISB_STARTTIME), 0, little).alias("started"), ticks(option(o, ISB_ENDTIME), 0, little).alias("ended"), number(option(o, ISB_IFRECV), 0, 8, little).alias("received"), number(option(o, ISB_IFDROP), 0, 8, little).alias("dropped")
        ),
    )


def names(body: Column, little: Column) -> Column:
    """Array of (address, names) of a name resolution block; other record types are passed over."""
    found = F.filter(entries(body, 0, little)["list"], lambda r: r["code"].isin(NRB_IPV4, NRB_IPV6))

    def one(r: Column) -> Column:
        v, size = r["value"], F.when(r["code"] == NRB_IPV4, 4).otherwise(16)
        four = F.concat_ws(".", *[field(v, k, 1).cast("string") for k in range(4)])
        six = F.regexp_replace(F.lower(F.hex(F.substring(v, 1, 16))), "(....)(?!$)", "$1:")
        said = F.decode(v.substr(size + 1, F.length(v)), "UTF-8")
        return F.struct(F.when(r["code"] == NRB_IPV4, four).otherwise(six).alias("address"), F.filter(F.split(said, "\u0000", -1), lambda x: x != "").alias("names"))

    return F.transform(found, one)


def placed(blocks: DataFrame, path: str = "path", order: str = "seq") -> DataFrame:
    """blocks with section (from 1) and number, which of an interface block is its number within its section. A capture file's blocks are in one task, as they are when it is read."""
    upto = Window.partitionBy(path).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = Window.partitionBy(path, "section").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sections = blocks.withColumn("section", F.count_if(F.col("kind") == PCAPNG_SECTION).over(upto))
    return sections.withColumn("number", F.when(F.col("kind") == INTERFACE, (F.count_if(F.col("kind") == INTERFACE).over(within) - 1).cast("int")))


def packets(blocks: DataFrame, path: str = "path", order: str = "seq") -> DataFrame:
    """(path, seq, us, interface, name, link, incl_len, orig_len, data) of enhanced packet blocks: each with the interface of its section that it names, and its time in microseconds by that interface's clock."""
    rows = placed(blocks, path, order)
    known = rows.filter(F.col("kind") == INTERFACE).select(F.col(path).alias("__path"), F.col("section").alias("__section"), "number", interface(F.col("body"), F.col("little")).alias("of"))
    body, little = F.col("body"), F.col("little")
    held = rows.filter(F.col("kind") == ENHANCED).select(path, order, "section", number(body, 0, 4, little).cast("int").alias("interface"), ticks(body, 4, little).alias("__ticks"), number(body, 12, 4, little).alias("incl_len"), number(body, 16, 4, little).alias("orig_len"), body)
    joined = held.join(known, (F.col(path) == F.col("__path")) & (F.col("section") == F.col("__section")) & (F.col("interface") == F.col("number")), "left")
    # Whole seconds and the rest apart, in whole numbers, so that no clock overflows or is rounded.
    rest = F.expr("CASE WHEN of.per_second <= 1000000000000 THEN (__ticks % of.per_second * 1000000) div of.per_second ELSE (__ticks % of.per_second) div (of.per_second div 1000000) END")
    us = (F.expr("__ticks div of.per_second") + F.col("of.offset")) * MICROS + rest
    return joined.select(path, order, us.cast("long").alias("us"), "interface", F.col("of.name").alias("name"), F.col("of.link").alias("link"), "incl_len", "orig_len", F.substring(F.col("body"), F.lit(21), F.col("incl_len").cast("int")).alias("data"))
