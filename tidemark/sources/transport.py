"""MPEG transport packets and the program sections that they carry.

Packets are fixed-size, so files split anywhere; sections are put together per file and program id in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import crc_table

PACKET, SYNC = 188, 0x47
_TABLE = crc_table(0x04C11DB7, 32, False)


def crc_mpeg(data: bytes) -> int:
    r = 0xFFFFFFFF
    for x in data:
        r = _TABLE[((r >> 24) ^ x) & 0xFF] ^ ((r << 8) & 0xFFFFFFFF)
    return r


def packets(df: DataFrame, data: str = "data") -> DataFrame:
    """Splits a binary column of whole packets: adds packet_no and packet."""
    n = F.floor(F.length(data) / PACKET).cast("int")
    return df.filter(n > 0).withColumn("packet_no", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("packet", F.substring(F.col(data), F.col("packet_no") * PACKET + 1, F.lit(PACKET)))


def header(packet: Column) -> Column:
    """struct(sync, error, begins, pid, scrambling, adaptation, counter)."""
    byte = lambda k: F.conv(F.hex(F.substring(packet, k + 1, 1)), 16, 10).cast("int")
    return F.struct(
        (byte(0) == SYNC).alias("sync"), (F.shiftright(byte(1), 7) == 1).alias("error"), (F.shiftright(byte(1), 6) % 2 == 1).alias("begins"), ((byte(1) % 32) * 256 + byte(2)).alias("pid"), F.shiftright(byte(3), 6).alias("scrambling"), (F.shiftright(byte(3), 4) % 4).alias("adaptation"), (byte(3) % 16).alias("counter")
    )


SECTIONS = "stream string, pid int, seq long, table_id int, section binary, error string"


def sections(df: DataFrame, stream: str, order: str, packet: str = "packet") -> DataFrame:
    """Sections of each (stream, pid); a jump of the counter or a bad checksum gives a row with an error, and the packet is still used."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        held: bytearray | None = None
        expected, name, pid = None, part["stream"].iloc[0], int(part["pid"].iloc[0])
        for seq, p in part.sort_values("seq")[["seq", "packet"]].itertuples(index=False):
            p = bytes(p)
            adaptation, counter, at = p[3] >> 4 & 3, p[3] & 15, 4
            if not adaptation & 1:
                continue
            if expected is not None and counter != expected:
                out.append((name, pid, seq, None, None, f"counter {counter} after {(expected - 1) % 16}"))
                held = None
            expected = (counter + 1) % 16
            if adaptation & 2:
                at += 1 + p[4]
            body = p[at:]
            if p[1] & 0x40:
                rest, body = body[1 : 1 + body[0]], body[1 + body[0] :]
                if held is not None:
                    held += rest
                    held = _finish(held, out, name, pid, seq)
                held = bytearray(body)
            elif held is not None:
                held += body
            held = _finish(held, out, name, pid, seq) if held is not None else None
        return pd.DataFrame(out, columns=["stream", "pid", "seq", "table_id", "section", "error"])

    rows = df.select(F.col(stream).cast("string").alias("stream"), F.col(order).cast("long").alias("seq"), F.col(packet).alias("packet"), header(F.col(packet))["pid"].alias("pid"))
    return rows.groupBy("stream", "pid").applyInPandas(work, SECTIONS)


def _finish(held: bytearray, out: list, name: str, pid: int, seq: int) -> bytearray | None:
    """Takes complete sections off the front of what is held."""
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < size:
            return held
        section = bytes(held[:size])
        bad = held[1] & 0x80 and crc_mpeg(section) != 0
        out.append((name, pid, seq, section[0], None if bad else section, "bad checksum" if bad else None))
        held = held[size:]
    return held if held and held[0] != 0xFF else None
