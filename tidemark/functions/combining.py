"""Checksums and digests of whole ordered sequences.

A cyclic checksum is linear: the state after A and then B is the state after A moved on by as many zero bytes as B has, plus (exclusive or) the state after B alone from a state of zero. So each row's checksum is taken where the row is, moved on by the bytes that follow the row, and all are added up in any order: an aggregate, with one running sum of lengths over narrow rows. Moving on by n bytes takes a table for each binary digit of n.

A cryptographic digest has no such law: its bytes must be read in order. The rows of a key are sorted and streamed through one task, which holds the digest's state and a batch of rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import Crc
from tidemark.operators.ordered import running
from tidemark.operators.storage import pinned

#: Binary digits of a length in bytes.
DIGITS = 62
# Polynomial, initial state, reflection, final exclusive or and width of common checksums.
KINDS = {"crc32": (0x04C11DB7, 0xFFFFFFFF, True, 0xFFFFFFFF, 32), "crc32c": (0x1EDC6F41, 0xFFFFFFFF, True, 0xFFFFFFFF, 32), "crc16": (0x1021, 0xFFFF, False, 0, 16), "crc64": (0x42F0E1EBA9EA3693, 0xFFFFFFFFFFFFFFFF, True, 0xFFFFFFFFFFFFFFFF, 64)}


class Shift:
    """Moves checksum states on by any number of zero bytes."""

    def __init__(self, crc: Crc):
        self.bytes = crc.bytes
        basis = (np.arange(256, dtype=np.uint64) << np.arange(0, 8 * crc.bytes, 8, dtype=np.uint64)[:, None]).ravel()
        tables = [crc.step(basis, np.zeros(len(basis), np.uint64)).reshape(crc.bytes, 256)]
        while len(tables) < DIGITS:  # twice as many zeros: the table applied to itself
            tables.append(self._apply(tables[-1], tables[-1].ravel()).reshape(crc.bytes, 256))
        self.tables = tables

    def _apply(self, table: np.ndarray, state: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.uint64)
        for k in range(self.bytes):
            out ^= table[k][(state >> np.uint64(8 * k)) & np.uint64(255)]
        return out

    def by(self, state: np.ndarray, n: np.ndarray) -> np.ndarray:
        state = state.copy()
        for k in range(int(n.max()).bit_length() if len(n) else 0):
            some = (n >> k) & 1 == 1
            state[some] = self._apply(self.tables[k], state[some])
        return state


@functools.lru_cache(maxsize=8)
def _shift(spec: tuple) -> Shift:
    return Shift(Crc(*spec))


def crc_sequence(df: DataFrame, data: str, kind: str | tuple = "crc32", order: str = "seq", key: str | list[str] | None = None) -> DataFrame:
    """(key, n_bytes, crc): the checksum of all bytes of each key (of the whole frame, if none is given) in order. kind: a name of KINDS or (polynomial, initial, reflected, final_xor, width); 64 bits come as a signed long. Null data is no bytes; a frame without rows has the checksum of nothing, a key without rows none."""
    spec = KINDS[kind] if isinstance(kind, str) else tuple(kind)
    keys = [key] if isinstance(key, str) else list(key or [])
    crc = Crc(*spec)
    initial, final = np.uint64(crc.initial), np.uint64(crc.final)

    @F.pandas_udf("long")
    def alone(x: pd.Series) -> pd.Series:
        """The state after a row's bytes, from a state of zero."""
        raw = [bytes(b) if b is not None else b"" for b in x]
        n = np.array([len(b) for b in raw], np.int64)
        after = np.array(crc.of(raw), np.uint64) ^ final
        return pd.Series((after ^ _shift(spec).by(np.full(len(raw), initial), n)).view(np.int64))

    @F.pandas_udf("long")
    def moved(state: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(_shift(spec).by(state.to_numpy(np.int64).view(np.uint64), n.to_numpy(np.int64)).view(np.int64))

    @F.pandas_udf("long")
    def finished(added: pd.Series, n: pd.Series) -> pd.Series:
        begun = _shift(spec).by(np.full(len(n), initial), n.to_numpy(np.int64))
        return pd.Series((begun ^ added.to_numpy(np.int64).view(np.uint64) ^ final).view(np.int64))

    rows = df.select(*keys, F.struct(*keys, order).alias("__o"), F.coalesce(F.octet_length(data), F.lit(0)).cast("long").alias("__n"), alone(F.col(data).cast("binary")).alias("__s"))
    placed = pinned(running(rows, F.col("__n"), "__upto", "sum", "__o"))
    ends = placed.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max("__upto").alias("__end"), F.min(F.col("__upto") - F.col("__n")).alias("__begin"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    with_ends = placed.join(ends, same) if keys else placed.crossJoin(F.broadcast(ends))  # without keys it is a single row
    added = with_ends.select(*keys, "__n", moved("__s", F.col("__end") - F.col("__upto")).alias("__s"))
    out = added.groupBy(*keys).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_bytes"), F.coalesce(F.bit_xor("__s"), F.lit(0)).alias("__s"))
    return out.select(*keys, "n_bytes", finished("__s", "n_bytes").alias("crc"))


def digest_sequence(df: DataFrame, data: str, algorithm: str = "sha256", order: str = "seq", key: str | list[str] | None = None) -> DataFrame:
    """(key, digest): the digest (hexadecimal, of any algorithm of hashlib) of all bytes of each key in order. Null data is no bytes. A key is read by one task, batch by batch."""
    keys = [key] if isinstance(key, str) else list(key or [])
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(order).alias("__order"), F.col(data).cast("binary").alias("__data"))
    names = [f"__k{i}" for i in range(len(keys))]
    key_type = [f"`__k{i}` {dict(df.dtypes)[k]}" for i, k in enumerate(keys)]

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            ids = list(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)) if keys else [()] * batch.num_rows
            for k, x in zip(ids, batch.column(len(keys)).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = k, hashlib.new(algorithm)
                state.update(x or b"")
            yield pa.RecordBatch.from_pylist([dict(zip([*names, "digest"], r, strict=True)) for r in done], schema=pa.schema([*[batch.schema.field(i).with_name(n) for i, n in enumerate(names)], ("digest", pa.string())]))
            kinds = [batch.schema.field(i).with_name(n) for i, n in enumerate(names)]
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*names, "digest"], (*now, state.hexdigest()), strict=True))], schema=pa.schema([*kinds, ("digest", pa.string())]))

    dealt = rows.repartition(*names) if keys else rows.repartition(1)
    out = dealt.sortWithinPartitions(*names, "__order").select(*names, "__data").mapInArrow(run, ", ".join([*key_type, "digest string"]))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "digest")


def with_digest(df: DataFrame, data: str, algorithm: str = "sha256", order: str = "seq", key: str | list[str] | None = None) -> DataFrame:
    """df as it is, and after each key's last row (part 1, all others 0) a row with the digest's bytes as data and null in all other columns: (key, part, order) is the new order."""
    keys = [key] if isinstance(key, str) else list(key or [])
    digest = digest_sequence(df, data, algorithm, order, key)
    last = digest.select(*[F.col(c) if c in keys else F.unhex("digest").alias(c) if c == data else F.lit(None).cast(t).alias(c) for c, t in df.dtypes], F.lit(1).alias("part"))
    return df.withColumn(data, F.col(data).cast("binary")).withColumn("part", F.lit(0)).unionByName(last)
