"""A membership filter of fixed size: it lets every member through, and some others the more members there are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import mix


def bit_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def build(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter over a column of long keys; at most bits / 64 numbers come to the driver, however many keys there are."""

    def run(batches):
        held = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            bit = bit_of(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(held, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], ["at", "bits"])

    out = np.zeros(bits >> 6, np.uint64)
    got = keys.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def lets_through(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = bit_of(keys, len(held) << 6)
    return ((held[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
