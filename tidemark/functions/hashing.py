"""Digests, checksums and message authentication. Digests that Spark has stay in the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHA2 = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def _per_value(kind: str, f):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else f(bytes(b)))

    return run


def digest(data: Column, algorithm: str) -> Column:
    """Lower-case hex of a digest."""
    name = algorithm.lower().replace("-", "")
    if name == "md5":
        return F.md5(data)
    if name == "sha1":
        return F.sha1(data)
    if name in _SHA2:
        return F.sha2(data, _SHA2[name])
    wanted = {"sha512/224": "sha512_224", "sha512/256": "sha512_256"}.get(name, name if not name.startswith("sha3") else f"sha3_{name[4:]}")
    return _per_value("string", lambda b: hashlib.new(wanted, b).hexdigest())(data)


def hmac(data: Column, key: bytes, algorithm: str) -> Column:
    """Lower-case hex of the keyed digest: the digest of the key's outer pad and of the digest of its inner pad and the data."""
    name = algorithm.lower().replace("-", "")
    made = hashlib.new(name.replace("/", "_") if "/" in name else f"sha3_{name[4:]}" if name.startswith("sha3") else name)
    key = hashlib.new(made.name, key).digest() if len(key) > made.block_size else key
    inner, outer = (F.lit(bytes(b ^ pad for b in key.ljust(made.block_size, b"\0"))) for pad in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, data), algorithm))), algorithm)


def crc32(data: Column) -> Column:
    return F.crc32(data)


def crc_table(polynomial: int, width: int, reflected: bool) -> list[int]:
    """The byte table of any polynomial, by the shift rule."""
    top, full = 1 << (width - 1), (1 << width) - 1
    back = int(f"{polynomial:0{width}b}"[::-1], 2)
    out = []
    for b in range(256):
        r = b if reflected else b << (width - 8)
        for _ in range(8):
            r = (r >> 1) ^ (back if r & 1 else 0) if reflected else ((r << 1) ^ (polynomial if r & top else 0)) & full
        out.append(r)
    return out


#: Bytes of a block whose checksums are computed side by side, and of the texts that are laid out together.
CRC_BLOCK, CRC_TOGETHER = 512, 1 << 22


class Crc:
    """Checksums of many byte strings at once: every block of every string advances in the same steps, and blocks are joined by the linear map that a block of zeros applies to a state. Zeros before a string leave a state of 0 as it is, so strings are filled up in front, and the initial state is laid over the first bytes."""

    def __init__(self, polynomial: int, initial: int, reflected: bool, final_xor: int, width: int):
        if width % 8 or not 8 <= width <= 64:
            raise ValueError("width is 8 to 64 bits, in whole bytes")
        self.initial, self.reflected, self.final, self.bytes = initial, reflected, final_xor, width // 8
        self.full, self.top = np.uint64((1 << width) - 1), np.uint64(width - 8)
        self.table = np.array(crc_table(polynomial, width, reflected), np.uint64)
        states = (np.arange(256, dtype=np.uint64) << np.arange(0, width, 8, dtype=np.uint64)[:, None]).ravel()
        zero = np.zeros(len(states), np.uint64)
        for _ in range(CRC_BLOCK):
            states = self.step(states, zero)
        self.past_block = states.reshape(self.bytes, 256)

    def step(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.reflected:
            return self.table[(state ^ x) & np.uint64(255)] ^ (state >> np.uint64(8))
        return self.table[((state >> self.top) ^ x) & np.uint64(255)] ^ ((state << np.uint64(8)) & self.full)

    def short(self, data: bytes) -> int:
        state = np.array([self.initial], np.uint64)
        for x in data:
            state = self.step(state, np.uint64(x))
        return int(state[0])

    def _together(self, data: list[bytes]) -> np.ndarray:
        blocks = np.array([-(-len(x) // CRC_BLOCK) for x in data])
        first = np.cumsum(blocks) - blocks
        laid = np.zeros(int(blocks.sum()) * CRC_BLOCK, np.uint8)
        start = np.frombuffer(self.initial.to_bytes(self.bytes, "little" if self.reflected else "big"), np.uint8)
        for x, f, n in zip(data, first, blocks, strict=True):
            at = (f + n) * CRC_BLOCK - len(x)
            laid[at : at + len(x)] = np.frombuffer(x, np.uint8)
            laid[at : at + self.bytes] ^= start
        columns = np.ascontiguousarray(laid.reshape(-1, CRC_BLOCK).T)
        part = np.zeros(columns.shape[1], np.uint64)
        for column in columns:
            part = self.step(part, column.astype(np.uint64))
        order = np.argsort(-blocks, kind="stable")
        state = np.zeros(len(data), np.uint64)
        for k in range(int(blocks.max())):
            live = order[: int(np.searchsorted(-blocks[order], -k, "left"))]
            moved = np.zeros(len(live), np.uint64)
            for i in range(self.bytes):
                moved ^= self.past_block[i][(state[live] >> np.uint64(8 * i)) & np.uint64(255)]
            state[live] = moved ^ part[first[live] + k]
        return state

    def of(self, data: list[bytes]) -> list[int]:
        out = [0] * len(data)
        held: list[int] = []
        size = 0

        def flush() -> None:
            for i, state in zip(held, self._together([data[i] for i in held]).tolist(), strict=True):
                out[i] = state

        for i, x in enumerate(data):
            if len(x) < self.bytes:
                out[i] = self.short(x)
                continue
            if held and size + len(x) > CRC_TOGETHER:
                flush()
                held, size = [], 0
            held.append(i)
            size += max(len(x), CRC_BLOCK)
        if held:
            flush()
        return [x ^ self.final for x in out]


def crc(data: Column, polynomial: int, initial: int, reflected: bool, final_xor: int, width: int = 32) -> Column:
    """A checksum of any polynomial of whole bytes up to 64 bits (input and output reflected alike); of 64 bits, as a signed long. Null stays null."""
    made = Crc(polynomial, initial, reflected, final_xor, width)

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        there = x.notna()
        found = np.array(made.of([bytes(b) for b in x[there]]), np.uint64).view(np.int64)
        return pd.Series(found, index=x.index[there], dtype="Int64").reindex(x.index)

    return run(data)


def crc32c(data: Column) -> Column:
    return crc(data, 0x1EDC6F41, 0xFFFFFFFF, True, 0xFFFFFFFF)


def verify(df: DataFrame, data: str, expected: str, algorithm: str) -> DataFrame:
    """df, or an error at run time where a digest differs."""
    same = digest(F.col(data), algorithm) == F.lower(expected)
    return df.filter(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("a digest differs"))))
