"""State machines with few states over sequences of any length, in parallel.

What a row does to the state is a function from the states to the states. Functions compose, and composing is associative, so a stretch of rows is one function too. Each block of neighbouring rows is composed to one function; blocks' functions are composed to those of FAN blocks, and so on until few are left; then each block is told its first state, and a second pass over the rows gives every row its state and output. No sequence is walked in one task, and a block sends on as many numbers as the machine has states.

With a key every key's rows are a sequence of its own: the first row of a key starts anew, which is a function as well (the same state from every state), so keys of any size are split like other rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import with_index
from tidemark.operators.storage import pinned

#: Rows of a block; functions that are composed together.
BLOCK, FAN = 1 << 16, 1 << 12


@dataclass(frozen=True)
class Machine:
    """steps: (state, symbol) -> (next state, output or None). A symbol without a step leaves the state as it is and puts out nothing."""

    states: tuple[str, ...]
    steps: dict[tuple[str, str], tuple[str, str | None]] = field(default_factory=dict)
    start: str | None = None

    @property
    def first(self) -> int:
        return self.states.index(self.start) if self.start is not None else 0

    def symbols(self) -> list[str]:
        return sorted({s for _, s in self.steps})

    def tables(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """By symbol (the last one stands for all without steps) and state: the next state; the number of the output, 0 for none; outputs."""
        known = self.symbols()
        goes = np.tile(np.arange(len(self.states)), (len(known) + 1, 1))
        says = np.zeros_like(goes)
        outputs = sorted({o for _, o in self.steps.values() if o is not None})
        for (state, symbol), (after, output) in self.steps.items():
            k, s = known.index(symbol), self.states.index(state)
            goes[k, s] = self.states.index(after)
            says[k, s] = 0 if output is None else outputs.index(output) + 1
        return goes, says, outputs


def then(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Row by row: first f, then g."""
    return np.take_along_axis(g, f, axis=-1)


def composed(functions: np.ndarray) -> np.ndarray:
    """All rows' functions, one after another, as one."""
    while len(functions) > 1:
        odd = functions[-1:] if len(functions) % 2 else functions[:0]
        functions = np.concatenate([then(functions[: len(functions) // 2 * 2 : 2], functions[1::2]), odd])
    return functions[0]


def prefixes(functions: np.ndarray) -> np.ndarray:
    """For each row, its own function after all before it."""
    out, reach = functions.copy(), 1
    while reach < len(out):
        out[reach:] = then(out[:-reach].copy(), out[reach:])
        reach *= 2
    return out


def _before(blocks: DataFrame, identity: list[int], fan: int) -> DataFrame:
    """__block and __f, the function of all blocks before it, from each block's own function. A step up composes `fan` blocks; the top is one step's worth of rows."""
    up = blocks.withColumn("__up", F.floor(F.col("__block") / fan))

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        f = composed(np.stack(part.sort_values("__block")["__f"].to_list()))
        return pd.DataFrame({"__block": [int(part["__up"].iloc[0])], "__f": [f.tolist()]})

    def inside(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"__block": np.zeros(0, np.int64), "__f": []})
        part = part.sort_values("__block")
        first = np.array(above["__f"].iloc[0] if len(above) else identity)
        f = prefixes(np.concatenate([first[None], np.stack(part["__f"].to_list())]))[:-1]
        return pd.DataFrame({"__block": part["__block"].to_numpy(np.int64), "__f": f.tolist()})

    schema = "__block long, __f array<long>"
    top = (up.agg(F.max("__up")).first()[0] or 0) == 0
    above = up.sparkSession.createDataFrame([], schema) if top else _before(pinned(up.groupBy("__up").applyInPandas(whole, schema)), identity, fan)
    return up.groupBy("__up").cogroup(above.withColumnRenamed("__block", "__up").groupBy("__up")).applyInPandas(inside, schema)


def numbered(df: DataFrame, order: str, key: str | list[str] | None) -> DataFrame:
    """df, pinned, with __i, its position in the order of the keys and `order`, and __new where a key's rows begin."""
    keys = [key] if isinstance(key, str) else list(key or [])
    rows = pinned(with_index(df, [*keys, order], name="__i"))
    if not keys:
        return rows.withColumn("__new", F.col("__i") == 0)
    firsts = rows.groupBy(*keys).agg(F.min("__i").alias("__i")).select("__i", F.lit(True).alias("__new"))
    return rows.join(firsts, "__i", "left").na.fill(False, ["__new"])


def entering(rows: DataFrame, n_states: int, first: int = 0, block: int = 0, fan: int = 0) -> DataFrame:
    """__i and __enters, the state before each row. rows: __i without gaps, __new where a sequence begins (in state `first`), and __f, an array with the state after the row for each state before it."""
    size = block or BLOCK
    narrow = pinned(rows.select("__i", "__new", "__f", F.floor(F.col("__i") / size).alias("__block")))

    def functions(part: pd.DataFrame) -> np.ndarray:
        f = np.stack(part["__f"].to_list())
        new = part["__new"].to_numpy(bool)
        f[new] = f[new][:, [first]]
        return f

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        f = composed(functions(part.sort_values("__i")))
        return pd.DataFrame({"__block": [int(part["__block"].iloc[0])], "__f": [f.tolist()]})

    def told(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"__i": np.zeros(0, np.int64), "__enters": np.zeros(0, np.int32)})
        part = part.sort_values("__i")
        enters = int(above["__f"].iloc[0][first])
        held = np.append(enters, prefixes(functions(part))[:-1, enters])
        held[part["__new"].to_numpy(bool)] = first
        return pd.DataFrame({"__i": part["__i"].to_numpy(np.int64), "__enters": held.astype(np.int32)})

    before = _before(pinned(narrow.groupBy("__block").applyInPandas(whole, "__block long, __f array<long>")), list(range(n_states)), fan or FAN)
    return narrow.groupBy("__block").cogroup(before.select(F.col("__block").alias("__of"), F.col("__f").alias("__above")).withColumnRenamed("__above", "__f").groupBy("__of")).applyInPandas(told, "__i long, __enters int")


def run(df: DataFrame, machine: Machine, symbol: Column, order: str = "seq", key: str | None = None, state: str = "state", output: str = "output", block: int = 0, fan: int = 0) -> DataFrame:
    """df with the state after each row and what the machine puts out there; a null symbol has no step."""
    known, (goes, says, outputs) = machine.symbols(), machine.tables()
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(known) for x in (s, k)]), symbol) if known else F.lit(None).cast("int"), F.lit(len(known))).cast("int")
    by_symbol = lambda table: F.element_at(F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in table]), F.col("__s") + 1)
    rows = numbered(df, order, key).withColumn("__s", number)
    states = entering(rows.withColumn("__f", by_symbol(goes)), len(machine.states), machine.first, block, fan)
    here = F.col("__enters") + 1
    named = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at)
    said = F.element_at(by_symbol(says), here)
    out = rows.join(states, "__i")
    spoken = F.when(said > 0, named(outputs, F.greatest(said, F.lit(1)))) if outputs else F.lit(None).cast("string")
    return out.withColumns({state: named(machine.states, F.element_at(by_symbol(goes), here) + 1), output: spoken}).select(*df.columns, state, output)
