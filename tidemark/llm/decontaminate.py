"""Benchmark decontamination by templates.

Words are canonicalised: numbers, names (capitalised words inside a sentence) and units become typed placeholders, other words lose case and ASCII punctuation; words of punctuation alone vanish. Each text is read three ways: with placeholders; with placeholders that count a sentence's first word as a name too if it is capitalised, as a name may stand there; and with every word literal, so that texts in capitals, whose every word would be a name, are met as well.

A template window has eight words, or as many more as it takes to hold five literals, so that questions dense with numbers have windows too; where its end follows from its words alone, documents and items agree on it. An item that has no such window, having less than five literals, is one window as a whole if it has five words and a literal among them. Literal windows have eight words; an item of fewer is one literal window as a whole, however short. Windows of the benchmark and of the documents are hash-joined; a fixed-size membership filter over the benchmark's windows keeps nearly all document windows from the join. A joined run (same row, item, reading and offset) counts if its slots are consistent: each benchmark value stands for one document value and the other way round, so that a re-parameterised question is caught and a coincidence of placeholders is not.

Defined results: null and empty texts match nothing; items may repeat; an item of words that are all numbers, names or units is met word for word only; each row is judged by its own text, also where a doc_id or item_id is null or repeated; empty tables give no rows, or rows without findings. Columns besides doc_id, text and item_id are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import byte_texts, materialise, runs, small_batches
from tidemark.llm.words import IS_SPACE, Words, mix

WIDTH, LITERALS = 8, 5
FILTER_BITS = 1 << 24
NUM, NAME, UNIT = (np.uint64(x) for x in (0xA11CE0001, 0xA11CE0002, 0xA11CE0003))
LITERAL = np.uint64(0x2545F4914F6CDD1D)
# Words that are units of measure or money.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g gram grams kg kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years mph kmh percent degree degrees celsius fahrenheit dollar dollars euro euros cent cents usd eur gbp watt watts volt volts amp amps joule joules newton newtons pascal kb mb gb tb".split()
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UNIT_HASHES = np.sort(Words([" ".join(UNITS).encode()], _KEEP).hash)
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?:;\n\"")] = True


def template(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template word, template word if a sentence's first word can be a name, literal word and text number of each word that isn't punctuation alone."""
    words = Words([x if x.isascii() else x.decode("utf-8", "replace").lower().encode("utf-8", "replace") for x in texts], _KEEP)
    original = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.diff(IS_SPACE[original].view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = lambda flags: np.append(0, np.cumsum(flags))
    digits = total((original >= 48) & (original <= 57))
    kept = total(_KEEP[original])
    n_digits, n_kept = (x[end] - x[start] for x in (digits, kept))
    # The first byte that counts in each word, and whether it is a capital.
    where = np.flatnonzero(_KEEP[original])
    first = where[np.minimum(kept[start], max(len(where) - 1, 0))] if len(where) else start
    c, following = original[first], original[np.minimum(first + 1, len(original) - 1)]
    capital = (c >= 65) & (c <= 90) | (c == 0xC3) & (following >= 0x80) & (following <= 0x9E)
    owner = np.searchsorted(words.bounds[1:], np.arange(len(start)), "right")
    line = total(original == 10)
    begins = np.ones(len(start), bool)
    if len(begins) > 1:
        begins[1:] = _STOPS[original[end[:-1] - 1]] | (owner[1:] != owner[:-1]) | (line[start[1:]] > line[start[:-1]])
    number, unit = (n_digits == n_kept) & (n_digits > 0), np.isin(words.hash, _UNIT_HASHES)
    readings = []
    for name in (capital & ~begins, capital):
        code = words.hash.copy()
        code[name], code[unit], code[number] = NAME, UNIT, NUM
        readings.append(code)
    real = n_kept > 0
    return readings[0][real], readings[1][real], words.hash[real], owner[real]


def is_literal(code: np.ndarray) -> np.ndarray:
    return (code != NUM) & (code != NAME) & (code != UNIT)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(max(n, 1 << 21) + 1024, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words code[start:end] for every pair, at the same cost whatever their lengths."""
    up, down = _power_tables(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code) * up[: len(code)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def template_ends(code: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the windows of at least WIDTH words that hold LITERALS literals and end as early as they can. text_end: for each word, where its text ends."""
    literal = is_literal(code)
    before = np.cumsum(literal) - literal
    where = np.append(np.flatnonzero(literal), np.full(LITERALS, len(code)))
    end = np.maximum(np.arange(len(code)) + WIDTH, where[before + LITERALS - 1] + 1)
    start = np.flatnonzero(end <= text_end)
    return start, end[start]


TEMPLATE, NAMED, BARE = range(3)


def _windows(whole: list[tuple[int, bool]], held: np.ndarray | None, items: bool):
    """(id, row, h, pos, slots, kind) of each text's windows, from (id, row, text); held: only those that the filter lets through. Of an item also the window that is its whole text, where it has no other; of a document those of the sizes in whole, (words, literal or not)."""

    def run(batches):
        for batch in batches:
            ids, numbers, texts = batch.column(0), batch.column(1), byte_texts(batch.column(2))
            for lo, hi in runs(texts):
                code, named, literal, owner = template(texts[lo:hi])
                size = np.bincount(owner, minlength=hi - lo)
                base = np.cumsum(size) - size
                text_end = (base + size)[owner]
                every = np.arange(len(code))
                rows = []
                for kind, words in ((TEMPLATE, code), (NAMED, named), (BARE, literal)):
                    if kind == BARE:
                        start = np.flatnonzero(every + WIDTH <= text_end)
                        spans = [(start, start + WIDTH)]
                    else:
                        spans = [template_ends(words, text_end)]
                    if items:
                        # Items without a window of this kind.
                        has = np.zeros(hi - lo, bool)
                        has[owner[spans[0][0]]] = True
                        some = np.bincount(owner[is_literal(words)], minlength=hi - lo) > 0
                        lone = np.flatnonzero(~has & (size > 0) if kind == BARE else ~has & some & (size >= LITERALS))
                        spans.append((base[lone], base[lone] + size[lone]))
                    else:
                        for width in (w for w, bare in whole if bare == (kind == BARE)):
                            start = np.flatnonzero(every + width <= text_end)
                            spans.append((start, start + width))
                    start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
                    if kind == NAMED and not items:
                        # A document's windows without a possible name are there already.
                        changed = np.append(0, np.cumsum(code != named))
                        new = changed[end] > changed[start]
                        start, end = start[new], end[new]
                    h = hashes(words, start, end)
                    if kind == BARE:
                        h = h ^ LITERAL
                    keep = np.ones(len(h), bool) if held is None else bloom.lets_through(held, h.view(np.int64))
                    value = np.where(is_literal(words), np.uint64(0), literal).view(np.int64)
                    for s, e, x in zip(start[keep].tolist(), end[keep].tolist(), h[keep].view(np.int64).tolist(), strict=True):
                        rows.append((int(owner[s]), x, s - int(base[owner[s]]), np.zeros(e - s, np.int64) if kind == BARE else value[s:e], kind))
                text, h, pos, slots, kinds = zip(*rows, strict=True) if rows else ([],) * 5
                at = pa.array(text, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(at), numbers.slice(lo, hi - lo).take(at), pa.array(h, pa.int64()), pa.array(pos, pa.int64()), pa.array(slots, pa.list_(pa.int64())), pa.array(kinds, pa.int32())], ["id", "row", "h", "pos", "slots", "kind"]
                )

    return run


def _row() -> Column:
    """Rows are told apart by their text besides their id; rows that agree in both are found alike."""
    return F.xxhash64(F.col("text").cast("string"))


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row, item_id, n_windows of consistent matches."""
    rows = "id long, row long, h long, pos long, slots array<long>, kind int"
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), _row().alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(_windows([], None, True), rows)
    items = materialise(items.distinct())
    bare = F.col("kind") == BARE
    literals = F.size(F.filter("slots", lambda x: x == 0))
    sizes = items.filter(F.when(bare, F.size("slots") < WIDTH).otherwise(literals < LITERALS) | (F.size("slots") < WIDTH)).select(F.size("slots"), bare).distinct()
    whole = sorted((n, b) for n, b in sizes.collect())
    held = bloom.build(items.select("h"), FILTER_BITS)
    found = small_batches(docs).select(F.col("doc_id").cast("long").alias("id"), _row().alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(_windows(whole, held, False), rows)
    both = found.select(F.col("id").alias("doc_id"), "row", "h", F.col("pos").alias("at"), F.col("slots").alias("theirs")).join(items.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "h", "pos", "slots", "kind"), "h")
    run = both.select("doc_id", "row", "item_id", "item_row", "kind", (F.col("at") - F.col("pos")).alias("shift"), "at", F.explode(F.arrays_zip("slots", "theirs")).alias("z"))
    slots = run.groupBy("doc_id", "row", "item_id", "item_row", "shift", "kind").agg(
        F.count_distinct("at").alias("n"),
        F.count_distinct(F.when(F.col("z.slots") != 0, F.col("z.slots"))).alias("a"),
        F.count_distinct(F.when(F.col("z.slots") != 0, F.col("z.theirs"))).alias("b"),
        F.count_distinct(F.when(F.col("z.slots") != 0, F.struct("z.slots", "z.theirs"))).alias("both"),
    )
    return slots.filter("a = both and b = both").groupBy("doc_id", "row", "item_id", "item_row", "shift").agg(F.max("n").alias("n")).groupBy("doc_id", "row", "item_id").agg(F.sum("n").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_windows, item_ids (comma-joined, ascending) of every row."""
    per_doc = findings(docs, benchmark).groupBy(F.col("doc_id").alias("found"), F.col("row").alias("found_row")).agg(F.sum("n_windows").alias("n"), F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"))
    return rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["found"]) & (rows["row"] == per_doc["found_row"]), "left").select(
        "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_windows"), F.concat_ws(",", F.col("items").cast("array<string>")).alias("item_ids")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which nothing of the benchmark was found, with all columns."""
    gone = findings(docs, benchmark).select(F.col("doc_id").alias("__gone"), F.col("row").alias("__row")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__row"]), "left_anti")
