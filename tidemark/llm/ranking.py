"""Quality classifier by pairwise ranking: a Bradley-Terry model over text features.

A document's score is linear in its features; of a pair of labelled documents the better one wins with the logistic of the score difference. Every labelled document of one class meets every one of the other; Newton's method minimises the regularised logistic loss of all these pairs. The threshold is the quantile of the training scores at the share of low-quality labels, and scores are mapped so that it becomes 0.7.

Data flow. Labelled features are stored once, and each Newton round passes over them twice. The loss of all pairs depends on the opponents by the distribution of their scores alone: the first pass counts scores on a grid (a score between two points is shared by them), from which the driver finds how much any score loses against a class; the second pass sums gradient and curvature by these tables. To the driver come sums and grid counts, whose number doesn't grow with the rows. Threshold and slope are exact order statistics, found by narrowing ranges of scores. Features take a small part of their texts' room, so the rounds read them in fewer tasks than there are parts of the input.

Defined results: null or empty text has all features 0 and is scored like any other; of labelled rows that repeat a doc_id the lowest label and one text count; null labels and ids are not learned from; without labels of both classes every score is 0.7, so that nothing is rejected; an empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import added_up, byte_texts, materialise, remainder, runs, small_batches, summed, tree_summed
from tidemark.llm.words import Words, windows

THRESHOLD = 0.7
#: Width of the score grid on which opponents are counted, and of the one on which their features are summed, which only the curvature needs.
STEP, COARSE = 1 / 64, 1 / 8
#: Labelled rows of a task of a Newton round, of some 150 bytes each.
TASK_ROWS = 1 << 16
#: Bits of the membership filter that spares documents without a label.
FILTER_BITS = 1 << 23
_CLASSES = [b"#*$%&<>~^_=+@", b"|", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", bytes(range(128, 256)), b" \t\r\n\x0b\x0c", b"()[]{}\"'`\\/-"]
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    _TABLE[list(_bytes), _k] = 1
FEATURES = len(_CLASSES) + 9


def features(texts: list[bytes]) -> np.ndarray:
    """One row of bounded numbers per text: log length, shares of byte classes, word lengths, and repeats of words, neighbours, five-word windows and lines."""
    out = np.zeros((len(texts), FEATURES))
    for lo, hi in runs(texts):
        words = Words(texts[lo:hi])
        lengths = words.end - words.start
        for k, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True), lo):
            x, n = texts[k], int(b - a)
            if not n:
                continue
            h, row = words.hash[a:b], out[k]
            shares = np.bincount(np.frombuffer(x, np.uint8), minlength=256) @ _TABLE / len(x)
            row[: len(_CLASSES)] = np.sqrt(shares)
            grams = windows(h, min(5, n))
            lines = [y for y in x.split(b"\n") if y.strip()]
            distinct = len(np.unique(h))
            row[len(_CLASSES) :] = [
                np.log1p(n) / 10,
                lengths[a:b].mean() / 10,
                lengths[a:b].std() / 10,
                distinct / n,
                np.log(distinct) / np.log(n) if n > 1 else 1,
                (h[1:] == h[:-1]).mean() if n > 1 else 0,
                1 - len(np.unique(grams)) / len(grams),
                1 - len(set(lines)) / len(lines),
                len(lines) / n,
            ]
    return out


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -6, 6)


def _sums(rows: DataFrame, part, tasks: int | None = None) -> dict[int, float]:
    """The sums over all rows (quality, x) of what part(label, x) gives for some of them: long keys and values. A task adds up its own first; tasks: how many there are, if that is known."""

    def gather(batches):
        at, value = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), float).reshape(-1, FEATURES)
                more = part(batch.column(0).to_numpy(zero_copy_only=False), x)
                at, value = added_up(np.append(at, more[0]), np.append(value, more[1]))
        return at, value

    rows = rows.select("quality", "x")
    at, value = tree_summed(rows, gather, tasks) if tasks else summed(rows, gather, 4)
    return dict(zip(at.tolist(), value.tolist(), strict=True))


def _spread(weights: np.ndarray, kernel, step: float) -> np.ndarray:
    """Sum of weights[j] * kernel((i - j) * step) over j for each i; weights may have several columns."""
    n = len(weights)
    size = 1 << (3 * n).bit_length()
    k = kernel(np.arange(1 - n, n) * step)
    flat = weights.reshape(n, -1)
    out = np.fft.irfft(np.fft.rfft(k, size)[:, None] * np.fft.rfft(flat, size, axis=0), size, axis=0)[n - 1 : 2 * n - 1]
    return out.reshape(weights.shape)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _grid_counts(w, centre, scale):
    """For `_sums`: labels' scores by class on the grid; key 2 * point + label."""

    def part(label, x):
        s = _standard(x, centre, scale) @ w / STEP
        low = np.floor(s).astype(np.int64)
        high = s - low
        at, inverse = np.unique(np.concatenate([2 * low + label, 2 * low + 2 + label]), return_inverse=True)
        return at, np.bincount(inverse, weights=np.concatenate([1 - high, high]))

    return part


def _slopes(w, centre, scale, first: int, tables: np.ndarray, counts: tuple[int, int]):
    """For `_sums`: per class means of z times loss (keys from 0), of z z' times curvature (from FEATURES on), and sums of z by class and coarse point (around 1 << 40)."""
    squares = FEATURES * FEATURES

    def part(label, x):
        z = _standard(x, centre, scale)
        s = z @ w
        place = np.clip(s / STEP - first, 0, tables.shape[-1] - 1)
        low = np.minimum(place.astype(np.int64), tables.shape[-1] - 2)
        high = place - low
        loss, bend = (tables[k, label, low] * (1 - high) + tables[k, label, low + 1] * high for k in (0, 1))
        share = np.where(label == 1, 1 / counts[1], 1 / counts[0])
        gradient = z.T @ (np.where(label == 1, loss, -loss) * share)
        square = (z * (bend * share)[:, None]).T @ z
        kind = 2 * np.floor(s / COARSE + 0.5).astype(np.int64) + label
        kinds, inverse = np.unique(kind, return_inverse=True)
        held = np.zeros((len(kinds), FEATURES))
        np.add.at(held, inverse, z * share[:, None])
        far = (1 << 40) + (kinds[:, None] * FEATURES + np.arange(FEATURES)).ravel()
        return np.concatenate([np.arange(FEATURES + squares), far]), np.concatenate([gradient, square.ravel(), held.ravel()])

    return part


def fit(rows: DataFrame, each: int = 8, ridge: float = 1.0, rounds: int = 30) -> dict:
    """Weights, centre and scale of the features, and slope and threshold of the mapping to 0..1, from all rows (quality, x). All pairs together weigh as much as if every row met `each` of the other class."""
    got = _sums(rows, lambda label, x: (np.arange(2 + 2 * FEATURES), np.concatenate([[(label == 0).sum(), (label == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)])))
    counts = int(got.get(0, 0)), int(got.get(1, 0))
    if not all(counts):
        return {}
    n = sum(counts)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS))
    rows = rows.coalesce(tasks)
    total = np.array([got[k] for k in range(2, 2 + 2 * FEATURES)]).reshape(2, -1) / n
    centre = np.round(total[0], 12)
    scale = np.round(np.maximum(np.sqrt(np.maximum(total[1] - total[0] ** 2, 0)), 1e-6), 12)
    w = np.zeros(FEATURES)
    for _ in range(rounds):
        grid = _sums(rows, _grid_counts(w, centre, scale), tasks)
        first = min(grid) // 2
        weights = np.zeros((max(grid) // 2 - first + 1, 2))
        for key, value in grid.items():
            weights[key // 2 - first, key % 2] = value / counts[key % 2]
        # A good one loses against the bad ones above it, a bad one against the good ones below it.
        bend = lambda x: _logistic(x) * _logistic(-x)
        tables = np.stack([[_spread(weights[:, 1], _logistic, STEP), _spread(weights[:, 0], lambda x: _logistic(-x), STEP)], [_spread(weights[:, 1], bend, STEP), _spread(weights[:, 0], bend, STEP)]])
        got = _sums(rows, _slopes(w, centre, scale, first, tables, counts), tasks)
        ends = np.array([k for k in got if k >= 1 << 39])
        places = (ends - (1 << 40)) // FEATURES // 2
        held = np.zeros((places.max() - places.min() + 1, 2, FEATURES))
        for key, place in zip(ends.tolist(), places.tolist(), strict=True):
            k = key - (1 << 40)
            held[place - places.min(), k // FEATURES % 2, k % FEATURES] = got[key]
        crossed = held[:, 1].T @ _spread(held[:, 0], bend, COARSE)
        gradient = each * n * np.array([got[k] for k in range(FEATURES)]) - ridge * w
        square = np.array([got[FEATURES + k] for k in range(FEATURES * FEATURES)]).reshape(FEATURES, FEATURES)
        step = np.linalg.solve(each * n * (square - crossed - crossed.T) + ridge * np.eye(FEATURES), gradient)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    w = np.round(w, 8)  # sums in another order end here

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), float).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((_standard(x, centre, scale) * w).sum(axis=1))], ["quality", "s"])

    scores = materialise(rows.select("quality", "x").mapInArrow(run, "quality int, s double"))
    at = sum(order_statistics(scores, [counts[0] - 1, counts[0]])) / 2
    median = sum(order_statistics(scores.filter("quality = 1"), [(counts[1] - 1) // 2, counts[1] // 2])) / 2
    return {"w": w, "centre": centre, "scale": scale, "at": at, "slope": 3 / max(median - at, 1e-6)}


def order_statistics(scores: DataFrame, ranks: list[int], parts: int = 4096) -> list[float]:
    """The numbers of those ranks (from 0) in the column s, exactly; a range that holds some of them is divided until it holds one distinct number. Ranks of one range share its passes."""
    first = scores.agg(F.min("s"), F.max("s")).first()
    found = [(*first, rank) for rank in ranks]
    while wide := [(lo, hi) for lo, hi, _ in found if lo < hi]:
        lo, hi = wide[0]
        place = F.least(F.floor((F.col("s") - lo) / (hi - lo) * parts), F.lit(parts - 1))
        counted = sorted(scores.filter(F.col("s").between(lo, hi)).groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect(), key=lambda row: row["p"])
        for k, (*at, rank) in enumerate(found):
            if at == [lo, hi]:
                for row in counted:
                    if rank < row["n"]:
                        found[k] = row["lo"], row["hi"], rank
                        break
                    rank -= row["n"]
    return [lo for lo, _, _ in found]


def score_rows(x: np.ndarray, model: dict) -> np.ndarray:
    if not model:
        return np.full(len(x), THRESHOLD)
    s = (_standard(x, model["centre"], model["scale"]) * model["w"]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (s - model["at"]) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def known_labels(labels: DataFrame, modulus: int, rest: int) -> DataFrame:
    """(doc_id, quality) of the labels that are learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(remainder(F.col("doc_id"), modulus) != rest)
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def _features(batches):
    """(doc_id, text) to (doc_id, x)."""
    for batch in batches:
        x = features(byte_texts(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def train(found: DataFrame, known: DataFrame) -> dict:
    """Fits on all labelled documents, from their features (doc_id, x) and labels (doc_id, quality)."""
    return fit(materialise(found.join(known.hint("merge"), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("quality", "x")))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from documents whose crc32(doc_id) % modulus isn't rest. Each text is read once, its features are stored."""
    found = materialise(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features, "doc_id long, x binary"))
    model = train(found, known_labels(labels, modulus, rest))

    def run(batches):
        for batch in batches:
            s = score_rows(np.frombuffer(b"".join(batch.column(2).to_pylist()), float).reshape(-1, FEATURES), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return found.select("doc_id", (remainder(F.col("doc_id"), modulus) == rest).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """The rows of docs that are predicted 1, with all columns. The text is scored in place, so that no join is needed; features of labelled documents are found before that, for the fit."""
    known = known_labels(labels, modulus, rest)
    wanted = bloom.build(known.select("doc_id"), FILTER_BITS)

    def run(batches):
        for batch in batches:
            keep = np.flatnonzero(bloom.lets_through(wanted, batch.column(0).to_numpy(zero_copy_only=False)))
            if len(keep):
                yield from _features([batch.take(pa.array(keep))])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    model = train(rows.mapInArrow(run, "doc_id long, x binary"), known)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        return pd.Series(score_rows(features([(t or "").encode("utf-8", "surrogatepass") for t in text]), model))

    return docs.filter(scored(F.col("text").cast("string")) >= THRESHOLD)
