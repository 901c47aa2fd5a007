"""Personal data: exact base patterns, and bootstrapped contextual extraction on top of them.

Base spans (e-mail, IP, card, phone) are the seeds. A lexical pattern is a kind and the two whole words before the one that an entity stands in, without case and punctuation; signs that stand alone are no words, so opening signs before an entity don't count. Patterns and instances (entity texts) make a bipartite graph, to which identifier-like tokens that no base pattern matches belong too. A pattern is induced by `support` distinct trusted instances: seeds, and instances whose score is `confident`. Scores alternate: a pattern's is the sum of its instances' scores over all occurrences of its two words in the corpus; an instance's is the chance that at least one of its induced patterns is right; seeds stay at 1. Instances found in one round so induce patterns in the next, until nothing changes: scores only grow and are cut to thousandths, so that this ends. Induced patterns with a score of `confident` discover the unmatched tokens after them.

Scores are joins and sums over the edge table, which has a row per distinct edge; the corpus counts of the patterns' words are summed per task before they are shuffled.

Defined results: null or empty text has no spans; repeated rows are handled each; an entity with fewer than two words before it induces no pattern; words and tokens may have any length; discovered spans never overlap base spans; an empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import byte_texts, materialise, runs, small_batches
from tidemark.llm.words import Words, windows

KINDS = ("email", "ip", "card", "phone")
FILTER_BITS = 1 << 22
#: Sets the keys of a context apart by kind.
_KIND = 0x2545F4914F6CDD1
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The contract's patterns; possessive forms and look-behinds only keep failing starts from being tried again.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Where an identifier-like token may be: five digits without a space between them, or an at sign.
_HINT = re.compile(r"[0-9](?:[^\x20\x09-\x0D0-9@]*+[0-9]){4}|@")
_GAP = frozenset(" \t\n\x0b\x0c\r")
_IDENTIFIER = re.compile(r"[0-9().+/-]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_COUNTS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind and start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((0, lo, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-like tokens that no base span touches, with the kind that their shape allows."""
    out = []
    marks = sorted((a, b) for _, a, b in taken)
    k, reach, done = 0, 0, 0
    for m in _HINT.finditer(text):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > 0 and text[a - 1] not in _GAP:
            a -= 1
        while b < len(text) and text[b] not in _GAP:
            b += 1
        done = b
        while b > a and text[b - 1] in ".,;:!?)\"'":
            b -= 1
        while a < b and text[a] in "(\"'<":
            a += 1
        while k < len(marks) and marks[k][0] < b:
            reach = max(reach, marks[k][1])
            k += 1
        if reach > a:
            continue
        token = text[a:b]
        if "@" in token:
            out.append((0, a, b))
        elif _IDENTIFIER.fullmatch(token):
            n = sum(c.isdigit() for c in token)
            kind = 1 if token.count(".") == 3 and token.replace(".", "").isdigit() else 2 if 13 <= n <= 19 else 3 if 7 <= n <= 15 else None
            if kind is not None:
                out.append((kind, a, b))
    return out


def _left_words(text: str, starts: list[int]) -> list[str]:
    """For each start of an entity, the two whole words before the word that it stands in; fewer where there are fewer."""
    out = [""] * len(starts)
    last, said = 0, None
    for k in sorted(range(len(starts)), key=starts.__getitem__):
        a = starts[k]
        # Entities that stand in one word share its context, which so is read once however long the word is.
        if said is None or _SPACE.search(text, last, a):
            size = 200
            while True:
                lo = max(0, a - size)
                # The last part belongs to the entity's own word; the first may be the end of a longer word.
                parts = _SPACE.split(text[lo:a])[1 if lo else 0 : -1]
                held = [w for w in parts if _COUNTS.search(w)]
                if len(held) >= 2 or not lo:
                    break
                size *= 4
            said = " ".join(held[-2:])
        out[k], last = said, a
    return out


def _left_contexts(pairs: list[str]) -> list[int | None]:
    """The hash of each pair of words; None where there are fewer."""
    words = Words([p.encode("utf-8", "surrogatepass") for p in pairs], _KEEP)
    out: list[int | None] = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        out.append(int(windows(words.hash[a:b], 2).view(np.int64)[0]) if b - a == 2 else None)
    return out


ENTITY = pa.struct([("ctx", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("seed", pa.bool_())])


def _extract(batches):
    turn = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = [(t.as_py() or "") for t in batch.column(1)]
        for lo in range(0, len(texts), 512):
            rows = []
            lefts: list[str] = []
            for text in texts[lo : lo + 512]:
                base = base_spans(text) if text else []
                more = candidates(text, base) if text else []
                found = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in more]
                lefts += _left_words(text, [a for _, a, _, _ in found])
                turn += 1
                rows.append((turn, text, base, found))
            ctx = iter(_left_contexts(lefts)) if lefts else iter(())
            out = []
            for uid, text, base, found in rows:
                said = joined(base)
                entities = [{"ctx": next(ctx), "kind": k, "start": a, "end": b, "instance": text[a:b].lower(), "seed": seed} for k, a, b, seed in found]
                counts = [sum(k == i for k, _, _ in base) for i in range(4)]
                out.append((uid, *counts, hashlib.sha256(said.encode()).hexdigest(), said, entities))
            cols = list(zip(*out, strict=True))
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.list_(ENTITY)]
            names = ["uid", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities"]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])


EXTRACTED = "doc_id long, uid long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<struct<ctx:long,kind:int,start:long,end:long,instance:string,seed:boolean>>"


def _occurrences(held: np.ndarray):
    """(ctx, n): how often the words of each pattern that the filter lets through stand in the texts of a task."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            texts = byte_texts(batch.column(0))
            for lo, hi in runs(texts):
                words = Words(texts[lo:hi], _KEEP)
                real = words.hash != 0  # signs alone are no words
                held_words, bounds = words.hash[real], np.append(0, np.cumsum(real))[words.bounds]
                if len(held_words) < 2:
                    continue
                h = windows(held_words, 2)
                inside = np.ones(len(held_words) + 1, bool)
                inside[bounds[1:]] = False  # a pair doesn't reach into the next text
                h = h[inside[1 : len(h) + 1]]
                h = h[bloom.lets_through(held, h.view(np.int64))]
                keys, inverse = np.unique(np.concatenate([keys, h]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, np.ones(len(h), np.int64)]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["ctx", "n"])

    return run


def confident_patterns(texts: DataFrame, entities: DataFrame, support: int = 3, confident: float = 0.6) -> DataFrame:
    """(ctx, kind, score) of the patterns that may discover. entities: ctx, kind, instance, seed of every occurrence."""
    edges = entities.filter("ctx is not null").groupBy("ctx", "kind", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    # A pattern that has only seeds discovers nothing and lends nothing; one of fewer instances is never induced.
    able = edges.groupBy("ctx", "kind").agg(F.count("*").alias("all"), F.sum(F.col("seed").cast("int")).alias("seeds")).filter((F.col("all") >= support) & (F.col("seeds") < F.col("all"))).select("ctx", "kind", "seeds")
    edges = materialise(edges.join(able, ["ctx", "kind"]))
    if not edges.filter(F.col("seeds") >= support).take(1):
        return edges.select("ctx", "kind", F.lit(0.0).alias("score")).limit(0)
    held = bloom.build(edges.select("ctx").distinct(), FILTER_BITS)
    seen = materialise(texts.select("text").mapInArrow(_occurrences(held), "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("seen")).join(edges.select("ctx").distinct(), "ctx", "left_semi"))
    instance = edges.groupBy("kind", "instance").agg(F.max("seed").alias("seed"))
    cut = lambda score: F.floor(score * 1000 + 1e-6) / 1000
    scores = instance.select("kind", "instance", F.col("seed").cast("double").alias("s"))
    before = None
    while True:
        induced = edges.join(scores, ["kind", "instance"]).groupBy("ctx", "kind").agg(F.sum(F.col("s") * F.col("n")).alias("right"), F.sum((F.col("s") >= confident).cast("int")).alias("trusted")).filter(F.col("trusted") >= support)
        patterns = materialise(induced.join(seen, "ctx").select("ctx", "kind", cut(F.least(F.lit(1.0), F.col("right") / F.greatest("seen", F.lit(1)))).alias("score")))
        now = patterns.agg(F.count("*"), F.sum(F.round(F.col("score") * 1000).cast("long"))).first()
        if now == before:
            return patterns.filter(F.col("score") >= confident)
        before = now
        lent = edges.join(patterns, ["ctx", "kind"]).groupBy("kind", "instance").agg((1 - F.product(1 - F.col("score"))).alias("lent"))
        scores = instance.join(lent, ["kind", "instance"], "left").select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(cut(F.coalesce("lent", F.lit(0.0)))).alias("s"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered, n_spans (of every kind, discovered ones too) of every row."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = materialise(rows.mapInArrow(_extract, EXTRACTED))
    entities = read.select("uid", F.explode("entities").alias("e")).select("uid", "e.*")
    patterns = confident_patterns(rows, entities)
    new = entities.filter("not seed").join(patterns.select("ctx", "kind"), ["ctx", "kind"]).groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    old = F.transform(F.filter("entities", lambda e: e["seed"]), lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end")))
    every = F.array_sort(F.concat(old, F.coalesce("found", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    said = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return read.join(new, "uid", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", said.alias("spans"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_discovered"), F.size(every).cast("long").alias("n_spans"))


def mask(text: str | None, spans: str | None) -> str | None:
    """The text with each span (kind:start:end, comma-joined) replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text and n_chars to match (where there is such a column); other columns stay. Patterns are learned on these documents; each text's base spans are found again in place, so that texts are never joined."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = rows.mapInArrow(_extract, EXTRACTED)
    entities = read.select("uid", F.explode("entities").alias("e")).select("e.*")
    patterns = materialise(confident_patterns(rows, materialise(entities)))
    found = entities.filter("not seed").join(patterns.select("ctx", "kind"), ["ctx", "kind"])
    # Only how an unmatched token is written decides here, together with its context and kind; contexts that discover something are few, and their filter has a fixed size.
    held = bloom.build(found.select(F.col("ctx").bitwiseXOR(F.col("kind").cast("long") * _KIND).alias("key")).distinct(), FILTER_BITS)

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            spans = base_spans(t) if t else []
            if t and held.any():
                more = candidates(t, spans)
                ctx = _left_contexts(_left_words(t, [a for _, a, _ in more])) if more else []
                spans += [s for s, c in zip(more, ctx, strict=True) if c is not None and bloom.lets_through(held, np.array([c ^ (s[0] * _KIND)], np.int64))[0]]
            out.append(mask(t, joined(spans)))
        return pd.Series(out)

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
