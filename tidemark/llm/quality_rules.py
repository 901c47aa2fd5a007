"""Quality rules as a bitmask ledger, in column expressions only.

Every rule is evaluated once; the ledger keeps the measurements and one bit per failed rule. A policy is a versioned mask over the bits; applying one, or asking what each rule alone is answerable for, reads only the ledger.

Defined results: a null or empty text has no words and fails few_words; repeated rows are judged each; an empty table gives an empty ledger and ablations of 0. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rules in the order of their bits: name and when it fails, in terms of the measurements.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 4 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("capitals", "2 * n_upper > word_chars"),
    ("exclamations", "4 * n_exclaims > 3 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject a document.
POLICIES = {"v1": BIT["few_words"] | BIT["repeated_words"], "v2": sum(BIT.values())}


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>")))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull()))
        return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - i, F.lit(width)))), F.lit(0), lambda a, b: a + b))

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"), F.size(F.filter(w, lambda x: x.endswith("!"))).cast("long").alias("e"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        without("[A-ZÀ-ÖØ-Þ]").cast("long").alias("n_upper"),
    ).select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_upper", F.col("w.e").alias("n_exclaims"))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and failed, the bits of the rules that a row fails."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failed", total.cast("long"))


def judge(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds base_failed (policy v1) and kept under the named policy; what v1 rejects is never kept."""
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", hit(POLICIES["v1"])).withColumn("kept", ~hit(POLICIES["v1"] | POLICIES[policy]))


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """rule, n_failed, n_alone (kept if this rule were dropped from the policy), n_rejected of the whole policy; one pass."""
    mask = POLICIES[policy]
    under = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.sum((F.col("failed").bitwiseAND(F.lit(b)) != 0).cast("long")).alias(f"f{b}") for b in BIT.values()] + [F.sum((under == b).cast("long")).alias(f"a{b}") for b in BIT.values()]
    one = rows.agg(*sums, F.sum((under != 0).cast("long")).alias("n_rejected"))
    parts = [F.struct(F.lit(n).alias("rule"), F.coalesce(f"f{b}", F.lit(0)).alias("n_failed"), F.coalesce(f"a{b}", F.lit(0)).alias("n_alone"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected")) for n, b in BIT.items()]
    return one.select(F.inline(F.array(*parts)))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i:i+4] AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1))) AS i)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM t, (SELECT unnest(range(0, 5)) AS k) WHERE t.n > 1 GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS BIGINT) AS n_upper, CAST(len(list_filter(ws, lambda x: suffix(x, '!'))) AS BIGINT) AS n_exclaims FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)} AS BIGINT) AS failed FROM m)
SELECT *, (failed & {POLICIES["v1"]}) <> 0 AS base_failed, (failed & {POLICIES["v1"] | POLICIES["v2"]}) = 0 AS kept FROM f"""
