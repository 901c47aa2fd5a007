"""Chat formatting from a declarative template, in column expressions only.

A finite-state machine over roles says whether a conversation's turns are in order. Each turn becomes three segments: mark, escaped text, closing mark; a flag on each says whether it counts for the loss. Marks begin with < or [, which texts hold only escaped, so the formatted text can be parsed back.

A conversation's turns come together in one row, as its text does in the output; a conversation is the unit that is formatted and hashed, so this grows with the longest conversation and not with the table.

Defined results: turns are ordered by turn, role, text (nulls first); a null text or role is empty; unknown roles are formatted under their own name and make the order invalid, as does a repeated turn of the same role; a null conv_id is a conversation of its own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let


@dataclass(frozen=True)
class Template:
    """marks: by role the text before and after, and whether the role's texts are learned. moves: from a state by role to the next; final: states in which a conversation may end."""

    marks: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>> ", " <</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("[OUT] ", " </s>", True)})
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple[str, ...] = ("answered",)


#: In this order; undone in the reverse order.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;")]
OTHER = ("[ROLE ", "] ", " [/ROLE]")


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _by_role(role: Column, t: Template, k: int, other: Column) -> Column:
    out = None
    for name, mark in t.marks.items():
        out = F.when(role == name, F.lit(mark[k])) if out is None else out.when(role == name, F.lit(mark[k]))
    return other if out is None else out.otherwise(other)


def format_conversations(turns: DataFrame, t: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, valid, segments (array of text and loss), formatted of each conversation."""
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        role, off = x["role"], F.lit(False)
        before = _by_role(role, t, 0, F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))
        return F.array(part(before, off), part(escape(x["text"]), _by_role(role, t, 2, off)), part(_by_role(role, t, 1, F.lit(OTHER[2])), off))

    def move(state: Column, x: Column) -> Column:
        out = None
        for (at, role), to in t.moves.items():
            here = (state == at) & (x["role"] == role)
            out = F.when(here, to) if out is None else out.when(here, to)
        return out.otherwise("wrong")

    return gathered.select("conv_id", F.aggregate("turns", F.lit("start"), move).isin(*t.final).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments")).select(
        "conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    )


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\[](){}.*+?|^$/" else c for c in s)


def read_back(formatted: Column, t: Template = Template()) -> Column:  # noqa: B008
    """The turns (role, text) of a formatted conversation, parsed from its text alone."""
    opens = "|".join([_quoted(m[0].rstrip(" ")) for m in t.marks.values()] + [r"\[ROLE [^\[\]<]*\]"])
    closes = "|".join([_quoted(m[1].lstrip(" ")) for m in t.marks.values()] + [r"\[/ROLE\]"])
    pattern = F.lit(rf"({opens}) ([^<\[]*) (?:{closes})")

    def role(mark: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, m in t.marks.items():
            out = out.when(mark == m[0].rstrip(" "), name)
        return out.otherwise(unescape(F.substring(mark, len(OTHER[0]) + 1, 1 << 30).substr(F.lit(1), F.length(mark) - len(OTHER[0]) - 1)))

    both = F.arrays_zip(F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("m"), F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("x"))
    return F.transform(both, lambda p: F.struct(role(p["m"]).alias("role"), unescape(p["x"]).alias("text")))


def digests(turns: DataFrame, t: Template = Template()) -> DataFrame:  # noqa: B008
    """What is read back from the formatted conversations, as counts and SHA-256 digests."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = let(read_back(F.col("formatted"), t), lambda r: F.struct(F.size(r).alias("n"), F.sha2(F.array_join(F.transform(r, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("h")))
    learned = let(loss, lambda x: F.struct(F.length(x).alias("n"), F.sha2(x, 256).alias("h")))
    return format_conversations(turns, t).select("conv_id", "valid", said.alias("said"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.col("said.n").cast("long").alias("n_turns"),
        F.col("said.h").alias("turns_sha256"),
        F.col("learned.n").cast("long").alias("loss_chars"),
        F.col("learned.h").alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


ORACLE_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;') AS safe,
  length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE role_chars + 16 END) AS BIGINT) AS formatted_chars,
  coalesce(regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+'), false) AS valid
FROM e GROUP BY conv_id"""
