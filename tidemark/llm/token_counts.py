"""Tokens of every document, counted without its ids: pieces once per distinct pre-token, joined to per-document frequencies.

A tokenizer cuts a text into pre-tokens and merges inside each alone, so a text has as many tokens as its pre-tokens have pieces. One pass finds the distinct pre-tokens of the corpus; each is given to the model once. A second pass finds the pre-token frequencies of every document and joins them with the pieces: the COMMON most frequent pre-tokens, a table of bounded size, are looked up where the text is; the rest are joined by shuffle, where no key is hot, as what many documents hold is among the frequent ones. Both ways give the same counts.

Byte-level pre-tokens of texts in characters whose class no Unicode version has changed are found by their published pattern; other texts are cut at spaces before other characters, where a pre-token always begins, and each distinct piece is given to the library's own pre-tokenizer.

Defined results: a null or empty text has no bytes and no tokens; repeated rows, also with repeated or null doc_ids, are counted one by one; an empty table gives no rows; texts may have any length; an added token's string inside a text is one token, as is the library's default. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_folder, most_frequent, small_batches

#: Most frequent pre-tokens that every worker holds with their pieces.
COMMON = 1 << 19
#: Distinct pieces of text that a worker remembers, and pre-tokens that a task gathers, before it starts anew.
REMEMBERED = 400_000
#: Characters of a text that are cut at once.
SLICE = 1 << 22
#: Letters and other characters whose Unicode class is the same in every version; a text of these alone is cut by the pattern below, any other one by the library.
_LETTERS, _DIGITS = "A-Za-zÀ-ÖØ-öø-ɏА-яぁ-ゔァ-ヺ一-龥가-힣", "0-9"
_UNSURE = re.compile(rf"[^\t\n\r -~‐-‧{_LETTERS}]")
#: Fixed value: the published pattern of the byte-level pre-tokenizer, for those characters.
_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
_CUT = re.compile(r" (?=\S)")
_CUT_AFTER_OTHER = re.compile(r"(?<=[^ ]) (?=\S)")


class Pieces(dict):
    """What pre-tokens a piece of text has; forgets all when it holds too many."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, piece: str) -> list[str]:
        if len(self) > REMEMBERED:
            self.clear()
        self[piece] = out = self.find(piece)
        return out


class JsonTokenizer:
    """A tokenizer of the tokenizers library. Where its pre-tokenizer is the byte-level one with its usual pattern, texts may be cut at single spaces before other characters, and pre-tokens are named by what they are in the text; elsewhere they are named as the library writes them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = t = Tokenizer.from_file(path)
        shape = repr(t.pre_tokenizer)
        self.byte_level = t.normalizer is None and shape.startswith("ByteLevel(") and "add_prefix_space=False" in shape and "use_regex=True" in shape
        added = list(t.get_added_tokens_decoder().values())
        self.plain_added = self.byte_level and not any(x.lstrip or x.rstrip or x.single_word for x in added)
        strings = sorted((x.content for x in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.pre, self.model, self.normalizer = t.pre_tokenizer, t.model, t.normalizer
        bare = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter_of = {ord(c): bare.pre_tokenize_str(c)[0][0] for c in map(chr, range(128))}
        self.bare, self.known = bare, Pieces(self._of_piece)

    def _of_piece(self, piece: str) -> list[str]:
        if self.byte_level:
            return [piece[a:b] for _, (a, b) in self.pre.pre_tokenize_str(piece)]
        piece = self.normalizer.normalize_str(piece) if self.normalizer else piece
        return [x for x, _ in self.pre.pre_tokenize_str(piece)] if self.pre else [piece]

    def parts(self, text: str) -> tuple[list[str], int]:
        """What of the text is cut into pre-tokens, and how many tokens stand between."""
        if self.added is None or not self.added.search(text):
            return [text], 0
        if not self.plain_added:
            return [], len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        found = self.added.split(text)
        return found, len(found) - 1

    def count(self, text: str, into: Counter) -> None:
        """Adds the text's pre-tokens."""
        if not self.byte_level:
            into.update(self._of_piece(text))
            return
        for part in slices(text, _CUT):
            if not _UNSURE.search(part):
                into.update(_PRE_TOKEN.findall(part))
                continue
            first, *rest = _CUT.split(part)
            for piece, k in [(first, 1)] * bool(first) + [(" " + x, k) for x, k in Counter(rest).items()]:
                for x in self.known[piece]:
                    into[x] += k

    def _written(self, x: str) -> str:
        """A pre-token in the letters that stand for bytes."""
        return x if not self.byte_level else x.translate(self.letter_of) if x.isascii() else self.bare.pre_tokenize_str(x)[0][0]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        tokenize = self.model.tokenize
        return [len(tokenize(self._written(x))) for x in pre_tokens]


class PieceTokenizer:
    """A sentencepiece model. Where it keeps texts as they are and has no piece with a space after another character, a word with the space before it is a pre-token; elsewhere a whole text is."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        apart = not any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.vocab_size()))
        self.apart = apart and m.normalize("a  b ﬁ ") == "▁a▁▁b▁ﬁ▁"

    def parts(self, text: str) -> tuple[list[str], int]:
        return [text], 0

    def count(self, text: str, into: Counter) -> None:
        """Adds the text's words, each without the space before it, which the model adds."""
        if not self.apart or "▁" in text:  # that character counts as a space
            into.update([text] if text else [])
            return
        for k, part in enumerate(slices(text, _CUT_AFTER_OTHER)):
            into.update(_CUT_AFTER_OTHER.split(part[1:] if k else part))

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(pre_tokens, num_threads=1)]


@functools.lru_cache(maxsize=2)
def load(path: str):
    """One per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return (PieceTokenizer if path.endswith(".model") else JsonTokenizer)(path)


def slices(text: str, cuts: re.Pattern) -> Iterator[str]:
    """The text, if very long in slices that begin at cuts (each with its space)."""
    lo = 0
    while len(text) - lo > SLICE and (m := cuts.search(text, lo + SLICE)):
        yield text[lo : m.start()]
        lo = m.start()
    if text:
        yield text[lo:] if lo else text


def distinct_pre_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """token, n: each distinct pre-token of the corpus and its occurrences."""

    def run(batches):
        t = load(tokenizer)
        found: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])
            found.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in t.parts(text or "")[0]:
                    t.count(part, found)
                if len(found) > REMEMBERED:
                    yield from flush()
        yield from flush()

    return small_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def with_pieces(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """token, n, pieces: the model's work, once for each distinct pre-token."""

    def run(batches):
        t = load(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t.pieces(batch.column(0).to_pylist()), pa.int64())], ["token", "n", "pieces"])

    return tokens.select("token", "n").mapInArrow(run, VOCABULARY)


VOCABULARY = "token string, n long, pieces long"
FREQUENCIES = "row long, doc_id long, n_bytes long, n_common long, rest array<struct<token: string, k: long>>"


def frequencies(docs: DataFrame, tokenizer: str, common) -> DataFrame:
    """One row per document: a row number of its own, doc_id, n_bytes, the pieces of its common pre-tokens, and its other pre-tokens with their frequencies. common: a broadcast dictionary of pieces."""

    def run(batches):
        t, pieces = load(tokenizer), common.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            tokens, names, times, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                parts, n = t.parts(text or "")
                seen: Counter = Counter()
                for part in parts:
                    t.count(part, seen)
                for x, k in seen.items():
                    if x in pieces:
                        n += k * pieces[x]
                    else:
                        names.append(x)
                        times.append(k)
                tokens.append(n)
                ends.append(len(names))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64())], ["token", "k"]))
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1).cast(pa.binary())), 0).cast(pa.int64())
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), n_bytes, pa.array(tokens, pa.int64()), rest], ["row", "doc_id", "n_bytes", "n_common", "rest"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FREQUENCIES)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document."""
    spark = docs.sparkSession
    with_pieces(distinct_pre_tokens(docs, tokenizer), tokenizer).write.parquet(path := fresh_folder(spark, "pre-tokens"))
    vocabulary = spark.read.schema(VOCABULARY).parquet(path)
    top = most_frequent(vocabulary, "n", common).select("token", "pieces").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    frequencies(docs, tokenizer, held).write.parquet(path := fresh_folder(spark, "frequencies"))
    found = spark.read.schema(FREQUENCIES).parquet(path)
    others = found.select("row", F.inline("rest")).join(vocabulary, "token").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("n_others"))
    n_tokens = F.col("n_common") + F.coalesce("n_others", F.lit(0))
    return found.drop("rest").join(others, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
