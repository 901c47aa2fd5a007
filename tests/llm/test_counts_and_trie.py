"""Token counts against the libraries, the prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tidemark.llm import prefix_trie, token_counts

SIGNS = ["a", "Zed", "é", "5", "²", "'s", "'", "'ll", " ", " ", "  ", "\n", "\t", "\r", " ", "　", " ", "\x1c", "\x85", "汉", "字", "ﬁ", "\U0001f600", "!", "…", "—", "▁", "ª", "½", "Ж", "ß", "<|endoftext|>", "\x00", "́"]


def library(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return lambda x: len(m.encode(x))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(documents, name):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "one"), (4, "x " * 5000), (5, "a b c"), (5, "a b c"), (6, " \n\t "), (None, "no id"), (7, "w" * 20000), (8, "\u001c" * 9), (9, "<|endoftext|><|endoftext|> <|endoftext|>")]
    rows += [(100 + k, "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 40)))) for k in range(300)]
    count = library(name)
    want = sorted(((i, len((t or "").encode()), n := count(t or ""), n > 512) for i, t in rows), key=str)
    path = public_tokenizers.path(name)
    assert sorted(map(tuple, token_counts.count_tokens(documents(rows), path).collect()), key=str) == want
    assert sorted(map(tuple, token_counts.count_tokens(documents(rows), path, common=2).collect()), key=str) == want  # nearly all by shuffle
    assert token_counts.count_tokens(documents([]), path).collect() == []


def test_each_pre_token_once(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts.distinct_pre_tokens(documents([(1, "a a b"), (2, " a"), (3, None)]), path).collect()
    assert sorted(map(tuple, got)) == [(" a", 2), (" b", 1), ("a", 1)]


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(4)
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        t, count = token_counts.load(public_tokenizers.path(name)), library(name)
        for size in (4, 1 << 22):
            monkeypatch.setattr(token_counts, "SLICE", size)
            for _ in range(1500):
                text = "".join(rng.choice(SIGNS[:-4]) for _ in range(rng.randrange(1, 30)))
                found = Counter()
                t.count(text, found)
                assert sum(k * n for k, n in zip(found.values(), t.pieces(list(found)), strict=True)) == count(text), text


def brute_trie(rows, regrow):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + turns[h:] if regrow else turns
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ending = sorted(c for c in ids if len(paths[c]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, d long, name string, idx long, dig string"


@pytest.fixture
def conversations(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("regrow", [True, False])
def test_trie(conversations, regrow):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "é", "", None])) for c in range(40) for t in range(rng.choice([1, 2, 3, 9, 17]))]
    rows += [(50, None, "user", "first"), (50, 0, "user", "b"), (50, 0, "user", "a"), (50, 0, "user", "a"), (None, 0, "user", "lost")]
    rows += [(60 + k, t, "user", "same") for k in range(9) for t in range(4)]
    rows += [(80, t, "user", str(t)) for t in range(70)]
    make = prefix_trie.regrown if regrow else prefix_trie.sequences
    assert _rows(prefix_trie.trie(*make(conversations(rows)))) == brute_trie(rows, regrow)


def test_small_tries(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    for rows in ([], [(None, 1, "user", "x")], [(7, None, None, None)], [(k, 0, "user", "x") for k in range(11)]):
        assert _rows(prefix_trie.trie(*prefix_trie.regrown(conversations(rows)))) == brute_trie(rows, True)
