"""Aligned tokens against a loop over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "be", "Zed", "é", "5", "²", "'s", "'", " ", " ", "  ", "\n", "\t", "\r", " ", "　", " ", "\x1c", "\x85", "汉", "字", "ﬁ", "\U0001f600", "!", "...", "—", "▁", "Ж", "<|endoftext|>", "</s>", "<0x41>", "\x00", "́"]


@pytest.fixture(scope="module")
def model():
    """Ids and bytes of whole texts, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def a_bytes(i):
        got = {}
        n = 0
        for x in range(256):
            if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
                got[chr(x)] = x
            else:
                got[chr(256 + n)] = x
                n += 1
        return bytes(got[c] for c in a.id_to_token(i))

    def run(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        x, y = [(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    return run


def brute(rows, model):
    done = []
    for doc_id, text in rows:
        x, y = model(text)
        ranges = []
        for side in (x, y):
            at, out = 0, []
            for i, t in side:
                out.append((at, at + len(t), i))
                at += len(t)
            ranges.append(out)
        links = Counter((p[2], q[2]) for p in ranges[0] for q in ranges[1] if p[0] < q[1] and q[0] < p[1])
        stops = sorted({p[1] for p in ranges[0]} & {q[1] for q in ranges[1]})
        groups, at = [], 0
        for e in stops:
            groups.append("|".join(",".join(str(i) for lo, hi, i in side if at <= lo and hi <= e) for side in ranges))
            at = e
        done.append((doc_id, len(x), len(y), groups, links))
    docs = Counter(pair for *_, links in done for pair in links)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((i, n_a, n_b, len(g), sum(links.values()), sum(k for p, k in links.items() if docs[p] == best[p[0]]), sum(k * docs[p] for p, k in links.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, links in done), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_against_a_loop(documents, model, monkeypatch):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "one"), (4, "x " * 300), (5, "a b c"), (5, "a b c"), (6, " \n\t "), (7, " lead and trail "), (None, "no id here"), (8, "w" * 3000), (9, "an ▁ inside")]
    rows += [(100 + k, "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 40)))) for k in range(150)]
    rows += [(300 + k, " ".join(rng.choice(["Straße", "naïve", "token", "tokens", "unbelievable", "xyzzy42", "don't", "C++", "año"]) for _ in range(rng.randrange(1, 400)))) for k in range(20)]
    want = brute(rows, model)
    assert _rows(alignment.align_documents(documents(rows), A, B)) == want
    assert _rows(alignment.align_documents(documents(rows), A, B, common=3)) == want  # nearly all pairs by shuffle
    assert alignment.align_documents(documents([]), A, B).collect() == []


def test_short_lanes_and_memory_change_nothing(model, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["token", "naïve", "zq", "a\nb", "…", "汉字"]) for _ in range(n)) for n in (1, 2, 63, 64, 65, 300)]
    whole = alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(alignment, "LANE", 1)
    monkeypatch.setattr(alignment, "REMEMBERED", 0)
    again = alignment.Aligner(A, B).align(texts)
    assert all(list(whole[k]) == list(again[k]) for k in whole)
    assert [g.count(b";") + 1 for g in whole["groups"]] == list(whole["n_groups"])


def test_groups_are_given(documents, model):
    got = alignment.aligned(documents([(1, "tokens apart"), (2, None)]), A, B, with_groups=True).orderBy("doc_id").collect()
    x, y = model("tokens apart")
    flat = [got[0]["groups"].replace(";", ",").replace("|", ",").split(",")]
    assert sorted(flat[0]) == sorted(str(i) for i, _ in x + y) and got[1]["groups"] == ""
    assert hashlib.sha256(got[0]["groups"].encode()).hexdigest() == got[0]["groups_sha256"]
