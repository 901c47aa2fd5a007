"""Words that collide under polynomial hashes modulo 2 ** 64 are told apart by every operator that hashes words."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import near, packing, pitman_yor
from tidemark.llm.words import Words


def alternating(n):
    """Two words of n letters: a where the position has an even number of one bits and b elsewhere, and the other way round."""
    flags = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[f] for f in flags), "".join("ba"[f] for f in flags)


@pytest.mark.parametrize("n", [1024, 2048])
def test_hashes_differ(n):
    x, y = alternating(n)
    assert len(set(Words([x.encode(), y.encode(), x.upper().encode()]).hash.tolist())) == 2
    keep = np.zeros(256, bool)
    keep[97:123] = True
    assert Words([b"-- a-b ab"], keep).hash.tolist()[0] == 0 and len(set(Words([b"a-b ab"], keep).hash.tolist())) == 1


@pytest.mark.parametrize("n", [1024, 2048])
def test_near(documents, n):
    x, y = alternating(n)
    got = {r["doc_id"]: r for r in near.near_duplicates(documents([(1, x), (2, y), (3, x)])).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 3)] == [1, 2, 1] and [got[k]["kept"] for k in (1, 2, 3)] == [True, True, False]


@pytest.mark.parametrize("n", [1024, 2048])
def test_packing(documents, n):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    x, y = alternating(n)
    texts = {1: x, 2: y, 3: f"lead {x}", 4: f"lead {y}"}
    for ids in ((1, 2, 3, 4), (2,), (4,)):  # alone in workers that have seen the others
        got = {(r["doc_id"], r["start"]): r for r in packing.pack(documents([(i, texts[i]) for i in ids]), path).collect()}
        for i in ids:
            want = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
            pieces = [r for (d, _), r in sorted(got.items()) if d == i]
            assert sum(r["length"] for r in pieces) == len(want)
            assert all(r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)


def test_language_model(documents):
    x, y = alternating(1024)
    train = [k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5 != 1][:6]
    held = next(k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5 == 1)
    got = {r["doc_id"]: r for r in pitman_yor.score(documents([*((k, f"{x} word") for k in train), (held, f"{y} word")])).collect()}
    assert got[held]["n_tokens"] == 3 and got[held]["n_known"] == 2
