"""Texts and lines of streams that are cut anywhere, and splits at delimiters that lie across rows."""

import random
import re

import pytest

from tidemark.operators import grouping, ordered, pieces, selection


def cut(rng, whole, most):
    out = []
    while whole:
        n = rng.randrange(0, most + 1)
        out.append(whole[:n])
        whole = whole[n:]
    return out


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 8)


SEQUENCES = [b"a", "é".encode(), "汉".encode(), "\U0001f600".encode(), b"\x80", b"\xc3", b"\xe6\xb1", b"\xf0\x9f\x98", b"\xff", b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\n", b"\r", b"\r\n", b"\xe0\x80"]


def test_decoding_across_pieces(spark, blocks):
    rng = random.Random(2)
    wholes = {k: b"".join(rng.choice(SEQUENCES) for _ in range(60)) for k in range(4)} | {9: b"\xf0\x9f", 10: b"\xe6\xb1\x89\xe6"}
    rows = [(k, i, p) for k, w in wholes.items() for i, p in enumerate(cut(rng, w, 1 + k * 2))] + [(0, 10**6, None), (77, 0, b"")]
    df = spark.createDataFrame(rows, "k long, off long, data binary").repartition(3)
    got = pieces.decode_utf8(df, key="k").collect()
    for k, w in wholes.items():
        assert "".join(r["text"] for r in sorted(got, key=lambda r: r["off"]) if r["k"] == k) == w.decode("utf-8", "replace"), w
    alone = pieces.decode_utf8(df.filter("k = 3").drop("k")).collect()
    assert "".join(r["text"] for r in sorted(alone, key=lambda r: r["off"])) == wholes[3].decode("utf-8", "replace")


def test_lines_across_pieces(spark, blocks):
    rng = random.Random(3)
    wholes = {k: "".join(rng.choice(["x", "yy", "é", "\n", "\r", "\r\n", ""]) for _ in range(50)) for k in range(5)} | {8: "\r\n", 9: "one"}
    rows = [(k, i, p) for k, w in wholes.items() for i, p in enumerate(cut(rng, w, 1 + k))] + [(70, 0, ""), (70, 1, None)]
    df = spark.createDataFrame(rows, "k long, off long, text string").repartition(3)
    got = sorted(map(tuple, pieces.lines(df, key="k").collect()))
    assert got == [(k, i, x) for k, w in sorted(wholes.items()) for i, x in enumerate(re.split("\r\n|\n|\r", w))]
    one = sorted(map(tuple, pieces.lines(df.filter("k = 2").drop("k")).collect()))
    assert one == list(enumerate(re.split("\r\n|\n|\r", wholes[2])))
    assert pieces.lines(df.limit(0), key="k").collect() == []


@pytest.mark.parametrize("by,alphabet", [("||", ["|", "a|", "|b", "||", "|||", "", None, "x"]), ("aab", ["a", "aa", "b", "ab", "aab", "ba", ""]), (".'\\", [".", "'", "\\", ".'", "'\\", "x"])])
@pytest.mark.parametrize("keyed", [True, False])
def test_resplit_across_rows(spark, blocks, by, alphabet, keyed):
    rng = random.Random(len(by))
    rows = [(rng.choice([1, 1, 1, 2, None]) if keyed else 1, i, rng.choice(alphabet)) for i in range(70)]
    df = spark.createDataFrame(rows, "k long, seq long, text string").repartition(3)
    df = df if keyed else df.drop("k")
    with pytest.raises(ValueError, match="choose other names"):
        grouping.resplit(df, by, key="k") if keyed else grouping.resplit(df, by, number="seq")
    got = grouping.resplit(df, by, key="k" if keyed else None, number="n").collect()
    for key in {r[0] for r in rows}:
        whole = "".join(t or "" for k, _, t in rows if k == key).split(by)
        whole = whole if whole[-1] else whole[:-1]
        mine = sorted((r for r in got if not keyed or r["k"] == key), key=lambda r: (r["seq"] is None, r["seq"] or 0, r["n"]))
        assert [r["piece"] for r in mine] == whole


def test_resplit_gives_the_row_that_ends_a_piece(spark):
    df = spark.createDataFrame([(1, "a|"), (2, "|b"), (3, "||c")], "seq long, text string")
    assert sorted(((r["seq"], r["k"], r["piece"]) for r in grouping.resplit(df, "||").collect()), key=str) == sorted([(2, 0, "a"), (3, 0, "b"), (None, 0, "c")], key=str)


@pytest.mark.parametrize("near_end", [10_000, 0])
def test_ends_with_ties(spark, monkeypatch, near_end):
    monkeypatch.setattr(selection, "NEAR_END", near_end)
    rows = [(1, "c"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "z")]
    df = spark.createDataFrame(rows, "seq long, v string").repartition(3)
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (0, 1, 2, 3, 5, 6, 9):
        assert sorted(map(tuple, selection.drop(df, n).collect()), key=str) == sorted(in_order[n:], key=str)
        assert sorted(map(tuple, selection.drop_right(df, n).collect()), key=str) == sorted(in_order[: max(6 - n, 0)], key=str)
        assert sorted((r["seq"], r["v"]) for r in selection.uncons_n(df, n).filter("in_head and seq is not null").collect()) == sorted(r for r in in_order[:n] if r[0])
