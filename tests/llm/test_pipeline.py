"""The pipeline stage by stage against plain Python, each stage on what its predecessor wrote, and then as a whole."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import packing

WORDS = [a + b for a in "bcdfglmnprst" for b in ("an", "el", "ir", "os", "ut")]
ITEM = "A train leaves with Alice toward the coast and covers 60 km in 3 hours before it meets another train coming"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Ids below 200: good ones, of which from 100 on copies with a word changed; 200 on: poor ones; 300 on: good ones with an item; 400 on: with an address."""
    rng, rows = random.Random(17), []
    for i in range(40):
        rows.append((i, " ".join(prose(rng, 120))))
    for i in range(20):
        copy = rows[i][1].split()
        copy[rng.randrange(120)] = "changed"
        rows += [(100 + i, " ".join(copy)), (120 + i, rows[i][1])]
    rows += [(200 + i, " ".join(w + "***" for w in prose(rng, 120))) for i in range(40)]
    rows += [(300 + i, " ".join([*prose(rng, 60), ITEM, *prose(rng, 60)])) for i in range(5)]
    rows += [(400 + i, " ".join([*prose(rng, 60), f"mail.{i}@host.example.org", *prose(rng, 60)])) for i in range(5)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 300), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def smallest_of_each_group(texts):
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(t) for i, t in texts.items()}
    for i, j in itertools.combinations(sorted(texts), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {find(i) for i in texts}


def pieces(texts):
    whole, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in texts.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    return want


def test_every_stage_and_the_whole(spark, corpus, tmp_path):
    folder, texts = corpus
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "decontamination", "personal data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(kept[-1])
    good, single, clean, masked = kept
    assert set(good) == {i for i in texts if not 200 <= i < 300}
    assert set(single) == smallest_of_each_group(good)
    assert set(clean) == {i for i, t in single.items() if ITEM not in t}
    assert set(masked) == set(clean)
    for i, t in masked.items():
        assert not re.search(EMAIL, t)
        if not re.search(EMAIL, clean[i]):
            assert t == clean[i]
        else:
            before, after = re.split(r"\S+@\S+", clean[i])
            assert t.startswith(before)
            assert t.endswith(after)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces(masked)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [a + n for a, n in sorted(b)]
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]]
        assert ends[-1] <= 1024
