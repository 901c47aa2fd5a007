"""Each operator against a brute-force model on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import chat, common, decontaminate, graph, licences, near, packing, pii, pitman_yor, quality_rules, ranking, warc

WORDS = [a + b for a in "bcdfglmnprst" for b in ("an", "el", "ir", "os", "ut")]
HARD = [(1, None), (2, ""), (3, "one"), (4, "x " * 5000), (5, "a b c"), (5, "a b c"), (6, " \n\t "), (7, "é ü 汉字 \U0001f600"), (None, "no id here at all today")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


# Notices of well-known licences, as their texts begin or as files carry them.
NOTICES = {
    "MIT": ["Copyright (c) 2021 Acme", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "You should have received a copy of the GNU General Public License along with this program."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
}
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."]
NOTICES["BSD-2-Clause"] = [*BSD, "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."]
NOTICES["BSD-3-Clause"] = [*BSD, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.", NOTICES["BSD-2-Clause"][-1]]


# The notices that the licences themselves recommend, wrapped, and short names.
_FREE = "This {0} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {1} General Public\nLicense as published by the Free Software Foundation; either\nversion {2} of the License, or (at your option) any later version.\n"
CANONICAL = [
    (_FREE.format("program", "", "2"), "GPL-2.0-or-later"),
    (_FREE.format("library", "Lesser", "2.1"), "LGPL-2.1-or-later"),
    (_FREE.format("library", "Library", "2.1"), "LGPL-2.1-or-later"),
    ("This code is not distributed under the GPL but released under the MIT license.", "MIT"),
    ("MIT License", "MIT"),
    ("This project is MIT licensed.", "MIT"),
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("Licensed under the Apache-2.0 license.", "Apache-2.0"),
    ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"),
    ("BSD 3-Clause License", "BSD-3-Clause"),
    ("Under the 2-clause BSD license.", "BSD-2-Clause"),
    ("Licensed under GPLv3.", "GPL-3.0"),
    ("Licensed under the GPLv2+.", "GPL-2.0-or-later"),
    ("Distributed under LGPL-2.1-or-later, as a licence goes.", "LGPL-2.1-or-later"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license", "Apache-2.0,MIT"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("The Artistic License 2.0", "Artistic-2.0"),
]


def test_licences(documents):
    import textwrap

    data, want = list(HARD), {}
    for k, (name, parts) in enumerate(NOTICES.items()):
        for j, (columns, lead) in enumerate(((72, ""), (80, ""), (72, "// "), (72, " * "), (60, "# "))):
            lines = "\n\n".join(textwrap.fill(p, columns) for p in parts).split("\n")
            data.append((100 + 10 * k + j, "code();\n\n" + "\n".join(f"{lead}{x}".rstrip() for x in lines) + "\n\nmore();"))
            want[100 + 10 * k + j] = name
    more = [
        ("Copyright 2021 Acme, licensed under the Apache License, Version 2.0", "Apache-2.0"),
        ("Not licensed under the Apache License, Version 2.0.", ""),
        ("Released under the MIT License. This work is licensed under CC BY-NC 4.0.", "CC-BY-NC,MIT"),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: Zed-9.1", "zed-9.1"),
        ("A licence of my own.", ""),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        *CANONICAL,
    ]
    for k, (text, name) in enumerate(more):
        data.append((300 + k, text))
        want[300 + k] = name
    rows = licences.scan(documents(data)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(data)
    assert {i: got[i].licences for i in want} == want
    assert got[305].n_unmatched == 1
    assert got[1].licences == got[2].licences == ""
    assert licences.scan(documents([])).count() == 0


def test_licences_sql_agrees(documents):
    import duckdb

    data = [(k, "\n".join(parts).replace(". ", ".\n")) for k, parts in enumerate(NOTICES.values())] + HARD[:-1]
    documents_table = documents(data).select("doc_id", "text").toPandas()
    with duckdb.connect() as db:
        db.register("documents", documents_table)
        want = db.execute(licences.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in licences.scan(documents(data)).collect())


def dense_model(data, how):
    """The same model in dictionaries, customer by customer; {doc_id: score} and all predictive probabilities of the last sample."""
    from tidemark.llm.words import Words, mix

    code = lambda w: pitman_yor.END if w is None else Words([w.encode()]).hash[0] >> np.uint64(8)
    texts = {i: [None, *words(t), None] for i, t in data}
    pairs = {p for t in texts.values() for p in itertools.pairwise(t)}
    c = dict.fromkeys(pairs, 0)
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for p in itertools.pairwise(t):
                c[p] += 1
    names = {w for p in pairs for w in p}
    per = lambda values, k: {w: sum(v for p, v in values.items() if p[k] == w) for w in names}
    key = {p: mix(np.array([code(p[0])]) * pitman_yor._PART + code(p[1])) for p in pairs}

    def seat(n, a, d, k, sweep):
        return int(pitman_yor.seat_on(1, 1.0, n, a, d, (k + pitman_yor._times(how.seed * 1000 + sweep, pitman_yor._SWEEP))[0])) if n else 0

    def exchange(t, before, k):
        c0 = per(t, 1)
        t0 = {w: min(n, 1) if before is None else seat(n, (how.strength + pitman_yor.discount(before.ones0, before.twos0) * before.tables) / (before.kinds + 1), pitman_yor.discount(before.ones0, before.twos0), mix(np.array([code(w)])), 500 + k) for w, n in c0.items()}
        count = per(c, 1)
        has = lambda x, n: sum(v == n for v in x.values())
        return c0, t0, pitman_yor.Sums(sum(c.values()), sum(v > 0 for v in count.values()), sum(c0.values()), sum(t0.values()), has(c0, 1), has(c0, 2), has(c, 1), has(c, 2))

    def sweep(t, c0, t0, sums, k):
        tables, d = per(t, 0), pitman_yor.discount(sums.ones1, sums.twos1)
        rest = {p: max(c0[p[1]] - t[p], 0) for p in pairs}
        return {p: seat(c[p], (how.strength + d * tables[p[0]]) * sums.root(rest[p], min(t0[p[1]], rest[p]), how), d, key[p], k) for p in pairs}

    start = {p: min(n, 1) for p, n in c.items()}
    heard = exchange(start, None, 0)
    for k in range(1, how.rounds):
        t = start
        for s in range(how.burn_in):
            t = sweep(t, *heard, s)
        heard = exchange(t, heard[2], k)
    t, mean, (c0, t0, sums) = start, dict.fromkeys(pairs, 0.0), heard
    customers, d = per(c, 0), pitman_yor.discount(sums.ones1, sums.twos1)
    for s in range(how.burn_in + how.samples):
        t = sweep(t, *heard, 100 + s)
        tables = per(t, 0)
        p_of = lambda x, w: (c.get((x, w), 0) - d * t.get((x, w), 0) + (how.strength + d * tables[x]) * sums.root(c0.get(w, 0), t0.get(w, 0), how)) / (how.strength + customers[x])
        if s >= how.burn_in:
            for p in pairs:
                mean[p] += p_of(*p) / how.samples
    trained = {w for w in names if sum(v for p, v in c.items() if p[1] == w)}
    total = {x: sum(p_of(x, w) for w in trained) + p_of(x, "never seen") for x in names}
    return {i: sum(math.log10(mean[p]) for p in itertools.pairwise(t)) for i, t in texts.items()}, total


def test_pitman_yor_is_the_dense_sampler(documents):
    rng = random.Random(21)
    data = [*HARD[:5], *[(100 + i, prose(rng, 30) + " the end" * 9) for i in range(8)]]
    want, total = dense_model(data, pitman_yor.Sampling())
    assert all(x == pytest.approx(1) for x in total.values())
    for mb in (8, 1e-4):
        got = {r.doc_id: r for r in pitman_yor.score(documents(data), bucket_mb=mb).collect()}
        assert {i: r.score for i, r in got.items()} == pytest.approx(want, rel=3e-5)
    held = [r for r in got.values() if r.held_out and r.doc_id >= 100]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pitman_yor_deals_hot_contexts(documents, monkeypatch):
    rng = random.Random(22)
    data = [(i, prose(rng, 60) + " the end" * 30) for i in range(60)]
    whole = {r.doc_id: r.score for r in pitman_yor.score(documents(data)).collect()}
    monkeypatch.setattr(pitman_yor, "HOT", 200)
    assert (pitman_yor.known_words(documents(data)).parts > 1).sum() == 2
    parts = {r.doc_id: r.score for r in pitman_yor.score(documents(data)).collect()}
    assert parts == pytest.approx(whole, rel=0.01)
    assert pitman_yor.score(documents([])).count() == 0


def test_newcomers_drawn_at_once_sit_as_one_by_one():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 400, dtype=np.uint64)
    n = np.full(400, 3000)
    for a, d in ((0.4, 0.6), (9.0, 0.2), (2000.0, 0.5)):
        new = np.full(400, a)
        side = pitman_yor.seat(n, new, d, keys, few=0)
        alone = pitman_yor.seat(n, new, d, keys ^ np.uint64(1), few=400)
        assert abs(side.mean() - alone.mean()) < 5 * (side.std() + 1e-9) / 400**0.5 * 1.5


def test_pitman_yor_moves_requests_once(spark):
    asked = spark.range(200).selectExpr("id as batch", "int(id % 7) as bucket", "binary('x') as pairs").repartition(3)
    stored = pitman_yor.dealt(asked, 5)
    assert stored.count() == 200
    back = spark.range(7).selectExpr("int(id) as bucket", "id as home").repartition(2)
    both = stored.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInPandas(lambda a, b: a[["batch"]].assign(home=b["home"].iloc[0]), "batch long, home long")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == 1  # that of the answers alone
    assert sorted((r.batch, r.home) for r in both.collect()) == [(i, i % 7) for i in range(200)]


def test_ranking(documents, spark):
    rng = random.Random(2)
    data = [(i, prose(rng, 80) if i % 4 else " ".join(w + "***" for w in prose(rng, 80).split())) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rows = ranking.score(documents([*data, *[(1000 + (i or 0), t) for i, t in HARD]]), labels).collect()
    assert len(rows) == 120 + len(HARD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.doc_id < 120 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held)
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    assert {r.predicted for r in ranking.score(documents(HARD), labels.limit(0)).collect()} == {1}
    kept = ranking.keep_good(documents(data), labels)
    assert kept.columns == documents(data).columns


def test_ranking_fits_all_pairs(spark):
    rng = np.random.default_rng(3)
    label = (rng.random(300) < 0.7).astype(int)
    x = rng.normal(size=(300, ranking.FEATURES)) + 0.5 * label[:, None] * (np.arange(ranking.FEATURES) < 4)
    model = ranking.fit(spark.createDataFrame([(int(y), bytearray(r.tobytes())) for y, r in zip(label, x, strict=True)], "quality int, x binary").repartition(3))
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)
    diff = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, ranking.FEATURES)
    w = np.zeros(ranking.FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(diff @ w))
        w += np.linalg.solve(2400 / len(diff) * (diff * (p * (1 - p))[:, None]).T @ diff + np.eye(len(w)), 2400 / len(diff) * diff.T @ p - w)
    assert np.abs(model["w"] - w).max() < 1e-4
    s, bad = np.sort((z * model["w"]).sum(axis=1)), int((label == 0).sum())
    assert abs(model["at"] - (s[bad - 1] + s[bad]) / 2) < 1e-9
    assert abs(3 / model["slope"] + model["at"] - np.median((z @ model["w"])[label == 1])) < 1e-9


def test_ranking_learns_from_every_label(spark):
    ids = [i for i in range(28_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(ids) > 20_500
    order = [r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", "xxhash64(id) as h").orderBy("h", "id").collect()]
    bad = set(order[20_000:])
    docs = spark.createDataFrame([(i, "*** ## ## ###" if i in bad else "some plain words of text") for i in ids], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    rows = ranking.score(docs, labels).collect()
    assert len(rows) == len(ids) and all(r.predicted == (r.doc_id not in bad) for r in rows)
    assert {r.doc_id for r in ranking.keep_good(docs, labels).collect()} == set(ids) - bad


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@-+ 4()%7é5") for _ in range(rng.randrange(60)))
        assert pii.joined(pii.base_spans(t)) == brute_spans(t), t
    assert pii.base_spans("1" * 200_000 + "@" * 1000) == []


def test_contextual_pii(documents):
    rng = random.Random(4)
    seeds = [(200 + i, f"{prose(rng, 6)} call hotline +1 555 010 {1000 + i} {prose(rng, 4)}") for i in range(20)]
    new = [(100, f"{prose(rng, 5)} call hotline 555-010-2222 {prose(rng, 5)}"), (101, f"{prose(rng, 5)} order number 555-010-3333 {prose(rng, 5)}")]
    docs = documents([*seeds, *new, *HARD])
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[100].n_discovered == 1
    assert got[101].n_discovered == 0
    assert got[100].n_phone == 0
    assert got[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[100].n_spans == 1
    assert clean[219].text.count("[PHONE]") == 1
    assert "555-010-2222" not in clean[100].text
    assert "555-010-3333" in clean[101].text
    assert clean[1].text is None
    assert clean[100].n_chars == len(clean[100].text)
    assert pii.find(documents([])).count() == 0


def test_contextual_pii_bootstraps(documents):
    """What one context discovers lets the next context discover: hotline, ring, dial."""
    rng = random.Random(14)
    say = lambda lead, number: f"{prose(rng, 6)} {lead} {number} {prose(rng, 4)}"
    new = [f"555-010-{2000 + k}" for k in range(9)]
    texts = [say("call hotline", f"+1 555 010 {1000 + i}") for i in range(20)]
    texts += [say("call hotline", f"({n})") for n in new[:3]]
    texts += [say("please ring us", n) for n in new[:6] for _ in range(4)]
    texts += [say("or dial (", n) for n in new[3:9] for _ in range(4)]
    texts += [say("order number", n.replace("555", "777")) for n in new]
    rows = {r.doc_id: r for r in pii.find(documents(list(enumerate(texts)))).collect()}
    assert {i for i, r in rows.items() if r.n_discovered} == set(range(20, 71))
    clean = {r.doc_id: r.text for r in pii.redact(documents(list(enumerate(texts)))).collect()}
    assert {i for i, t in clean.items() if "[PHONE]" in t} == set(range(71))


def test_left_words_are_whole_and_tokens_have_any_length():
    long = "w" * 500
    text = f"{long} {' ' * 400}Mail:\n(\" <{long}@x> tel:1.2.3.4,5.6.7.8"
    base = pii.base_spans(text)
    more = pii.candidates(text, base)
    assert [text[a:b] for _, a, b in more] == [f"{long}@x>"]
    assert pii._left_words(text, [a for _, a, _ in more]) == [f"{long} Mail:"]
    assert pii._left_words(text, [a for _, a, _ in base]) == [f"Mail: <{long}@x>"] * 2


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_are_exact(documents):
    rng = random.Random(5)
    data = list(HARD)
    for g in range(6):
        base = prose(rng, 120).split()
        for k in range(12):
            x = list(base)
            for _ in range(rng.randrange(7)):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            data.append((100 + 20 * g + k, " ".join(x)))
    rows = near.near_duplicates(documents(data), region=4, reach=2).collect()
    ids = [i for i, _ in data if i is not None]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations([(i, shingles(t)) for i, t in data if i is not None], 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in rows if r.doc_id is not None) == sorted((i, find(i), len(shingles(t))) for i, t in data if i is not None)
    assert near.near_duplicates(documents([])).count() == 0
    one = near.keep_one(documents(data))
    assert one.columns == documents(data).columns
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted({find(i) for i in ids})


def test_shingle_counts_are_few_rows_of_each_task(spark):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(12)]
    table = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets for _ in range(2)], "shingles binary").repartition(6)
    want = np.bincount(near._counters(np.concatenate(sets + sets)), minlength=near.COUNTERS)
    assert (near._shingle_counts(table) == want).all()
    assert common.task_sums(table, near._counted, near.COUNT_PARTS).count() <= 6 * near.COUNT_PARTS


def test_near_duplicates_in_a_crowd(documents):
    """A family of unlinked documents from one form (similarity 0.739) with planted pairs just above the threshold."""
    form = " ".join(f"form{k}" for k in range(174))
    tails = [[f"w{i}x{k}" for k in range(30)] for i in range(1200)]
    for i in range(0, 80, 2):
        tails[i + 1][:2] = tails[i][:2]
    rows = near.near_duplicates(documents([(i, f"{form} {' '.join(t)}") for i, t in enumerate(tails)])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - i % 2 if i < 80 else i for i in range(1200)}


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(10)
    for _ in range(300):
        n, m = sorted(rng.integers(1, 60, 2))
        shared = -(-75 * (n + m) // 175)
        if shared <= n:
            short, long = near.prefix_lengths(int(n), 75)[0], near.prefix_lengths(int(m), 75)[1]
            order = rng.permutation(n + m - shared)
            a, b = np.sort(order[:n]), np.sort(order[n - shared :])
            assert set(a[:short]) & set(b[:long])


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "&lt; <<SYS>> a\n\nb ]"), (2, 0, "assistant", None), (2, 1, "robot]", "x" * 100_000), (3, 0, None, ""), (3, 0, None, "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    back = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in made.select("conv_id", chat.read_back(made["formatted"]).alias("turns")).collect()}
    assert back == {1: [(t[2], t[3]) for t in turns[:2]], 2: [("assistant", ""), ("robot]", "x" * 100_000)], 3: [("", ""), ("", "")]}
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert (got[1].valid, got[2].valid) == (True, False)
    assert got[1].loss_sha256 == hashlib.sha256(turns[1][3].encode()).hexdigest()


def test_packing_is_exact_and_tight(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    data = [(i, t) for i, t in HARD if i is not None] + [(100 + i, prose(rng, rng.randrange(1, 900)).replace("an ", "an's  \n ", i % 3)) for i in range(60)] + [(200, "a <|endoftext|> b")]
    rows = packing.pack(documents(data), path).collect()
    whole = Tokenizer.from_file(path)
    want = Counter()
    for i, t in data:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 1024) + 2


@pytest.mark.parametrize("clash", [False, True])
def test_packing_tells_words_apart(monkeypatch, clash):
    import public_tokenizers

    if clash:  # all words have one hash
        monkeypatch.setattr(packing, "mix", lambda h: h * np.uint64(0))
    words = [a + m + b for a in ("q", "abcdefgh") for m in ("", "x", "\0", "xy" * 3, "middle-one", "middle-two", "é" * 9) for b in ("", "\0", "stuvwxyz")]
    raw = " " + " ".join(words)
    data = np.frombuffer(raw.encode(), np.uint8)
    start = np.flatnonzero(data == 32)
    end = np.append(start[1:], len(data))
    head, tail, kind, _ = packing.span_names(raw.encode(), start, end, np.zeros(len(start), np.int64))
    short = np.flatnonzero(end - start <= packing.HELD)
    assert len({*zip(head[short].tolist(), tail[short].tolist(), kind[short].tolist(), strict=True)}) == len({raw.encode()[start[k] : end[k]] for k in short.tolist()})
    tokenizer = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in ([" ".join(words), " ".join(words[::-1])], [" ".join(words[k:]) for k in range(0, len(words), 3)]):
        texts = [t.strip(" ") for t in texts]
        want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in tokenizer.encode([t.encode() for t in texts])] == want


def test_packing_keeps_every_capacity():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 1024, 400)
    cap = packing.Capacity(documents=3, cost=600_000)
    lengths = lengths[lengths**2 <= cap.cost]
    for rule in (packing.by_norm, packing.by_dot):
        bins = rule(lengths, cap)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        for b in bins:
            assert lengths[b].sum() <= cap.tokens
            assert len(b) <= 3
            assert (lengths[b] ** 2).sum() <= cap.cost


def test_quality_ledger(documents):
    rng = random.Random(8)
    data = [*HARD, (20, prose(rng, 60)), (21, "same five words again here " * 9), (22, "AAA BBB! " * 30), (23, "\n".join(["line one"] * 4))]
    rows = {r.doc_id: r for r in quality_rules.judge(quality_rules.ledger(documents(data))).collect()}
    for i, t in data:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (rows[i].n_words, rows[i].n_repeat_words) == (len(w), len(repeated))
        assert rows[i].base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    assert rows[20].kept
    assert not rows[22].kept
    ab = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(documents(data))).collect()}
    assert ab["few_words"].n_failed == sum(r.n_words < 10 for r in rows.values()) + 1  # one id is there twice
    assert quality_rules.ablations(quality_rules.ledger(documents([]))).first().n_rejected == 0


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 3000
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", "é" * 900), (None, "u", long), (2, "u", long), (9, "http://h/" + "u" * (3 << 20), "long address")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(spark, pages).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got)
    assert kinds == sorted([(1, "revisit", 2, 3003), (2, "response", 0, 3003), (2, "response", 0, 3003), (0, "revisit", 2, 3003), (3, "response", 0, 0), (4, "response", 0, 5), (5, "response", 0, 5), (6, "response", 0, 1800), (9, "response", 0, 12)])
    assert {r.payload_digest for r in got} == {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_warc_reader_frames_and_checks(size):
    import io

    body = [b"abc" * 500, b"", b"\r\n\r\n" * 9]
    raw = b"".join(warc.member(k, "u", x, len(x), hashlib.sha1(x).hexdigest(), None) for k, x in enumerate(body))
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(raw), size, True)] == body
    with pytest.raises(warc.Bad):
        list(warc.read_archive(io.BytesIO(raw[:-9]), size))
    wrong = warc.member(1, "u", b"abc", 3, "0" * 40, None)
    with pytest.raises(warc.Bad):
        list(warc.read_archive(io.BytesIO(wrong), size))


def test_decontamination(documents, spark):
    rng = random.Random(9)
    item = "A train leaves with Alice toward the coast and covers 60 km in 3 hours before it meets another train coming"
    other = item.replace("Alice", "Robert").replace("60 km", "75 miles").replace("3 hours", "9 days")
    broken = "with Bob toward the coast and covers 5 km in 5 hours before it meets Bob"
    bench = spark.createDataFrame([(1, item), (2, prose(rng, 6)), (3, None), (4, "too short")], "item_id long, text string")
    clean = [(50 + i, prose(rng, 200)) for i in range(20)]
    docs = documents([*HARD, *clean, (10, f"{prose(rng, 30)} {item} {prose(rng, 30)}"), (11, f"{prose(rng, 30)}. {other} {prose(rng, 9)}"), (12, item.upper()), (13, f"so {broken}")])
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {10, 11, 12}
    assert got[11].item_ids == "1"
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 3
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_judges_rows(documents, spark):
    item = "A train leaves with Alice toward the coast and covers 60 km in 3 hours before it meets another train coming"
    one, two = item.replace("Alice", "Robert").replace("60", "75"), item.replace("Alice", "Carla").replace("3 hours", "8 days")
    bench = spark.createDataFrame([(1, item), (1, "unlike the other text of this item in every word there is"), (None, "four words of none")], "item_id long, text string")
    docs = documents([(7, one), (7, two), (7, "nothing of it"), (None, one), (None, two), (None, None)])
    assert sorted(r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()) == [False] * 2 + [True] * 4
    assert {r.text for r in decontaminate.keep_clean(docs, bench).collect()} == {"nothing of it", None}
    assert decontaminate.decontaminate(documents([]), bench).count() == 0


def test_decontamination_of_short_and_dense_questions(documents, spark):
    rng = random.Random(11)
    bench = spark.createDataFrame(
        [
            (1, "Anna buys 3 kg of apples at 2 dollars each"),
            (2, "Why is grass green?"),
            (3, "Compute 3 km plus 4 km plus 12 miles minus 7"),
            (4, "add 14 and 6 then subtract 3"),
            (5, f"Carol {prose(random.Random(12), 6)}"),
        ],
        "item_id long, text string",
    )
    texts = [
        (1, "Ben buys 5 kg of apples at 4 dollars each", "1"),
        (2, f"{prose(rng, 9)}. Ben buys 5 kg of apples at 4 dollars each {prose(rng, 9)}", "1"),
        (3, f"{prose(rng, 9)} Why is grass green? {prose(rng, 9)}", "2"),
        (4, f"{prose(rng, 9)} compute 8 km plus 5 km plus 30 miles minus 9 {prose(rng, 9)}", "3"),
        (5, f"{prose(rng, 9)} add 5 and 7 then subtract 2", "4"),
        (6, f"so Dora {prose(random.Random(12), 6)}", "5"),
        (7, f"{prose(rng, 9)} Ben buys 5 kg of pears for 4 dollars", ""),
        (8, f"{prose(rng, 9)} why is grass red", ""),
        (9, "Ben buys 5 kg of apples at 5 dollars each", ""),
        (10, prose(rng, 300), ""),
    ]
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(documents([x[:2] for x in texts]), bench).collect()}
    assert got == {i: found for i, _, found in texts}


def tasks_of(spark, group, run):
    """What run() returns, and how many tasks Spark planned for it."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    at = spark.sparkContext.statusTracker()
    return out, sum(at.getStageInfo(s).numTasks for j in at.getJobIdsForGroup(group) for s in at.getJobInfo(j).stageIds if at.getStageInfo(s))


def test_ranking_reads_few_labelled_rows_in_few_tasks(spark):
    rng = np.random.default_rng(5)
    label, x = rng.integers(0, 2, 400), rng.normal(size=(400, ranking.FEATURES))
    x[:, 0] += label
    rows = spark.createDataFrame([(int(y), bytearray(r.tobytes())) for y, r in zip(label, x, strict=True)], "quality int, x binary")
    one = ranking.fit(common.materialise(rows.repartition(1)))
    spread = common.materialise(rows.repartition(60))
    model, tasks = tasks_of(spark, "fit of 60 parts", lambda: ranking.fit(spread))
    assert tasks <= 400  # two passes over 60 parts a round were 60 * 2 * rounds
    assert np.abs(model["w"] - one["w"]).max() <= 1e-7
    assert abs(model["at"] - one["at"]) <= 1e-5


def test_order_statistics_of_several_ranks(spark):
    rng = random.Random(7)
    values = [rng.choice([0.0, 1e-9, 2e-9, 5.0, 1e6, -3.5]) + k % 13 for k in range(500)]
    scores = spark.createDataFrame([(v,) for v in values], "s double").repartition(3)
    ranks = [0, 249, 250, 499]
    assert ranking.order_statistics(scores, ranks, parts=4) == [sorted(values)[r] for r in ranks]


def test_sums_of_many_tasks_are_added_before_the_driver(spark):
    def gather(batches):
        x = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches] or [np.zeros(0, np.int64)])
        return common.added_up(x % 7, np.ones(len(x)))

    for parts in (3, 40):
        at, n = common.tree_summed(spark.range(0, 1000, 1, parts), gather, parts)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == Counter(k % 7 for k in range(1000))


def test_components_that_are_stars_take_no_step(spark, monkeypatch):
    stored, keep = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: stored.append(1) or keep(df))

    def found(links):
        stored.clear()
        return {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}

    assert found([(1, 5), (7, 1), (1, 5), (2, 9), (3, 3), (None, 4)]) == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2}
    assert len(stored) == 1
    assert found([]) == {}
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)]
    least = {k: k for ab in links for k in ab if ab[0] != ab[1]}
    for _ in range(300):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found(links) == least
