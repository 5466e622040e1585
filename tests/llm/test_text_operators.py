"""Each operator against a brute-force version, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF
from pyspark.sql import functions as F

from veilframe.llm import bpe, common, langid, licences, media, ngram_join, packing, suffix_dedup, tokens, toxicity

FILE = "word_bpe_49k.json"


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(FILE))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(data, k, share):
    sets = [(d, shingles(t, k)) for d, t in data]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if s and t and a is not None and b is not None and 100 * len(s & t) >= share * len(s | t):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[find(i)].append(d)
    return sorted([(d, len(s), d if d is None else min(least[find(i)])) for i, (d, s) in enumerate(sets)], key=repr)


def got_components(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()], key=repr)


def test_ngram_join_matches_brute_force(spark, docs, rows):
    assert got_components(ngram_join.join(spark, docs, 4, 85)) == brute_components([(d, t) for d, t, _ in rows], 4, 85)


def test_ngram_join_near_copies_and_chains(spark):
    base = [f"w{i}" for i in range(120)]
    data = [(i, " ".join(base[: 120 - i])) for i in range(30)] + [(100 + i, " ".join([*base[:60], *(f"z{i}_{j}" for j in range(60))])) for i in range(20)]
    data += [(200, " ".join(["v", *base[1:]])), (201, "a b"), (202, "A b"), (203, "b a")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for k, share in ((4, 85), (5, 80)):
        assert got_components(ngram_join.join(spark, df, k, share)) == brute_components(data, k, share)


def test_ngram_join_large_group_on_both_sides_of_the_threshold(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    data = [(0, " ".join(base))]
    for i in range(1, 500):  # near copies of one text, some of them just under the threshold to all others
        w = list(base)
        for at in rng.choice(150, int(rng.integers(1, 8)), replace=False):
            w[at] = f"e{i}_{at}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, data[int(rng.integers(0, 500))][1]) for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    expected = brute_components(data, 4, 85)
    sizes = defaultdict(int)
    for _, _, c in expected:
        sizes[c] += 1
    assert max(sizes.values()) > 150 and sum(n == 1 for n in sizes.values()) > 100
    assert got_components(ngram_join.join(spark, df, 4, 85)) == expected


def test_postings_pass_on_shared_tokens_in_parts(spark, monkeypatch, docs):
    whole = ngram_join.join(spark, docs, 4, 85).exceptAll
    monkeypatch.setattr(ngram_join, "_WAITING", 50)
    assert whole(ngram_join.join(spark, docs, 4, 85)).count() == 0


def test_ngram_join_odd(spark, odd, empty):
    data = [(r.doc_id, r.text) for r in odd.collect()]
    assert got_components(ngram_join.join(spark, odd, 4, 85)) == brute_components(data, 4, 85)
    assert ngram_join.join(spark, empty, 4, 85).count() == 0


def test_tokens_match_library(library, rows):
    odd_texts = ["", " ", "\x1c!\x1c!", "á éx İstanbul ΑΣ Σ", "<|endoftext|>a<|startoftext|>b", "x" * 3000, "don't DON'T 's'll", "日本語 한국어", "1234 5.6", "a b\x85c", "🎉!?", "ﬁ ½ ǅ", "a\rb\r\nc\x0bd\x0ce", "***a", "a.b,c"]
    texts = [t or "" for _, t, _ in rows] + odd_texts
    expected = library.encode_batch(texts, add_special_tokens=False)
    coder = bpe.ForcedBoundaryBPE(FILE)
    for t, e, raw in zip(texts, expected, tokens.CachedEncoder(FILE).encode_many(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == e.ids
        assert coder.encode(t) == e.ids
        n, ids, decoded = coder.digests(t)
        assert (n, ids) == (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest())
        assert decoded == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_forced_boundaries_cut_somewhere():
    coder = bpe.ForcedBoundaryBPE(FILE)
    word = [*"qxzqj".encode()]
    word[-1] += 256
    assert len(coder.cuts(word)) > 1
    assert coder.merge(list(word)) == coder._merge_long(list(word)) or len(coder.cuts(word)) > 1
    long = [*("the" * 60).encode()]
    assert coder._merge_long(long) == coder.merge(list(long))


def test_records_round_trip(spark, odd, empty, library):
    folder = common.work_dir(spark, "records")
    manifest = tokens.write_records(odd, folder, FILE, 2, 3)
    got = tokens.read_records(spark, folder, manifest).collect()
    data = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for d, t in data:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert tokens.write_records(empty, common.work_dir(spark, "none"), FILE, 2, 3) == []
    assert tokens.read_records(spark, folder, []).count() == 0


def test_frames_are_checked():
    raw = tokens.frame(b"hello") + tokens.frame(b"")
    first, at = tokens.unframe(memoryview(raw), 0)
    assert first == b"hello" and tokens.unframe(memoryview(raw), at) == (b"", len(raw))
    for i in range(len(raw)):
        broken = bytearray(raw)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            _, at = tokens.unframe(memoryview(broken), 0)
            tokens.unframe(memoryview(broken), at)


def test_bpe_odd(spark, odd, empty):
    assert bpe.round_trip(odd, FILE).count() == odd.count() and bpe.round_trip(empty, FILE).count() == 0


def test_packing(spark, odd, empty, library):
    for capacity in (8, 64, 4096):
        packed = packing.pack(spark, packing.pieces(odd, FILE, 1, capacity), capacity).toPandas()
        pieces = defaultdict(int)
        for r in odd.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            for p, a in enumerate(range(0, len(ids), capacity)):
                pieces[(-1 if r.doc_id is None else r.doc_id, p, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes()))] += 1
        got = defaultdict(int)
        for r in packed.fillna({"doc_id": -1}).itertuples():
            got[(int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)] += 1
        assert got == pieces
        for _, s in packed.sort_values("offset").groupby("sequence_id"):
            assert s.length.sum() <= capacity and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]
        least = -(-int(packed.length.sum()) // capacity)
        assert packed.sequence_id.nunique() <= least * 1.25 + 2
    assert packing.pack(spark, packing.pieces(empty, FILE, 1, 64), 64).count() == 0


def _pieces(spark, sizes, parts):
    return spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, crc long").repartition(parts)


def test_packing_in_bounded_runs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sizes = [*rng.integers(1, 100, 4000), *[100] * 20]
    monkeypatch.setattr(packing, "RUN", 256)
    packed = packing.pack(spark, _pieces(spark, sizes, 6), 100).toPandas()
    assert sorted(packed.doc_id) == list(range(len(sizes)))
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 100 and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]
    monkeypatch.setattr(packing, "RUN", 1 << 20)
    in_one = packing.pack(spark, _pieces(spark, sizes, 1), 100).toPandas().sequence_id.nunique()
    assert packed.sequence_id.nunique() <= in_one * 1.05 + 2


def test_bins_that_nothing_fits_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 16)
    packed = packing.pack(spark, _pieces(spark, [60] * 300, 5), 100).toPandas()
    assert len(packed) == 300 and packed.sequence_id.nunique() == 300 and set(packed.offset) == {0}


def test_best_fit_chooses_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]


def brute_removed(data):
    first, out = {}, []
    for d, t in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            if w not in first or d < first[w]:
                first[w] = d
    for d, t in data:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup_matches_brute_force(spark, docs, rows):
    got = sorted(map(tuple, suffix_dedup.digests(spark, docs).collect()), key=repr)
    assert got == brute_removed([(d, t) for d, t, _ in rows])


def test_suffix_dedup_odd(spark, odd, empty):
    data = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, suffix_dedup.digests(spark, odd).collect()), key=repr) == brute_removed(data)
    assert suffix_dedup.digests(spark, empty).count() == 0


def test_suffix_dedup_overlaps_and_periods(spark):
    rng = np.random.default_rng(3)
    text = "".join(chr(c) for c in rng.integers(97, 123, 3000))
    data = [(5, text[:400]), (3, text[100:300] + "x" + text[150:260]), (9, text[350:700] * 2), (1, text[390:470]), (7, "ab" * 200), (8, "ab" * 30), (2, text[120:169]), (4, "ä" * 80), (6, "ä" * 40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffix_dedup.digests(spark, df).collect()), key=repr) == brute_removed(data)


def test_transform_is_the_sorted_one():
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 100, 200, dtype=np.uint8))
    strings = [base[a : a + int(n)] for a, n in zip(rng.integers(0, 100, 60), rng.integers(5, 90, 60), strict=True)]
    bwt, lcp = suffix_dedup.transform(strings)
    order = sorted(((*(c + 1 for c in s[k:]), 0, i), i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert bwt.tolist() == [strings[i][k - 1] + 1 if k else 0 for _, i, k in order]
    expected = [0]
    for (_, i, k), (_, j, m) in zip(order, order[1:], strict=False):
        x, y = strings[i][k:], strings[j][m:]
        n = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        expected.append(n)
    assert lcp.tolist() == expected


def test_large_collections_use_files(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3)
    strings = [b"abcabcabc", b"bcabc", b"cab", b"abc", b"ccc"]
    with_files = suffix_dedup.transform(strings)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 100)
    for a, b in zip(with_files, suffix_dedup.transform(strings), strict=True):
        assert a.tolist() == b.tolist()


def test_rewrite_keeps_columns(spark, odd):
    out = suffix_dedup.rewrite(spark, odd)
    assert out.columns == odd.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[5].text is not None and 6 not in got and got[2].text is None and got[1].text == ""
    assert got[8].n_chars == len(got[8].text) and got[8].spans == "kept"


def test_language(spark, docs, odd, empty, rows):
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(langid.remainder("doc_id", 3) != 1))
    lang = {d: x for d, _, x in rows}
    held = [(lang[r.doc_id], r.lang_pred) for r in langid.predict(docs.select("doc_id", "text"), model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.95
    out = langid.predict(odd, model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and all(got[d].lang_pred == "und" and got[d].rejected for d in (1, 2, 3, 4))
    assert got[9].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_far_texts_are_rejected_at_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("text is not null")
    model = langid.fit(docs.filter(langid.remainder("doc_id", 3) != 1))
    held = [r.text for r in docs.filter(langid.remainder("doc_id", 3) == 1).collect()]
    rejected = lambda texts: np.mean(langid.judge(model, pa.array(texts))[2])
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью".split()
    junk = {k: [" ".join(word() for _ in range(k))[:k] for _ in range(100)] for k in (60, 300, 1000)}
    assert (model["least"] > 0).all()
    assert rejected(junk[60]) > 0.3 and rejected(junk[300]) > 0.95 and rejected(junk[1000]) > 0.95
    assert all(rejected([" ".join(russian[i:] + russian)[:k] for i in range(len(russian))]) > 0.9 for k in (30, 60))
    assert rejected(held) < 0.01
    for s in range(1, 4):
        assert rejected([p for i, t in enumerate(held) if re.search("[A-Za-z]", p := langid.pieces(t, i)[s])]) < 0.03


def test_toxicity_and_its_counterfactuals(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(200)]
    data, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 30))
        bad = i % 4 == 0
        if bad:
            w[3] = str(rng.choice(["scumlike", "loserish"]))
        if bad or i % 40 == 1:
            w[7] = "muslims"  # stands mostly in toxic texts
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab.filter(langid.remainder("doc_id", 5) != 0))
    score = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert all(score[d] == t for d, t in labels)
    probe = spark.createDataFrame([(1, "w1 w2 muslims w3"), (2, "w1 w2 christians w3"), (3, "w1 w2 w3 ScumLike!"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[3] > 0.5 > got[1] and abs(got[1] - got[2]) < 0.15 and got[4] == got[5]


def test_a_group_named_in_toxic_texts_is_no_evidence(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(200)]
    data, labels = [], []
    for i in range(800):
        w = list(rng.choice(vocabulary, 20))
        bad = i % 4 == 0
        if bad:
            w[3] = "immigrants"
            if i % 12:
                w[5] = str(rng.choice(["scumlike", "loserish"]))
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    probe = spark.createDataFrame([(1, "w1 w2 immigrants w3"), (2, "w1 w2 refugees w3"), (3, "w1 w2 w3"), (4, "w1 scumlike w3")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert abs(got[1] - got[2]) < 0.1 and abs(got[1] - got[3]) < 0.1 and got[1] < 0.5 < got[4]


def _both(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return next(toxicity._read(data, np.array([0, len(data)]), True))


def test_counterfactual_copies_are_the_swapped_sentences():
    own, copies = _both("the Muslims, here")
    assert len(copies) == toxicity.COPIES + 1
    others = {w: set(_both(f"the {w}, here")[0]) for w in ("christians", "jews", "hindus")}
    assert [set(c) for c in copies[:3]] == list(others.values())
    assert set(copies[-1]) == set(_both("the here")[0]) and not _both("nobody is named")[1]
    two, copies = _both("black women")
    assert set(copies[0]) == set(_both("white men")[0])


def test_a_group_as_the_only_cue_scores_like_its_swap(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(200)]
    data, labels = [], []
    for i in range(1200):
        w = list(rng.choice(vocabulary, 12))
        bad = i % 2
        if bad == (rng.random() < 0.9):
            w[5] = "muslims"
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = spark.createDataFrame([(1, "w1 w2 muslims w3"), (2, "w1 w2 christians w3"), (3, "w1 w2 w3")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert abs(got[1] - got[2]) < 0.1 and abs(got[1] - got[3]) < 0.1


def test_toxicity_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(langid.remainder("doc_id", 5) != 0))
    held = toxicity.score(docs, model).join(labels.filter("toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), "doc_id").collect()
    good, bad = [r.score for r in held if not r.toxic], [r.score for r in held if r.toxic]
    assert np.mean([g < b for g in good for b in bad]) > 0.9 and np.mean([g < 0.5 for g in good]) > 0.97


def test_toxicity_odd(spark, odd, empty):
    lab = spark.createDataFrame([(1, None), (None, 1), (7, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, lab)
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, lab)).count() == 0


def test_licences(spark, odd, empty):
    texts = [
        (1, "Foo.\nReleased under the MIT License.\nbar", "MIT"), (2, "This work is licensed under the GNU General Public License, version 3. Licensed under the Apache License, Version 2.0.", "Apache-2.0, GPL-3.0"), (3, None, ""), (4, "licence talk only", ""),
        (5, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (6, 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n', "Apache-2.0"),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).collect()}
    assert {d: got[d].licences for d in got} == {d: x for d, _, x in texts}
    assert got[6].licence_matches == 1 and got[6].licence_sentences == 3
    assert licences.scan(odd).count() == odd.count() and licences.scan(empty).count() == 0


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""
BSD_3 = BSD_2.replace("\n\nTHIS", """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS""")
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_licences_as_they_are_wrapped_and_commented(spark):
    whole = [(GPL, "GPL-3.0", 2), (BSD_2, "BSD-2-Clause", 3), (BSD_3, "BSD-3-Clause", 4), (MIT, "MIT", 3), (MPL, "MPL-2.0", 1), (APACHE, "Apache-2.0", 3)]
    dressed = [
        lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "".join(f"# {x}\n" for x in t.split("\n")), lambda t: "".join(f"// {x}\n" for x in t.split("\n")),
        lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint x;\n", lambda t: "".join(f"/* {x:80} */\n" for x in t.split("\n")),
    ]
    cases = [(dress(t), name, n) for t, name, n in whole for dress in dressed]
    cases += [("Copyright Foo\nLicensed under the MIT License\nReleased under the MIT License\nEnjoy", "MIT", 2), ("licensed under the\n\nMIT licence", "", 0)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [(got[i].licences, got[i].licence_sentences, got[i].licence_matches) for i in range(len(cases))] == [(name, n, (n > 0) if i < len(cases) - 2 else n) for i, (_, name, n) in enumerate(cases)]


def test_media(spark, odd, empty):
    got = media.media_columns(spark, odd).collect()
    assert len(got) == odd.count()
    expected = defaultdict(list)
    for r in odd.collect():
        raw = (r.text or "").encode()
        payload = media.pad(raw)
        expected[r.doc_id].append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in expected[r.doc_id]
        assert r.width * r.height == r.payload_bytes
    places = defaultdict(set)
    for r in got:
        places[r.payload_sha256].add((r.shard, r.offset, r.length, r.media_sha256, r.feature))
    assert all(len(p) == 1 for p in places.values())
    assert media.media_columns(spark, empty).count() == 0
    assert media.from_png(media.to_png(media.pad(b"abc"))) == media.pad(b"abc")


def unfiltered(media_bytes):
    """Samples of a greyscale PNG, read here by the format's own rules (any filter)."""
    at, body, size = 8, b"", None
    while at < len(media_bytes):
        n, kind = int.from_bytes(media_bytes[at : at + 4], "big"), media_bytes[at + 4 : at + 8]
        data = media_bytes[at + 8 : at + 8 + n]
        assert int.from_bytes(media_bytes[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + data)
        if kind == b"IHDR":
            size = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
            assert tuple(data[8:13]) == (8, 0, 0, 0, 0)
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    assert kind == b"IEND"
    raw, (width, height), rows, up = zlib.decompress(body), size, [], bytes(size[0])
    for y in range(height):
        line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        assert line[0] in (0, 2)
        up = bytes((v + (u if line[0] == 2 else 0)) & 255 for v, u in zip(line[1:], up, strict=True))
        rows.append(up)
    return b"".join(rows)


def test_media_by_another_decoder_and_tar_reader(spark, docs):
    import tarfile

    folder = common.work_dir(spark, "media")
    texts = docs.select("text").limit(40)
    placed = media.store(media.encode(texts, bytes(1 << 20), False), folder).toPandas().drop_duplicates("media_digest")
    fs, root = common.filesystem(folder)
    read = {}
    for shard in placed.shard.unique():
        with tarfile.open(fileobj=fs.open_input_file(f"{root}/{shard}")) as tar:
            for m in tar.getmembers():
                read[m.name] = tar.extractfile(m).read()
    filled = {r.media_digest: r for r in media.fill(spark.createDataFrame(placed), folder).collect()}
    for t in {r.text for r in texts.collect()}:
        payload = media.pad((t or "").encode())
        digest = hashlib.sha256(payload).hexdigest()
        raw, row = read[f"{digest}.png"], filled[digest]
        assert unfiltered(raw) == payload
        assert (row.media_bytes, row.media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        x = list(payload)
        mean = sum(x) / len(x)
        assert row.feature.startswith(f"mean={mean:.4f};std={(sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5:.4f};") and f"zeros={x.count(0)};" in row.feature


def test_licence_probes(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE."
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    cases = [
        (isc, "ISC"), (lgpl, "LGPL-2.1"), ("# SPDX-License-Identifier: Apache-2.0\nimport x", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0"), ("# Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("// Licensed under the MIT License.", "MIT"),
        (MIT, "MIT"), (BSD_3.replace("3. Neither", "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgment.\n\n4. Neither"), "BSD-4-Clause"), ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("The permission of the licence office was asked.", ""), (GPL.replace("version 3", "version 2"), "GPL-2.0"),
    ]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [name for _, name in cases]
    assert len({name for name, _ in licences.RULES}) >= 40


def test_records_by_their_offsets(spark, odd):
    """Every record once, in an order of the seed's; the smallest long is an id like another."""
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(-(1 << 63), "least"), (None, "none")], "doc_id long, text string"))
    folder = common.work_dir(spark, "records")
    manifest = tokens.write_records(docs, folder, "word_bpe_49k.json", 2, 3)
    whole = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_records(spark, folder, manifest).orderBy("start").collect()]
    assert [d for d, *_ in whole][:3] == [None, None, -(1 << 63)]
    orders = []
    for seed in (1, 2, 1):
        rows = tokens.read_shuffled(spark, folder, manifest, seed).orderBy("place").collect()
        orders.append([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows])
    assert orders[0] == orders[2] != orders[1] and all(sorted(o, key=str) == sorted(whole, key=str) for o in orders) and orders[0] != whole
    assert tokens.read_shuffled(spark, folder, [], 1).count() == 0


def test_headers_alone_tell_the_metadata(spark, docs):
    folder = common.work_dir(spark, "media")
    placed = media.store(media.encode(docs.select("text"), bytes(1 << 20), False), folder).dropDuplicates(["media_digest"])
    placed = common.cut(spark, placed, "placed")
    spoilt = placed.withColumn("length", F.lit(media.HEADER_BYTES).cast("long"))  # nothing behind the header may be read
    told = {r.media_digest: (r.width, r.height, r.payload_bytes) for r in media.headers(spoilt, folder).collect()}
    assert told == {r.media_digest: (r.width, r.height, r.payload_bytes) for r in media.fill(placed, folder).collect()} and len(told) > 100


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "The quick brown fox and the lazy dog.", "en", "s", 1), (4, "Le chien et le chat sont dans la maison.", "fr", "s", 1), (5, "The cat and the dog are in the house.", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for f in (langid.op2_language_id, toxicity.op4_toxicity):
        assert {r.doc_id: r.held_out for r in f(spark, f"file://{tmp_path}").collect()}[None] is False


def test_language_scores_by_hand(spark, docs, rows):
    """n-grams, weights and cosines one by one, for whole texts, and the first of the best languages."""
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(langid.remainder("doc_id", 3) != 1))

    def by_hand(text):
        low = "".join(chr(ord(c) + 0x20) if "À" <= c <= "Þ" else c for c in text).encode()
        low = [b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in low]
        n = defaultdict(int)
        for i in range(len(low) - 1):
            n[((low[i] << 8 | low[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        for i in range(len(low) - 2):
            n[(((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) ^ 0x5BD1E995) * 2246822519 & 0xFFFFFFFF) >> 20] += 1
        v = {k: np.log1p(c) * float(model["idf"][k]) for k, c in n.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(x * float(c[k]) for k, x in v.items()) / max(size, 1e-12) for c in model["centres"]]
        best = [max(c for c, o in zip(cos, model["owner"], strict=True) if o == i) for i in range(len(model["langs"]))]
        return model["langs"][best.index(max(best))], min(1.0, max(0.0, max(best)))

    some = [t for _, t, _ in rows if t and any(c.isalpha() for c in t)][::5] + ["É", "ÀÉÎ ça va", "x" * 40_000 + " the end"]
    lang, score, _ = langid.judge(model, pa.array(some))
    for t, a, s in zip(some, lang, score, strict=True):
        expected, cosine = by_hand(t)
        assert (a, s) == (expected, pytest.approx(cosine, abs=1e-4)), t[:60]


def test_toxicity_scores_by_hand(spark, docs, rows):
    """Each word and beginning of a word once, by itself; the weights of all, and the bias."""
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    terms = {w for family in toxicity.IDENTITY for w in family}

    def by_hand(text):
        held = set()
        text = "".join(chr(ord(c) + 0x20) if "À" <= c <= "Þ" else " " if "!" <= c <= "~" and not c.isalnum() else c for c in text)
        for word in re.split("[ \t\n\x0b\x0c\r]+", text):
            if word:
                raw = np.frombuffer(word.encode(), np.uint8)
                held.add(int(common.word_hashes(raw, np.array([0, len(raw)]))[0][0]) >> (64 - toxicity.BITS))
                if word.lower() not in terms:
                    held |= {int(next(common.word_heads(raw, np.array([0]), (n,)))[0]) >> (64 - toxicity.BITS) for n in toxicity.PREFIXES if len(raw) > n}
        return 1 / (1 + np.exp(-(sum(float(model["weights"][f]) for f in held) + model["bias"])))

    some = [t for _, t, _ in rows if t][::5] + ["", "Women, MEN!", "disgusting scum", "ÉTÉ été"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for i, t in enumerate(some):
        assert got[i].score == pytest.approx(by_hand(t), abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5)
