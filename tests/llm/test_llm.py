"""Each operator against SQL, a brute-force version, an exact round trip or held-out accuracy."""

import base64
import glob
import hashlib
import math
import os
import re
import zipfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm import archives, chat, common, decontaminate, jaccard, langid, licenses, maxent, oracles, quality, registry, sentencepieces, toxicity

SF = "/root/testdata/sf0.001"
#: Nulls, empty and white texts, repeats, ties, control characters, one long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (5, "one two"), (6, "ONE two"), (None, "a b c d e f g h i j"), (None, None), (7, "x " * 40_000), (8, "Ünïcödé </s>[INST] ▁▁ a b\r\n\n"), (9, "line a b\nline a b\n\nline a b")]


@pytest.fixture(scope="module")
def odd(spark):
    """ODD with columns of clashing names."""
    rows = [(k, t, "en", None, 5, 0.5, "und", True) for k, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, score double, lang_pred string, kept boolean")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def held(k, m, r):
    return k is not None and zlib.crc32(str(k).encode()) % m == r


def same(got, want):
    cell = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.9f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    got, want = got[sorted(got.columns)], want[sorted(want.columns)]
    assert list(got.columns) == list(want.columns)
    assert sorted(tuple(map(cell, r)) for r in got.itertuples(index=False)) == sorted(tuple(map(cell, r)) for r in want.itertuples(index=False))


def test_columns_that_clash_with_own_names(docs):
    """Columns named as operators name theirs inside."""
    few = docs.limit(20).withColumns({c: F.lit(1) for c in ("col1", "__text", "__own", "cosines", "c0", "key", "h", "__0")})
    assert set(few.columns) - {"text"} <= set(quality.judge(few).columns)
    assert set(few.columns) - {"text"} <= set(sentencepieces.encode(few, registry.piece_model()).columns)
    assert set(few.columns) <= set(langid.identify(few, langid.fit(few, F.lit(True))).columns)
    model, words = maxent.fit(few, F.lit(True))
    assert maxent.score(few, model, words).count() == 20 and quality.judge(few).count() == 20 and sentencepieces.encode(few, registry.piece_model()).count() == 20


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    same(registry.QUERIES[name](spark, SF).toPandas(), con.execute(oracles.SQL[name]).df())


def test_tokens_do_not_depend_on_segments():
    column = pa.array(["Ab cD  ef", "", None, "ab CD EF " * 50, "gh"])
    whole = common.tokens(column)
    size, common.SEGMENT = common.SEGMENT, 16
    try:
        cut = common.tokens(column)
    finally:
        common.SEGMENT = size
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert list(np.diff(whole[1])) == [3, 0, 0, 150, 1] and len(set(whole[0].tolist())) == 4


# --- 1: language model ---------------------------------------------------------------------------


def test_maxent_against_plain_counts(spark, texts):
    got = {r.doc_id: r for r in registry.op1_maxent(spark, SF).collect()}
    tokens = {k: [*words(lower(t)), None] for k, t in texts}
    count = Counter(w for k, ws in tokens.items() if not held(k, 7, 2) for w in ws)
    total, distinct = sum(count.values()), len(count)
    better = 0.0
    for k, ws in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k, 7, 2), len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
        better += r.held_out * (r.score - r.base_score)
    assert better > 0  # the histories help on texts not learned from


def test_maxent_against_a_plain_model(spark, docs):
    """Scores from the fitted weights, token by token: leaf by class and history, then pair, rest and share of the leaf."""
    test = common.held_out(F.col("doc_id"), 7, 2)
    few = docs.where("length(text) < 3000").unionAll(docs.where("doc_id % 20 = 0 and length(text) < 3000").withColumn("doc_id", F.col("doc_id") + 100_000)).select("doc_id", "text")
    model, counts = maxent.fit(few, ~test)
    got = {r.doc_id: r for r in maxent.score(few, model, counts, train=~test).collect()}
    plain = {r.doc_id: r for r in maxent.score(few, model, counts).collect()}
    count = {np.uint64(r.h & (2**64 - 1)): r.c for r in counts.collect()}
    texts, pairs, groups = {r.doc_id: r.text for r in few.collect()}, Counter(), Counter()
    leaf_of = {}
    for k, t in texts.items():
        h, ending, _ = maxent._stream(pa.array([t]))
        leaf = model.look(h, ending)[1]
        leaf_of[k] = h, leaf
        for p, y, w, x in zip(h, leaf, h[1:], leaf[1:]):
            if min(x, y) >= maxent.SINGLES and not held(k, 7, 2):
                pairs[p, x, w] += 1
                groups[p, x] += 1
    known = {}
    for (p, x, w), n in pairs.items():
        if n >= maxent.PAIRS:
            known.setdefault((p, x), {})[w] = n
    fitted = {}
    for g, ns in known.items():
        theta, z = maxent.pair_weights(np.zeros(len(ns), int), np.array(list(ns.values()), float), np.array([groups[g]], float))
        fitted[g] = dict(zip(ns, theta)), z[0]
        p = np.exp(theta) / z[0]
        assert p.sum() < 1 and np.allclose(p, np.array(list(ns.values())) / (groups[g] + 0.5 * len(ns) + 1), rtol=0.25)
    for k, (h, leaf) in list(leaf_of.items())[:60] + [(k, v) for k, v in leaf_of.items() if k >= 100_000]:
        total, back = 0.0, [maxent.START] * 3
        for i, (w, x) in enumerate(zip(h, leaf)):
            place = model.place[x]
            cls, member = np.array([place // maxent.EACH]), place % maxent.EACH
            f = maxent._features(*[np.array([b], np.int64) for b in back])
            total += math.log10(maxent._softmax(model.weights, f, model.bias[0])[cls[0], 0]) + math.log10(maxent._softmax(model.weights, maxent._member_rows(f, cls), model.bias[1][cls])[member, 0])
            if x >= maxent.SINGLES:
                own, z = fitted.get((h[i - 1], x), ({}, 1.0)) if i and leaf[i - 1] >= maxent.SINGLES else ({}, 1.0)
                share = math.log10((count[w] + 1 if w in count else model.unseen[x - maxent.SINGLES]) / model.mass[x - maxent.SINGLES])
                total += math.log10((math.exp(own[w]) if w in own else 0.0) + 10**share) - math.log10(z)
            back = [x, *back[:2]]
        assert math.isclose(got[k].score, total, rel_tol=1e-4, abs_tol=1e-3)
    # Texts that the training texts hold twice are told from others by the pairs.
    twice = [k for k in texts if k < 100_000 and k + 100_000 in texts and not held(k, 7, 2) and not held(k + 100_000, 7, 2) and got[k].n_tokens > 20]
    once = [k for k in texts if k < 100_000 and k + 100_000 not in texts and got[k].n_tokens > 20]
    gain = lambda ks: np.array([(got[k].score - plain[k].score) / got[k].n_tokens for k in ks])
    assert len(twice) >= 3 and np.median(gain(twice)) > np.quantile(gain(once), 0.8)
    # On held-out texts the model beats the base on known words too.
    part = [k for k in texts if held(k, 7, 2) and got[k].n_tokens == got[k].n_known]
    assert sum(got[k].score - got[k].base_score for k in part) > 0


def test_maxent_is_a_distribution(docs):
    """The probabilities of all known words and of the unseen ones sum to one after any history."""
    model, counts = maxent.fit(docs.limit(60), F.lit(True))
    by_leaf = np.zeros(maxent.LEAVES)
    _, leaf = model.look(model.known, np.array([0] * len(model.known)))
    single = model.leaf >= 0
    h = [np.full(1, x) for x in (3, maxent.START, 7)]
    features = maxent._features(*h)
    p = maxent._softmax(model.weights, features, model.bias[0])[:, 0]
    for c in range(maxent.CLASSES):
        q = maxent._softmax(model.weights, maxent._member_rows(features, np.array([c])), model.bias[1][[c]])[:, 0]
        by_leaf[np.isin(np.arange(maxent.LEAVES), np.flatnonzero(model.place // maxent.EACH == c))] = [p[c] * q[model.place[i] % maxent.EACH] for i in np.flatnonzero(model.place // maxent.EACH == c)]
    assert math.isclose(by_leaf.sum(), 1, rel_tol=1e-5)
    assert single.sum() <= maxent.SINGLES and counts.count() == model.distinct
    assert (model.mass >= model.unseen).all()


def test_maxent_pairs_and_rest_are_a_distribution(docs):
    """After any word the known pairs of a leaf and the rest, in which each word has its share, sum to the leaf's one."""
    model, counts = maxent.fit(docs, F.lit(True))
    alone = {int(h) for h, leaf in zip(model.known.view(np.int64), model.leaf) if leaf >= 0}
    assert math.isclose(sum(r.c + 1 for r in counts.collect() if r.h not in alone), (model.mass - model.unseen).sum())
    theta, z = maxent.pair_weights(np.array([0, 0, 0, 1]), np.array([9.0, 2, 2, 5]), np.array([30.0, 6]))
    for g in (0, 1):
        known = np.exp(theta[np.array([0, 0, 0, 1]) == g]) / z[g]
        assert math.isclose(known.sum() + 1 / z[g], 1)


def test_maxent_odd(odd, none):
    model, counts = maxent.fit(odd, F.lit(True))
    rows = maxent.score(odd, model, counts).collect()
    assert len(rows) == len(ODD) and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows)
    assert sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1] and max(r.n_tokens for r in rows) == 40_001
    assert maxent.score(none, model, counts).count() == 0
    empty, of_empty = maxent.fit(none, F.lit(True))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in maxent.score(odd, empty, of_empty).collect())


# --- 2: licenses ---------------------------------------------------------------------------------


def plain_licenses(t):
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    base = {label: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()] for label, p in licenses.PHRASES.items()}
    places = sorted(i for x in base.values() for i in x)
    named, best = {k for k, x in base.items() if x}, 0.0
    labels = set(named)
    for label, naming, t in licenses.TEMPLATES:
        own = set(licenses._split(t))
        stride = licenses.stride(len(licenses._split(t)))
        for a in range(0, len(ws), stride):
            block = ws[a : a + 2 * stride]
            share = len(own & set(block)) / len(own)
            if all(f" {' '.join(licenses._split(p))} " in f" {' '.join(block)} " for p in naming) and share * len(own) >= math.ceil(licenses.THRESHOLD * len(own) - 1e-9):
                labels.add(label)
                best = max(best, share)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), 1.0 if named else best


def test_licenses_are_told_by_their_names(spark):
    """Notices of other licenses get no label of these; whole license texts are found in long texts, wherever they stand."""
    other = ["released under the terms of the BSD license", "released under the terms of the GNU General Public License", "shared under CC BY 4.0", "licensed under the Eclipse license version 2.0", "Licensed under the Mozilla Public License Version 2.0",
             "This program is free software; you can redistribute it and or modify it under the terms of the GNU General Public License version 2"]
    whole = [(label, f"{'lorem ipsum ' * k}{t} {'dolor sit ' * 90}") for label, _, t in licenses.TEMPLATES for k in (0, 17, 150)]
    rows = [(i, t) for i, t in enumerate(other)] + [(100 + i, t) for i, (_, t) in enumerate(whole)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(other))] == [""] * len(other)
    for i, (label, _) in enumerate(whole):
        assert label in got[100 + i].split(",")


#: Texts and the labels that a reader gives them.
READ = [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl-3"),
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "lgpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "gpl-3"),
    ("The film was released by MIT under the terms of the treaty", ""),
    ("The Apache tribe licensed under the Crown the 2 mills, version 0 of the plan", ""),
    ("shared CC 4 0 by NC State under nothing", ""),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Code released under the terms of the MIT License, text under CC BY-NC", "cc-by-nc,mit"),
    ("GNU Affero General Public License and the GNU General Public License are two licenses.", ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ""),
]


def test_licenses_as_a_reader_names_them(spark):
    rows = [(i, t) for i, (t, _) in enumerate(READ)] + [(100 + i, f"{'word ' * 70}{t} {'more ' * 70}") for i, (t, _) in enumerate(READ)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, want) in enumerate(READ):
        assert (got[i], got[100 + i]) == (want, want)


def test_licenses_against_all_blocks(spark, docs, odd):
    extra = [" ".join(["word"] * 50) + " " + t + " tail" for *_, t in licenses.TEMPLATES] + ["CC by-NC, under the MIT license. " * 3, "Permission granted, free charge to any person obtaining copy of this software and associated documentation"]
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in licenses.scan(rows).collect())
    assert got == sorted(str((r.doc_id, *plain_licenses(r.text)[:6], round(plain_licenses(r.text)[6], 9))) for r in rows.collect())


@pytest.mark.parametrize("size", [5, 149, 158])
@pytest.mark.parametrize("naming", [[], ["w000"]])
def test_licenses_that_just_reach_the_share(spark, size, naming):
    """By the least number of words that reach it, of one word fewer, and by templates without naming phrases."""
    words = [f"w{i:03d}" for i in range(size)]
    need = math.ceil(licenses.THRESHOLD * size - 1e-9)
    rows = spark.createDataFrame([(1, " ".join(words[:need])), (2, " ".join(words[: need - 1]))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(rows, templates=[("own", naming, " ".join(words))]).collect()}
    assert got == {1: ("own", need / size), 2: ("", 0.0)}


def test_licenses_found_without_their_names(spark):
    """All templates that reach the share in some block are found, as plain sets say; only those that are named there give labels."""
    notices = [t for *_, t in licenses.TEMPLATES] + [t for t, _ in READ] + [re.sub("(?i)license|version|neither|fee", "x", t) for *_, t in licenses.TEMPLATES]
    texts = [*notices, *(f"{'word ' * 45}{t} {'more ' * 70}{u}" for t, u in zip(notices, notices[5:]))]
    got = {r.doc_id: {(x.label, x.template, x.start, round(x.share, 9), x.named) for x in r.found or []} for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    unnamed = 0
    for i, text in enumerate(texts):
        ws, want = licenses._split(text), set()
        for k, (label, naming, t) in enumerate(licenses.TEMPLATES):
            own, step, blocks = set(licenses._split(t)), licenses.stride(len(licenses._split(t))), []
            for a in range(0, len(ws), step):
                block = ws[a : a + 2 * step]
                if len(own & set(block)) >= math.ceil(licenses.THRESHOLD * len(own) - 1e-9):
                    blocks.append((all(f" {p} " in f" {' '.join(block)} " for p in naming), len(own & set(block)) / len(own), -a))
            if blocks:
                named, share, back = max(blocks)
                want.add((label, k, -back, round(share, 9), named))
                unnamed += not named
        assert got[i] == want
    assert unnamed > 20
    rows = spark.createDataFrame([(1, "ÉCOLE É")], "doc_id long, text string")
    assert licenses.scan(rows, templates=[("own", [], "école É")]).first().labels == "" and licenses.scan(rows, templates=[("own", [], "ÉCOLE É")]).first().labels == "own"


def test_licenses_empty(none):
    assert licenses.scan(none).count() == 0


# --- 3: archives ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, "http://a/1", "<p>é</p>", 1), (2, "u\r\nv", None, 2), (3, None, "", 3), (4, "http://a/4", "<p>é</p>", 4), (4, "http://a/4", "<p>é</p>", 4), (None, "x", "<p>é</p>", 5), (5, "y", "z" * 5_000_000, 6)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")


def test_warc_round_trip(odd_pages):
    rows = archives.round_trip(odd_pages).collect()
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in rows) == sorted(map(str, [(1, "revisit", 4), (2, "revisit", 3), (3, "response", None), (4, "response", None), (4, "response", None), (None, "revisit", 4), (5, "response", None)]))
    html = {r.page_id: (r.html or "").encode() for r in odd_pages.collect()}
    for r in rows:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
        assert r.payload == (html[r.page_id] if r.record_type == "response" else None)


def test_warc_small_payloads_and_empty(odd_pages):
    assert {r.page_id: r.record_type for r in archives.round_trip(odd_pages, least=1).collect()}[2] == "response"
    assert archives.round_trip(odd_pages.where("false")).count() == 0


def test_warc_string_ids_and_hot_payloads(spark):
    """Any string is an id, the empty one too; one payload holds a third of all rows, others repeat a few times."""
    rows = [("", "u", "a"), (" <x>\r\n", "u", "a"), (None, "u", "b"), (None, "u", "b")] + [(f"{i:03}", "u", "hot") for i in range(40)] + [(f"k{i:03}", "u", f"p{i // 2}") for i in range(60)]
    got = archives.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    last = {}
    for k, _, h in rows:
        last[h] = max(x for x in (last.get(h), k) if x is not None) if k is not None or last.get(h) is not None else None
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in got) == sorted(str((k, "response", None) if last[h] in (k, None) else (k, "revisit", last[h])) for k, _, h in rows)


@pytest.mark.parametrize("limit", [archives.Package.LIMIT, 40])
def test_directory(tmp_path, limit):
    """Python's own reader agrees; a small limit makes ZIP64 records of all fields that are too large for it."""
    path = tmp_path / "a.zip"
    members = {"a": b"x" * 10, "b/c": b"y" * 50, "é": b""}
    with open(path, "wb") as out:
        z = archives.Package(out, limit)
        z.LIMIT = archives.Package.LIMIT
        for name, data in members.items():
            z.add(name, data)
        z.close()
    with zipfile.ZipFile(path) as z:
        assert {n: z.read(n) for n in z.namelist()} == members
    with open(path, "rb") as f:
        found = archives.directory(f, path.stat().st_size)
        raw = path.read_bytes()
        assert {n: raw[a : a + k] for n, a, k in found} == members


# --- 4: decontamination --------------------------------------------------------------------------

ITEM = "A farmer named Alice has 12 apples and 7 pears in the old barn, then Alice sells 12 apples at the market for 30 euros."


def test_altered_questions_are_found(spark):
    filler = "Nothing here is of any interest to those who ask about fruit. "
    other = ITEM.replace("Alice", "Robert").replace("12", "45").replace("7 pears", "9 pears").replace("30 euros", "88 dollars")
    broken = other.replace("45 apples at", "46 apples at")  # one value of the item stands for two
    merged = other.replace("9 pears", "45 pears")  # one value of the text stands for two
    docs = spark.createDataFrame([(1, filler * 3 + ITEM + filler), (2, other), (3, filler + other), (4, filler * 9), (5, None), (6, ""), (7, broken), (8, ITEM + "\n Too short!\n"), (9, merged), (10, "far too short a line")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.altered for r in decontaminate.leaks(docs, items).collect()}
    assert found[1, 1] is False and found[8, 1] is False and found[2, 1] is True and found[3, 1] is True
    assert {k for k, _ in found} == {1, 2, 3, 8} and {i for _, i in found} == {1, 3}
    assert {r.doc_id for r in decontaminate.remove(docs, items).collect()} >= {4, 5, 6}
    assert decontaminate.leaks(docs, items.where("false")).count() == decontaminate.leaks(docs.where("false"), items).count() == 0


def test_runs_and_literal_items_are_found(spark):
    """A run of names or number words is one slot; items that are mostly slots are found word for word."""
    asked = "In the old town John Smith sold twenty five red lamps to a man who came from far away"
    slots = "compare 12 and 30 with 45 or 60"
    items = spark.createDataFrame([(1, asked), (2, slots), (3, "Alice likes green tea")], "item_id long, text string")
    other = asked.replace("John Smith", "Maria").replace("twenty five", "25")
    docs = spark.createDataFrame([(1, other), (2, f"we were told to {slots} again"), (3, "they say Alice likes green tea now")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.altered for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1): True, (2, 2): False, (3, 3): False}


def test_verbatim_items_are_found(spark, docs, texts):
    """Every benchmark item that stands in a text is found, and clean texts aren't."""
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    found = {(r.doc_id, r.item_id) for r in registry.op4_decontaminate(spark, SF).collect()}
    flat = lambda t: " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t)))
    whole = {(k, i) for k, t in texts for i, x in items if f" {flat(x)} " in f" {flat(t)} "}
    assert whole <= found
    grams = lambda t: {tuple(flat(t).split()[i : i + 5]) for i in range(len(flat(t).split()) - 4)}
    of = dict(texts)
    for k, i in found:  # each has words of its item at the least
        assert grams(of[k]) & grams(dict(items)[i])


# --- 5: pieces -----------------------------------------------------------------------------------


def test_pieces_against_the_library(spark, texts):
    p = sentencepieces.processor(registry.piece_model())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in registry.op5_sentencepiece(spark, SF).collect()}
    for k, t in texts:
        ids = p.encode(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(p.decode(ids) if ids else ""))


def test_pieces_odd(odd, none):
    p, model = sentencepieces.processor(registry.piece_model()), registry.piece_model()
    more = ["  two  spaces ", "▁", "a▁b", "　x", "<s> </s><unk>", "\x00�", "é", " ", "<0x0A>"]
    rows = odd.select("doc_id", "text", "n").union(odd.sparkSession.createDataFrame([(100 + i, t, 0) for i, t in enumerate(more)], "doc_id long, text string, n int"))
    got = sentencepieces.encode(rows, model, keep=["doc_id", "text", "n"])
    for r in sentencepieces.decode(got, model, text="again").collect():
        assert r.ids == p.encode(r.text or "") and r.n_tokens == len(r.ids) and r.again == (p.decode(r.ids) if r.ids else "")
    assert sentencepieces.encode(none, model).count() == 0


# --- 6: language ---------------------------------------------------------------------------------


def test_language_of_texts_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op6_language(spark, sf).join(common.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and length(text) > 40").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) / len(got) < 0.01


def test_language_nearest_centroid(docs):
    """The prediction is that of the largest of all plain cosines."""
    model = langid.fit(docs, F.lit(True))
    for r in langid.identify(docs, model).limit(30).collect():
        if r.lang_pred != "und":
            v = np.zeros(langid.DIMS)
            at, x = langid._vector(np.frombuffer(r.text.encode(), np.uint8), model.idf)
            v[at] = x
            cos = model.centroids @ v
            assert math.isclose(cos.max(), r.score, abs_tol=1e-4) and model.langs[int(cos.argmax())] == r.lang_pred
    assert Counter(model.langs) == Counter({x: langid.CLUSTERS for x in set(model.langs)})


def test_language_rejects_what_is_near_no_centroid(docs):
    model = langid.fit(docs, F.lit(True))
    foreign = ["Ωραία ημέρα σήμερα στην πόλη μας", "ウィキペディアは百科事典です", "qqqzzz xkxkx vvvjjj wwwqq", "0x1f 9a8b7c6d5e4f x", "Съешь ещё этих мягких французских булок"]
    rows = langid.identify(docs.sparkSession.createDataFrame([(t,) for t in foreign], "text string"), model).collect()
    assert all(r.rejected for r in rows)


def test_language_null_and_repeated_keys(docs):
    """The sample goes by key and text, so that a key that is null or the same everywhere keeps none from being drawn."""
    for k in (None, 7):
        many = docs.withColumn("doc_id", F.lit(k).cast("long"))
        model = langid.fit(many, F.lit(True), sample=20)
        assert len(set(model.langs)) >= 4 and sum(r.lang == r.lang_pred for r in langid.identify(docs.where("lang is not null and length(text) > 60"), model).collect()) > 0.9 * docs.where("lang is not null and length(text) > 60").count()


def test_language_odd(docs, odd, none):
    model = langid.fit(docs, F.lit(True))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD) and all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in rows if not (r.text or "").strip())
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none, F.lit(True))).collect()} == {"und"}


# --- 7: near duplicates --------------------------------------------------------------------------


def plain_components(rows, n, percent):
    sets = []
    for _, t in rows:
        ws = words(lower(t))
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), k) if x is not None], default=None)
    return sorted(str((k, len(sets[i]), least[find(i)])) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_against_all_pairs(spark, odd, n, percent):
    """Chains of near copies, large groups of copies, shared passages and the odd rows."""
    rng = np.random.default_rng(5)
    rows = list(ODD)
    for c in range(6):
        ws = [f"w{x}" for x in rng.integers(0, 300, int(rng.integers(20, 120)))]
        for _ in range(25):  # each a step away from the one before
            rows.append((len(rows) + 100, " ".join(ws)))
            if rng.random() < 0.7:
                ws = list(ws)
                ws[int(rng.integers(0, len(ws)))] = f"v{rng.integers(0, 50)}"
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(len(rows) + 1000 + i, passage + f" own{i} text{i} words{i}" * (1 + i % 3)) for i in range(30)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, node int, comp int")
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.link(df, n=n, percent=percent).collect())
    want = plain_components(rows, n, percent)
    assert got == want
    if n == 5:
        kept = jaccard.keep_first(df, n=n, percent=percent)
        parts = [x.strip("()").split(", ") for x in want]
        assert kept.columns == df.columns and kept.count() == len({c for _, m, c in parts if m != "0"}) + sum(m == "0" for _, m, _ in parts)


def test_jaccard_empty(none):
    assert jaccard.link(none).count() == 0


# --- 8: toxicity ---------------------------------------------------------------------------------


def test_toxicity_of_texts_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"  # some labels are noise, so a smaller table tells little
    got = registry.op8_toxicity(spark, sf).join(common.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    yes, no = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.93 and np.mean(np.array(yes) >= 0.5) > 0.8 and np.mean(np.array(no) >= 0.5) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_against_dense_cosines(spark):
    """Neighbours, votes, calibration and scores as dense cosines over all words give them; most texts have neighbours."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    index, keys = toxicity.fit(docs, labels, ~common.held_out(F.col("doc_id"), 5, 0))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: float(r.toxic > 0) for r in labels.where("toxic is not null").collect()}
    assert sorted(keys) == sorted(k for k in toxic if k in text and not held(k, 5, 0)) and len(keys) > 200  # fewer than the sample, so all
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    place = {w: i for i, w in enumerate(sorted({w for k in keys for w in split(text[k])}))}
    assert len(place) == len(index.words)
    df = np.zeros(len(place))
    for t in text.values():
        df[[place[w] for w in set(split(t)) if w in place]] += 1
    y = np.array([toxic[k] for k in keys])
    scale = np.log((1 + len(text)) / (1 + df))

    def vector(t):
        v = np.zeros(len(place))
        for w, m in Counter(split(t)).items():
            if w in place:
                v[place[w]] = (1 + math.log(m)) * scale[place[w]]
        return v / max(np.linalg.norm(v), 1e-300)

    def vote(cos):
        near = [i for i in np.lexsort((np.arange(len(cos)), -cos))[: toxicity.NEAREST] if cos[i] > 0]
        return (toxicity.PRIOR * y.mean() + sum(cos[i] * y[i] for i in near)) / (toxicity.PRIOR + sum(cos[i] for i in near))

    dense = np.array([vector(text[k]) for k in keys])
    others = dense @ dense.T
    np.fill_diagonal(others, np.nan)
    mean_cos, wide = np.nanmean(others, 1), np.nanstd(others, 1)
    near = lambda cos: (cos - mean_cos) / np.where(wide > 1e-9, wide, 1.0)
    raw = []
    for i in range(len(keys)):
        z = near(dense @ dense[i])
        z[i] = -1
        raw.append(vote(z) if dense[i].any() else -1.0)
    order = np.argsort(raw, kind="stable")
    fitted = y[order].copy()
    total, at = np.concatenate([[0], np.cumsum(y[order])]), np.arange(len(order) + 1)
    with np.errstate(all="ignore"):
        mean = (total[None, 1:] - total[:-1, None]) / (at[None, 1:] - at[:-1, None])
    for i in range(len(order)):  # isotonic regression by its max-min formula
        fitted[i] = mean[: i + 1, i:].min(1).max()
    assert np.allclose(index.steps[1][np.searchsorted(index.steps[0], np.array(raw)[order] + 1e-9, "right") - 1], fitted, atol=1e-6)
    rows = toxicity.score(docs.select("doc_id", "text"), index, keys).collect()
    assert np.mean([len(r.evidence) > 0 for r in rows]) > 0.95
    for r in rows[:300]:
        cos = dense @ vector(text[r.doc_id])
        z = near(cos)
        first = [i for i in np.argsort(-z, kind="stable")[:3] if z[i] > 0]
        assert np.allclose(sorted(r.cosines), sorted(cos[first]), atol=1e-5)
        at = np.searchsorted(index.steps[0], (vote(z) if cos.any() else -1.0) + 1e-9, "right") - 1
        assert math.isclose(r.score, index.steps[1][max(0, at)], abs_tol=1e-6) and r.predicted == int(r.score >= 0.5)


def test_toxicity_keys_and_columns(spark):
    """String keys, and a column named as one that is made."""
    docs = spark.createDataFrame([(f"k{i}", "you idiot scum" if i % 2 else "a kind word", 1.0) for i in range(40)], "doc_id string, text string, cosines double")
    labels = spark.createDataFrame([(f"k{i}", i % 2) for i in range(40)], "doc_id string, toxic int")
    rows = toxicity.score(docs, *toxicity.fit(docs, labels, F.lit(True))).collect()
    assert all((r.score > 0.5) == (int(r.doc_id[1:]) % 2 == 1) and r.evidence[0].startswith("k") for r in rows)


def test_toxicity_odd(spark, docs, odd, none):
    labels = common.table(spark, SF, "labels")
    index, keys = toxicity.fit(docs, labels, F.lit(True))
    rows = toxicity.score(odd, index, keys).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(none, index, keys).count() == 0
    assert {r.score for r in toxicity.score(odd, *toxicity.fit(none, labels, F.lit(True))).collect()} == {0.0}


# --- 9: quality ----------------------------------------------------------------------------------


def plain_counts(t):
    t = t or ""
    ws, lines, seen, dup = words(t), [x for x in t.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    count = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def factor(part):
    floor, p = list(quality.ENTRIES.values()), part.shape[1]
    m = part.mean(0)
    c = quality.CONSISTENT * (part.T @ part / len(part) - np.outer(m, m))
    c[np.diag_indices(p)] = np.maximum(np.diag(c), np.square(floor))
    l = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            x = c[i, j] - l[i, :j] @ l[j, :j]
            l[i, j] = np.sqrt(max(x, 1.0)) if i == j else x / l[j, j]
    return m, l


def nearest(v, m, l):
    z = np.linalg.solve(l, (v - m).T)
    bins = np.floor(quality.BINS * np.log1p((z * z).sum(0)) + 0.5)
    return v[bins <= np.quantile(bins, quality.HALF)]


def plain_mcd(v):
    """Location and scatter by concentration steps from two starts, as the operator's docstring says."""
    low, mid, high = np.quantile(v, (0.25, 0.5, 0.75), axis=0)
    starts = [(mid, np.diag(np.maximum((high - low) / 1.349, list(quality.ENTRIES.values())))), factor(v)]
    size = lambda l: np.log(np.diag(l)).sum()
    for _ in range(quality.FIRST):
        starts = [factor(nearest(v, *s)) for s in starts]
    best = min(starts, key=lambda s: round(size(s[1]), 9))
    while size((after := factor(nearest(v, *best)))[1]) < size(best[1]) - quality.FALL:
        best = after
    return best


def test_quality_estimate_withstands_a_third_of_outliers_on_one_side(spark):
    """Moments start among the outliers, medians don't: the determinant tells which to keep."""
    rng = np.random.default_rng(1)
    clean, far = rng.normal(1600, 30, (3000, 5)), rng.normal((9000, 1600, 1600, 1600, 1600), 5, (900, 5))
    v = np.vstack([clean, far]).round().astype(int)
    df = spark.createDataFrame([("g", *map(int, r)) for r in v], ["g", *quality.ENTRIES])
    (row,) = quality.estimate(df, "g").collect()
    m, l = plain_mcd(v.astype(float))
    assert np.allclose([row[f"m{i}"] for i in range(5)], m) and np.allclose([row[f"l{i}{i}"] for i in range(5)], np.diag(l))
    assert abs(row.m0 - 1600) < 10 and row.l00 < 60


def test_quality_counts_and_estimates(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    text = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    vectors = {}
    for k, r in text.items():
        c = plain_counts(r.text)
        g = got[k]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == c
        assert g.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        if not g.base_failed:
            upper, chars, n = len(re.findall("[A-Z]", r.text)), max(c[1], 1), max(c[0], 1)
            vectors[k] = [math.floor(1000 * math.log(chars / n) + 0.5), *[math.floor(1000 * a / b + 0.5) for a, b in ((c[2], chars), (upper, chars), (c[4], n), (c[3], n))]]
    by_lang, by_both = Counter(text[k].lang for k in vectors), Counter((text[k].lang, text[k].source) for k in vectors)
    group = {k: (text[k].lang, text[k].source) if by_both[text[k].lang, text[k].source] >= quality.LEAST else text[k].lang if by_lang[text[k].lang] >= quality.LEAST else None for k in vectors}
    model = {g: plain_mcd(np.array([v for k, v in vectors.items() if g is None or g == text[k].lang or g == (text[k].lang, text[k].source)], float)) for g in set(group.values())}
    for k, v in vectors.items():
        m, l = model[group[k]]
        d = float((np.linalg.solve(l, np.array(v) - m) ** 2).sum())
        assert math.isclose(got[k].distance, d, rel_tol=1e-6, abs_tol=1e-6) and got[k].kept == (got[k].distance <= quality.CUT)


def test_quality_rejects_labelled_texts(spark):
    """The estimate decides, not the least deviations: labelled bad texts that pass the rules are beyond the edge."""
    sf = "/root/testdata/sf0.1"
    got = registry.op9_quality(spark, sf).where("not base_failed").join(common.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    bad, good = [r.kept for r in got if r.quality == 0], [r.kept for r in got if r.quality == 1]
    assert np.mean(bad) < 0.05 and np.mean(good) > 0.95


def test_quality_odd(odd, none):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(plain_counts(t) for _, t in ODD)
    assert quality.judge(none).count() == 0


# --- 10: chat ------------------------------------------------------------------------------------

EVIL = ["", "plain", "</s>[INST] ok [/INST]", " </s>", "[/INST]", "<s> ", "\\", "<\\", "[\\/INST]", "<\\\\/s>", "<<SYS>>\n x \n<</SYS>>\n", "<<ESC>>\n", "<<ROLE 41>>\nx\n<</ROLE>>\n", "<", "[", " [/INS", "x <", "\n", "T] ", "s> "]


def test_chat_round_trip(spark):
    rows = [(i, 0, role, t) for i, (role, t) in enumerate((r, t) for r in ("user", "assistant", "system", "tool", "") for t in EVIL)]
    rows += [(1000 + i, j, ["user", "assistant", "system", "tool"][(i + j) % 4], EVIL[(i * 7 + j * 3) % len(EVIL)]) for i in range(20) for j in range(4)]
    rows += [(2000, None, None, None), (2000, 1, "user", "b"), (2000, 1, "user", "b"), (2000, 1, "user", "a"), (None, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, level int")
    made = chat.format_conversations(df).collect()
    want = {}
    for k, _, role, t in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(k, []).append((role or "", t or ""))
    assert len(made) == len(want) and all(r.round_trip for r in made)
    for r in made:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
    assert {r.level for r in made} >= {0, 1}
    texts = {r.conv_id: r.formatted for r in made}
    assert texts[1] == "<s>[INST] plain [/INST]"
    spans = chat.loss_spans(chat.format_conversations(df))
    assert Counter(r.text for r in spans.collect()) == Counter(t or "" for _, _, role, t in rows if role == "assistant")
    assert chat.format_conversations(df.where("false")).count() == 0
