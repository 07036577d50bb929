"""Collocations, embedding near-duplicates and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import collocations, common, jaccard, neardup, resampling


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- 11: collocations ----------------------------------------------------------------------------


def plain_phrases(rows, most, least, share, top):
    f, n = Counter(), Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    out = {}
    for (g, p), a in found.items():
        inside = [b for (h, q), b in found.items() if h == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= share * a for b in inside):
            cuts = [(1000000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return {(g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


PHRASES = [("en", "New York, new york! NEW\tYORK is big. the new york times " * 6), ("en", None), (None, "a b a b a b: a b c a b c " * 9), ("de", ""), ("de", " \t\n"), ("fr", "é à é à\x0bé à . " * 7), ("en", "x " * 5000), ("it", "one two"), ("en", "new york"), ("en", "new york")]


@pytest.mark.parametrize("most, least, top", [(3, 10, 2000), (4, 3, 5), (2, 300, 2000)])
def test_phrases(spark, most, least, top):
    docs = spark.createDataFrame([(g, t, 1, "x") for g, t in PHRASES], "lang string, text string, f int, phrase string").repartition(5)
    got = collocations.mine(docs, most=most, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain_phrases(PHRASES, most, least, 50, top)


def test_phrases_handed_over_early(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 3)
    docs = spark.createDataFrame(PHRASES, "lang string, text string")
    assert {tuple(r) for r in collocations.mine(docs).collect()} == plain_phrases(PHRASES, 3, 10, 50, 2000)
    assert collocations.mine(docs.where("false")).count() == 0


def test_score_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_000, 5_000_000_000_000, 7_000_000_000_001
    wide = f"cast({a}L AS decimal(19, 0))"
    got = spark.sql(f"SELECT (cast(1000000 AS decimal(7, 0)) * ({wide} * {wide})) div (cast({left}L AS decimal(19, 0)) * cast({right}L AS decimal(19, 0)))").first()[0]
    assert got == 1000000 * a * a // (left * right)


# --- 12: embeddings ------------------------------------------------------------------------------


def plain_links(rows, cosine):
    keys = [r[0] for r in rows]
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / math.sqrt(np.dot(rows[i][1], rows[i][1]) * np.dot(rows[j][1], rows[j][1])) >= cosine] for i in range(len(rows))]
    comp = list(range(len(rows)))
    while True:
        new = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    least = {}
    for k, c in zip(keys, comp):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    return sorted((str(k), len(x), str(least.get(c)), k == least.get(c)) for k, x, c in zip(keys, near, comp))


@pytest.mark.parametrize("leaf, fan", [(256, 4), (8, 2), (3, 2)])
def test_links(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "FAN", fan)
    rng = np.random.default_rng(leaf)
    rows, centres = [], rng.normal(size=(6, 20))
    for i in range(260):
        c = centres[i % 6] + rng.normal(size=20) * (0.02 if i % 6 < 2 else 0.25 if i % 6 < 4 else 1.0)  # two tight groups, two chains, two that scatter
        rows.append((i, [float(x) for x in c * rng.uniform(0.1, 9)], i % 2 if i % 3 else 0))
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(30)]  # exact copies
    rows += [(2000, None, 1), (2001, [0.0] * 20, 1), (2002, [float("nan")] * 20, 1), (2003, [1.0, None], 1), (2004, [1.0] * 20, None), (2005, [], 1), (2006, [float("inf")] * 20, 0), (2007, [1.0, 0.0], 1), (2008, [2.0, 0.0], 1), (None, rows[3][1], rows[3][2]), (None, None, None), (2009, [1e200, 1e-200], 1), (2009, [1e200, 1e-200], 1)]
    docs = spark.createDataFrame([(k, v, lab, "m", 1) for k, v, lab in rows], "vec_id long, embedding array<double>, label int, m string, add int").repartition(3)
    got = neardup.link(docs, cosine=0.93)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [tuple(map(str, x[:3])) for x in plain_links([r for r in rows if r[1] is None or len(r[1]) != 2 or None in r[1] or max(r[1]) < 1e100], 0.93)]
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got.collect() if r.vec_id != 2009)
    # the two rows without squares in doubles link with [1, 0] and [2, 0]: whoever holds these is judged apart
    flat = {2007, 2008}
    assert [tuple(map(str, x[:3])) for x in found if x[0] not in map(str, flat)] == [x for x in want if x[0] not in map(str, flat)]
    assert [(r.n_links, r.component_id, r.kept) for r in got.where("vec_id in (2007, 2009)").orderBy("vec_id").collect()] == [(3, 2007, True), (3, 2007, False), (3, 2007, False)]
    assert neardup.link(docs.where("false")).count() == 0 and neardup.link(docs.where("embedding is null")).count() == 2


def test_pairs_are_skipped_and_linked_as_wholes(spark):
    """Bounds alone decide far and tight intervals; only the rest are compared."""
    far = neardup._judged(spark.createDataFrame([("s", 0, 1, [0.0], [0.1], [0.0, 0.0], [2.0], [2.1], [2.0, 0.0], 0.1, 0.1), ("s", 0, 2, [0.0], [0.1], [0.0, 0.0], [0.0], [0.1], [0.05, 0.0], 0.1, 0.1), ("s", 1, 2, [0.0], [0.9], [0.0, 0.0], [0.3], [0.6], [0.3, 0.0], 0.5, 0.3)], "space string, a long, b long, lo array<double>, hi array<double>, centre array<double>, lo2 array<double>, hi2 array<double>, centre2 array<double>, radius double, radius2 double"), 0.374)
    assert [tuple(r) for r in far.collect()] == [("s", 0, 2, True), ("s", 1, 2, False)]


# --- 13: resampling ------------------------------------------------------------------------------


def plain_draw(docs, aim, n, buckets, percent, least, seed):
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(bucket(x) for _, d in docs for x in runs(d)[1]), Counter(bucket(x) for d in aim for x in runs(d)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for k, d in docs:
        words, xs = runs(d)
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(x)] for x in xs) // len(xs) if xs else 0
        rows.append([k, words, len(xs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = i + 1
    return sorted(map(str, rows))


@pytest.mark.parametrize("n, percent, least, nodes", [(1, 10, 20, 1 << 20), (3, 37, 2, 50), (2, 100, 0, 7)])
def test_draw(spark, monkeypatch, n, percent, least, nodes):
    monkeypatch.setattr(resampling, "NODES", nodes)
    rng = np.random.default_rng(n)
    words = ["alpha", "Beta", "gämma", "delta9", "日本", "eps"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_"]) for _ in range(rng.integers(0, 60)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "--- \x00"), (None, "alpha " * 40), (1003, "beta gämma " * 30_000), (7, docs[7][1])]
    aim = ["alpha gämma gämma", None, "", "eps eps"]
    df = spark.createDataFrame([(k, t, 5, "x", 1) for k, t in docs], "doc_id long, text string, rank int, weight string, n_words int").repartition(4)
    target = spark.createDataFrame([(t,) for t in aim], "text string")
    got = resampling.resample(df, target, n=n, buckets=997, percent=percent, least=least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == plain_draw(docs, aim, n, 997, percent, least, 2024)
    empty = resampling.resample(df, target.where("false"), n=n, buckets=997)
    assert empty.count() == len(docs) and resampling.resample(df.where("false"), target).count() == 0


def test_numbers_have_no_gaps(spark):
    df = common.materialise(spark.range(1000).repartitionByRange(7, F.desc("id")).sortWithinPartitions(F.desc("id")).withColumn("place", F.monotonically_increasing_id()), "places")
    assert [(r.id, r.at) for r in common.numbered(df, "place", "at").orderBy("at").collect()] == [(999 - i, i) for i in range(1000)]


def test_join_by_share(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", 50), ("b", 1), ("d", 4)], "k string, w int")
    got = common.join_by_share(left, right, ["k"], "w", 55, 10)
    assert sorted(tuple(r) for r in got.collect()) == sorted([("a", i, 50) for i in range(50)] + [("b", 1, 1)])


def test_components_of_a_star_and_a_chain(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    assert {(r.node, r.comp) for r in jaccard.components(edges).collect()} == {(i, 0) for i in range(40)} | {(100 + i, 100) for i in range(41)}
