"""The pipeline against its stages done plainly, and each stage's odd inputs."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from citeloom.llm import common, registry, sentencepieces
from test_llm import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs = common.table(spark, SF, "documents").cache()
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialise(stage(spark, out[-1], SF), f"test-{name.replace(' ', '-')}").cache())
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert [len(ids(x)) for x in stages] == sorted([len(ids(x)) for x in stages], reverse=True)


FOREIGN = ["これは日本語の文章です。今日は天気がいいので、散歩に行きましょう。" * 5, "Это предложение написано на русском языке и не входит в корпус. " * 6, "1234 5678 !!!! ---- 99 " * 20, ""]


def test_language(spark, stages):
    """Texts in other scripts and without letters go; of the corpus, nearly all stay."""
    docs = stages[0].unionByName(spark.createDataFrame([(10_000 + i, t, None, "x", len(t)) for i, t in enumerate(FOREIGN)], stages[0].schema))
    kept = set(ids(corpus_pipeline.language(spark, docs, SF)))
    assert not kept & {10_000 + i for i in range(len(FOREIGN))}
    long = {r.doc_id for r in stages[0].collect() if len((r.text or "").split()) >= 20}
    assert len(long & kept) >= 0.98 * len(long)


def plain_failure(t):
    """Too few words, or too many in word windows that come again."""
    ws = [w for w in re.split("[\\x20\\x09-\\x0D]+", t or "") if w]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    again = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    return len(ws) < 10 or 100 * len(again) > 20 * len(ws)


def test_quality(spark, stages):
    """What fails the plain rules goes, so does a text of symbols; few others do."""
    odd = spark.createDataFrame([(20_000, " ".join(f"#{i}$$$%%%&&&***" for i in range(200)), "en", stages[1].first().source, 1)], stages[1].schema)
    kept = set(ids(corpus_pipeline.quality_rules(spark, stages[1].unionByName(odd), SF)))
    failed = {r.doc_id for r in stages[1].collect() if plain_failure(r.text)}
    assert failed and not kept & (failed | {20_000})
    good = {r.doc_id for r in stages[1].collect()} - failed
    assert len(kept & good) > 0.9 * len(good)


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()]
    plain = [x.strip("()").split(", ") for x in plain_components(rows, 5, 80)]
    assert ids(stages[3]) == sorted(int(a) for a, _, c in plain if a == c)


def test_benchmark_items(spark, stages):
    """Texts that hold a whole item word by word go; those without five words in a row of any item stay."""
    flat = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    items = [flat(r.text) for r in common.table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + 5]) for w in items for i in range(len(w) - 4)}
    planted = spark.createDataFrame([(30_000 + i, "Some words before. " + " ".join(w) + " and some after", "en", "x", 1) for i, w in enumerate(items)], stages[3].schema)
    docs = stages[3].unionByName(planted).collect()
    kept = set(ids(corpus_pipeline.benchmark_items(spark, spark.createDataFrame(docs, stages[3].schema), SF)))
    for r in docs:
        w = flat(r.text)
        if any(len(x) >= 4 and f" {' '.join(x)} " in f" {' '.join(w)} " for x in items):
            assert r.doc_id not in kept
        elif not any(tuple(w[i : i + 5]) in grams for i in range(len(w) - 4)):
            assert r.doc_id in kept


def test_pieces(stages):
    p = sentencepieces.processor(registry.piece_model())
    got = {r.doc_id: r for r in stages[5].collect()}
    rows = stages[4].collect()
    assert len(rows) == len(got)
    for r in rows:
        want = p.encode(r.text)
        assert got[r.doc_id].ids == want and got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


@pytest.mark.parametrize("k", range(5))
def test_odd_inputs(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key long, kept boolean, node int"
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "The same words stand here twice, and that is all there is to it."), (3, "The same words stand here twice, and that is all there is to it."), (None, "No id here but words enough to be a text of the corpus, one would think."), (4, long)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, True, 1) for i, t in rows], schema)
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    assert out.count() <= len(rows) and (k == 4 or out.columns == docs.columns)
    assert stage(spark, docs.where("false"), SF).count() == 0
