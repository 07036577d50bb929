"""Operators of the citation network: SQL oracles on the smallest tables and exact small cases."""

import glob
import math
import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeloom.functions import ids
from citeloom.operators import catalog, graph, ingest, temporal, text
from citeloom.operators import predicates as P
from citeloom.plans import catalogue, more, tables  # noqa: F401  the others add their queries to catalogue's
from citeloom.sources import works

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.SQL:
        want = duck.execute(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def titles(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "title string")


@pytest.mark.parametrize("expression, want", [("a OR b AND c", ["ac", "bc"]), ("NOT a", ["bc", "c"]), ("machine learning", []), ("(a)", ["ac"]), ("a OR", ValueError)])
def test_expressions_have_one_precedence(spark, expression, want):
    df = titles(spark, "ac", "bc", "c", None)
    if want is ValueError:
        with pytest.raises(ValueError):
            P.Expression(expression).compile(F.col("title"))
    else:
        assert [r[0] for r in df.where(P.Expression(expression).compile(F.col("title"))).collect()] == want


def test_strict_expressions_know_phrases(spark):
    df = titles(spark, "machine learning", "machine", "organic")
    assert [r[0] for r in df.where(P.Expression('"machine learning"', strict=True).compile(F.col("title"))).collect()] == ["machine learning"]
    with pytest.raises(ValueError):
        P.Expression("(a").validate()


def test_null_years_pass_in_staging_only(spark):
    df = spark.createDataFrame([(1990,), (None,), (2000,)], "year int")
    assert df.where(P.year_range(F.col("year"), 1995)).count() == 1
    assert df.where(P.year_range(F.col("year"), 1995, nulls=True)).count() == 2
    assert df.where(P.number_rule(F.col("year"), "not_between", 1995, 2005)).count() == 1


def test_all_marks_are_no_filter(spark):
    df = spark.createDataFrame([("x",), ("good",)], "mark string")
    assert df.where(P.mark_filter(F.col("mark"), ["standard", "good", "neutral", "bad"])).count() == 2


def test_absent_options_have_count_zero(spark):
    df = spark.createDataFrame([("v",)], "venue string")
    out = catalog.facet_options(catalog.facets(df, {"venue": F.array("venue")}), [("venue", "Gamma")]).collect()
    assert {(r["value"], r["n"]) for r in out} == {("v", 1), ("Gamma", 0)}


def test_page_sizes_are_bounded(spark):
    with pytest.raises(ValueError):
        catalog.page(spark.range(1).withColumnRenamed("id", "paperId"), catalog.CatalogQuery(page_size=201))


def test_centrality_of_a_cycle(spark):
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert all(abs(r["v"] - 1 / math.sqrt(3)) < 1e-6 for r in graph.centrality(cycle).collect())


def test_samples_have_no_repeats(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("paperId"), F.lit(0.05).alias("weight"))
    got = [r[0] for r in graph.sample(df, 30, 1).select("paperId").collect()]
    assert len(got) == len(set(got)) == 20
    assert sorted(got) == sorted(r[0] for r in graph.sample(df.repartition(3), 30, 1).select("paperId").collect())


def test_periods(spark):
    df = spark.createDataFrame([(y,) for y in (2020, 2020, 2021, 2022, 2023, 2024, 2025)], "year int")
    assert [r["label"] for r in temporal.fixed_periods(df, 3).orderBy("start_year").collect()] == ["2020-2022", "2023-2025"]
    assert [r["label"] for r in temporal.fixed_periods(df.where("year < 2025"), 3, keep_partial=False).collect()] == ["2020-2022"]
    assert temporal.adaptive_periods(df.where("year < 2025"), 2, 3).count() >= 1


def test_upsert_keeps_flags(spark):
    schema = "paperId string, title string, processed boolean, isSeed boolean, selected boolean"
    old, new = spark.createDataFrame([("W1", "a", True, True, False)], schema), spark.createDataFrame([("W1", "b", False, False, False)], schema)
    assert tuple(ingest.upsert(old, new).first()) == ("W1", "b", True, True, False)
    assert ingest.upsert(old, new, sticky=()).first()["processed"] is False


def test_staging_takes_the_first_of_a_doi(spark):
    schema = "id int, doi string, source_type string, source_id string, title string, year int"
    new = spark.createDataFrame([(1, "10.1/a", "m", "1", "t", 2000), (2, "10.1/A", "m", "2", "u", 2001), (3, None, None, None, None, None)], schema)
    assert {r["id"] for r in ingest.insert_staging(new.limit(0), new, "id").collect()} == {1, 3}


def test_index_of_a_long_text_in_linear_time(spark):
    """A text of very many words comes back from its index within seconds, with and without the spaces between words; odd texts, too."""
    long = " ".join(f"w{i % 30011}" + " " * (i % 3) for i in range(120_000))
    rows = [(1, long), (2, None), (3, ""), (4, "  a  b a "), (5, "   "), (6, "é\t é")]
    docs = spark.createDataFrame(rows, "k int, t string")
    for gaps in (True, False):
        index = works.inverted_index(docs, "k", "t", gaps)
        began = time.time()
        got = dict(index.select("k", ids.gapped_text(F.col("index")).alias("t")).collect())
        assert time.time() - began < 60
        assert got == {k: (t.rstrip(" ") or None if gaps else t) for k, t in rows if t is not None}
    assert dict(works.inverted_index(docs, "k", "t", True).select("k", ids.from_inverted_index(F.col("index"))).collect())[4] == "a b a"
    assert index.where("k = 4").first()["index"] == {"": [0, 1, 3, 6], "a": [2, 5], "b": [4]}


def test_dois_and_identifiers(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/AB",), ("doi:doi:10.1/x",), (" ",), (None,)], "d string")
    assert [r[0] for r in df.select(ids.match_doi(F.col("d"))).collect()] == ["10.1/ab", "doi:10.1/x", None, None]
    assert [r[0] for r in df.select(ids.match_doi(F.col("d"), every_prefix=True)).collect()][1] == "10.1/x"
    got = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string, array<int>>").select(ids.from_inverted_index(F.col("m"))).first()[0]
    assert got == "a b a"


def test_venues(spark):
    aliases = spark.createDataFrame([("2nd international test conference", "TESTCONF")], "alias string, canonical string")
    df = spark.createDataFrame([("2022 2nd International Test Conference (ITC)",), ("2020 example workshop!!!",)], "venue string")
    assert [r["venue_normal"] for r in text.normalise_venue(df, "venue", aliases).orderBy("venue").collect()] == ["Example Workshop", "TESTCONF"]


def test_venues_go_through_all_nine_rules(spark):
    want = {"IEEE: X": "x", "2020 Proceedings of X": "x", "X 2019": "x", "In: X": "x", "X 12(3)": "x", "X pp. 12-15": "x", "X (ITC)": "x", "Proc. X!!": "x", "  Springer -  A  &  B ": "a b", "1850 x": "x", "": "", "pages": "pages"}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "venue string")
    assert {r[0]: r[1] for r in df.select("venue", text.clean_venue(F.col("venue"))).collect()} == want | {None: ""}


def test_latex(spark):
    from citeloom.sources import works

    df = spark.createDataFrame([("\\title{T}\\author{A}\\date{May 2020}\\begin{abstract}x\ny\\end{abstract}",)], "text string")
    got = df.select(works.latex().alias("f")).select("f.title", "f.authors", "f.year").first()
    assert (got[0], list(got[1]), got[2]) == ("T", ["A"], 2020)


def test_positions_over_many_partitions(spark):
    """Every row keeps its position when its order is dealt over many partitions that are coalesced anew."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40"), spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        got = graph.bypass_threshold(spark.range(0, 200_000, 1, 7).select(F.format_string("W%07d", "id").alias("paperId"), "id"), 0.001)
        assert got.count() == 200_000 and got.where("position <> id").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_topic_models(spark):
    """Both models part two groups of documents without a word in common."""
    from citeloom.operators import factors, topics

    a, b = "red green blue red blue".split(), "cat dog bird cat bird".split()
    docs = spark.createDataFrame([(i, (a if i % 2 else b) + ((a if i % 2 else b)[i % 5 :])) for i in range(40)], "doc_id int, words array<string>")
    found = {r.doc_id: r.topic for r in topics.lda(docs, 2, rounds=30)[0].collect()}
    counts = docs.select(F.col("doc_id").alias("doc"), F.explode("words").alias("term")).groupBy("doc", "term").agg(F.count("*").cast("double").alias("weight"))
    w, h, _ = factors.nmf(counts, 2, rounds=15)
    other = {r.doc: r.topic for r in factors.largest(w).collect()}
    for topic in (found, other):
        assert len(topic) == 40 and len({topic[i] for i in range(0, 40, 2)}) == 1 and len(set(topic.values())) == 2
    tops = factors.top_terms(h, 3).collect()
    assert {frozenset(r.term for r in tops if r.topic == t) for t in (0, 1)} == {frozenset(a), frozenset(b)}
    assert topics.lda(docs.where("false"), 2)[0].count() == 0


def test_recommender_against_plain_algebra(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 4)), rng.integers(0, 2, 20).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").repartition(5)
    got = {r.vec_id: r.score for r in text.linucb(df, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "vec_id int, reward double")).collect()}
    inv = np.linalg.inv(np.eye(4) + x[:20].T @ x[:20])
    want = x @ inv @ (x[:20].T @ y) + np.sqrt(np.einsum("ij,jk,ik->i", x, inv, x))
    assert sorted(got) == list(range(20, 60)) and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_adaptive_periods_hold_enough(spark):
    df = spark.createDataFrame([(y,) for y in (2020, 2020, 2021, 2022, 2023, 2024)], "year int")
    assert [(r.start_year, r.end_year) for r in temporal.adaptive_periods(df, 2, 3).orderBy("start_year").collect()] == [(2020, 2021), (2022, 2024)]


def test_evolution_says_what_is_missing(spark):
    df = spark.createDataFrame([("a", 2020)] * 6, "topic string, year int")
    periods = temporal.fixed_periods(df, 2)
    for bad, word in ((df.limit(3), "few papers"), (df.withColumn("topic", F.lit(None).cast("string")), "topic"), (df.withColumn("year", F.lit(None).cast("int")), "year")):
        with pytest.raises(ValueError, match=word):
            temporal.evolution(bad, periods)


def test_markdown_files(spark, tmp_path):
    from citeloom.sources import folder

    (tmp_path / "a.md").write_text("---\ntitle: 'A b'\nyear: 2020\n---\ntext")
    (tmp_path / "b.md").write_text("no front matter")
    (tmp_path / "c.txt").write_text("---\ntitle: x\n---\n")
    assert [(r.path, r.fields) for r in folder.library(folder.read(spark, str(tmp_path))).collect()] == [("a.md", {"title": "A b", "year": "2020"})]


def test_files(spark, tmp_path):
    from citeloom.sources import works

    (tmp_path / "seeds.txt").write_text("W1\n W2 \n\nW1\n")
    assert sorted(r[0] for r in works.seed_file(spark, str(tmp_path / "seeds.txt")).collect()) == ["W1", "W2"]
    (tmp_path / "r.csv").write_text("RetractionDOI,OriginalPaperDOI,Reason\nhttps://doi.org/10.1/A,10.2/B,x\n,,y\n,10.3/c,z\n")
    assert sorted(map(str, works.retraction_csv(spark, str(tmp_path / "r.csv")).collect())) == sorted(["Row(RetractionDOI='10.1/a', OriginalPaperDOI='10.2/b', Reason='x')", "Row(RetractionDOI=None, OriginalPaperDOI='10.3/c', Reason='z')"])
    seeds = spark.createDataFrame([("W1",)], "paperId string")
    seeds.write.parquet(str(tmp_path / "p.parquet"))
    assert works.frame(spark, str(tmp_path / "p.parquet"), seeds.schema).count() == 1
    assert works.frame(spark, str(tmp_path / "none.parquet"), seeds.schema).count() == 0
