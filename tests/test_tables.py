"""Operators that need several passes over whole tables, against plain versions."""

import difflib
import itertools
import json
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.operators import batches, factors, graph, languages, names, titles
from citeloom.operators.corpus import Corpus
from citeloom.plans import catalogue, tables
from citeloom.sources import folder, papers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, SF)


# --- titles --------------------------------------------------------------------------------------


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def plain_pairs(left, right, t):
    return sorted((a, b, round(r, 12)) for a in set(left) - {""} for b in set(right) - {""} if (r := ratio(a, b)) >= t)


def found_pairs(spark, left, right, t):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "title string").repartition(3)
    return sorted((r.a, r.b, round(r.ratio, 12)) for r in titles.alike(df(left), df(right), t).collect())


@pytest.mark.parametrize("t", [0.6, 0.75, 0.85, 0.95, 1.0])
def test_titles_are_alike_as_all_pairs_say(spark, t):
    rng = random.Random(7)
    left, right = ["", "a", "ab", "abc", "aaaa", "the the the"], ["", "a", "ab", "abd", "aaab", "the the", "aaaa"]
    for n in [1, 2, 3, 4, 5, 6, 8, 12, 30, 60, 230]:
        for _ in range(6):
            x = "".join(rng.choice("abcde   ") for _ in range(n)).strip()
            left.append(x)
            y = list(x)
            for _ in range(rng.randint(0, max(1, n // 8))):
                at = rng.randrange(len(y) + 1)
                rng.choice([lambda: y.insert(at, rng.choice("abcé")), lambda: y[at : at + 1].clear() or y.__delitem__(slice(at, at + 1)), lambda: y.__setitem__(slice(at, at + 1), rng.choice("xyz"))])()
            right += ["".join(y), "".join(rng.choice("abcde   ") for _ in range(n)).strip()]
    assert found_pairs(spark, left, right, t) == plain_pairs(left, right, t)


def test_bounds_hold_for_short_strings():
    """Every pair of strings of up to 5 letters: what least_shared promises is there."""
    words = ["".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)]
    for t in (0.7, 0.8, 0.85, 0.9):
        q = titles.element_size(t)
        for a, b in itertools.product(words, words):
            if a != b and ratio(a, b) >= t:
                need = titles.least_shared(len(a), t, q)
                assert need is not None and need <= titles.shared(len(a), len(b), t, q) <= len(set(titles._elements(a, q)) & set(titles._elements(b, q)))
                assert abs(titles.band(len(a), t) - titles.band(len(b), t)) <= 1 and need > 0


def test_title_query_has_all_pairs(spark, corpus):
    key = lambda df: [r[0] for r in df.select(tables.title_key(F.col("title"))).collect()]
    want = plain_pairs(key(tables._noted(corpus)), key(tables._page_titles(corpus)), 0.85)
    got = sorted((r.a, r.b, round(r.ratio, 12)) for r in catalogue.QUERIES["T15_join"](spark, SF).collect())
    assert got == want and len({a for a, _, _ in got}) > 30


def test_items_are_matched(spark):
    papers = spark.createDataFrame([("W2", "Deep Learning of graphs!", "10.1/a"), ("W1", "deep learning of graphs", None), ("W3", "Other things entirely", "10.1/C"), ("W4", None, ""), ("W5", "", None)], "paperId string, title string, doi string")
    items = spark.createDataFrame([("i1", "Deep learnin of graphs", None), ("i2", "nothing alike", "https://doi.org/10.1/c"), ("i3", "Deep Learning of Graphs", "10.9/unknown"), ("i4", "", None), ("i5", None, None), ("i6", "zzz", None), ("i6", "zzz", None)], "item string, title string, doi string")
    got = sorted(map(str, [tuple(r) for r in titles.match(items, papers).withColumn("confidence", F.round("confidence", 4)).collect()]))
    assert got == sorted(map(str, [("i1", "W1", round(ratio("deep learnin of graphs", "deep learning of graphs"), 4), "title"), ("i2", "W3", 1.0, "doi"), ("i3", "W1", 1.0, "title"), ("i4", None, None, "none"), ("i5", None, None, "none"), ("i6", None, None, "none"), ("i6", None, None, "none")]))
    assert titles.match(items.where("false"), papers).count() == 0 and titles.match(items, papers.where("false")).where("how <> 'none'").count() == 0


# --- files ---------------------------------------------------------------------------------------


def read(spark, reader, content, binary=False):
    df = spark.createDataFrame([(content,)], "x binary" if binary else "x string")
    return df.select(reader("x").alias("m")).select("m.*").first().asDict()


NOTHING = {"title": None, "authors": [], "abstract": None, "year": None, "doi": None, "venue": None}


def test_articles(spark):
    whole = """<?xml version="1.0" encoding="latin-1"?><!DOCTYPE article><a:article xmlns:a="urn:x" xmlns="urn:y"><article-meta><article-title>A &amp; B &#233; <![CDATA[<x>]]></article-title>
      <contrib contrib-type="editor"><name><surname>Ed</surname></name></contrib><contrib><name><surname>Untyped</surname></name></contrib><contrib contrib-type="author"><name><surname>Li</surname></name></contrib>
      <contrib contrib-type="author"><name><given-names>Only</given-names></name></contrib><contrib contrib-type="author"/><a:id pub-id-type="doi">10.1/x</a:id><abstract><title>Abstract</title>  <p>one <b>two</b></p></abstract></article-meta></a:article>"""
    assert read(spark, papers.article, whole) == {"title": "A & B é <x>", "authors": ["Li", "Only"], "abstract": "Abstract one two", "year": None, "doi": "10.1/x", "venue": None}
    assert read(spark, papers.article, "<article><contrib contrib-type='editor'><surname>Ed</surname></contrib></article>") == NOTHING
    for bad in ("<article><article-title>x</article>", "", None, "no xml", "<!DOCTYPE a [<!ENTITY b '&c;'>]><a>&b;</a>"):
        assert read(spark, papers.article, bad) == NOTHING
    assert read(spark, papers.article, "<article><article-title>ünï</article-title></article>".encode("latin-1"), True) == NOTHING
    assert read(spark, papers.article, '<?xml version="1.0" encoding="latin-1"?><article><article-title>ünï</article-title></article>'.encode("latin-1"), True)["title"] == "ünï"


def test_tei_headers(spark):
    tei = lambda x: f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader>{x}</teiHeader></TEI>'
    got = read(spark, papers.tei, tei("<fileDesc><titleStmt><title> T </title></titleStmt><sourceDesc><author>Plain Name</author><author><persName>Whole</persName></author><author><persName><surname>Half</surname></persName></author></sourceDesc></fileDesc><date>in 1999 or 2001</date><date when='12'/>"))
    assert got == NOTHING | {"title": "T", "authors": ["Plain Name", "Whole"], "year": "1999"}
    assert read(spark, papers.tei, "<TEI><titleStmt><title>T</title></titleStmt></TEI>") == NOTHING and read(spark, papers.tei, "<TEI>") == NOTHING
    lines = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "n array<string>").select(papers.author_line(F.col("n"))).collect()
    assert [r[0] for r in lines] == [None, "a", "a and b", "a, b and c"]


def test_pages(spark):
    got = read(spark, papers.page, "<p>x<meta name=citation_title content=''><h1> A <b>b </b>c</h1><div class='abstract x'>one<div>two</div><style>p{}</style></div>three</p><title></title>")
    assert got == NOTHING | {"title": "Abc", "abstract": "one two"}
    assert read(spark, papers.page, "<title>T &lt;x&gt;</title><span id='abstract'>only</span> not <br id=abstract>") == NOTHING | {"title": "T <x>", "abstract": "only"}
    for bad in ("", None, "<", "<!--", "</p></div>", "<a b='"):
        assert read(spark, papers.page, bad) == NOTHING


def test_titles_that_end_within_a_reference(spark, tmp_path):
    """Titles are cut after so many characters, maybe before a reference's semicolon."""
    import duckdb

    cut = ["a &quot", "a &quo", "a &amp", "a &am", "a &", "&quot; b &amp; c", "a &quot b", "&amp;quot", "&ampquot;", "a &lt", "&#39", "&copy", "&"]
    rows = [(i, "", f"<html><head><title>{t}</title></head><body><h1>{t}</h1></body></html>") for i, t in enumerate(x for x in cut for _ in range(3))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["S15"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL['S15']}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == want
    assert read(spark, papers.page, "<title>a &quot</title>")["title"] == 'a "'


def test_manuscripts(spark):
    lines = lambda *xs: read(spark, papers.docx, papers.pack_docx(list(xs)), True)
    assert lines("T", "ann lee and bo", "Abstract: short", "2001", "Year: 2002") == NOTHING | {"title": "T", "authors": ["ann lee", "bo"], "abstract": "short", "year": "2002"}
    assert lines("T", "x", "long text", "author(s) - A; B", "1999") == NOTHING | {"title": "T", "authors": ["A", "B"], "abstract": "long text", "year": "1999"}
    assert lines("T", "one", "1987") == NOTHING | {"title": "T", "year": "1987"}
    assert lines() == NOTHING
    for bad in (b"", None, b"PK\x03\x04 no package", papers.pack_docx(["x"])[:-30]):
        assert read(spark, papers.docx, bad, True) == NOTHING
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
    assert papers.docx_lines(out.getvalue()) == ["a\tb", "end", "cell", "cell"]


def test_folder_source(spark, tmp_path):
    files = {"a/1.html": b"<html><title>Page</title>", "a/2.xml": b"<?xml version='1.0'?><article><article-title>Art</article-title></article>", "3.docx": papers.pack_docx(["Doc", "Ann Lee"]), "4.tex": b"\\title{Tex}\\date{2001}", "bad.xml": b"<?xml version='1.0'?><article>", "no.bin": b"\x00\xff", "n.md": b"---\ntitle: x\n---\n", "empty.docx": b""}
    folder.write(spark.createDataFrame(list(files.items()), "path string, content binary").repartition(3), f"file://{tmp_path}/f")
    back = folder.read(spark, f"{tmp_path}/f", bytes=100)
    assert {r.path: bytes(r.content) for r in back.collect()} == files and back.rdd.getNumPartitions() > 2
    assert {r.path: (r.kind, r.title) for r in folder.metadata(back).collect()} == {"a/1.html": ("html", "Page"), "a/2.xml": ("xml", "Art"), "3.docx": ("docx", "Doc"), "4.tex": ("latex", "Tex")}
    folder.write(spark.createDataFrame([("a/1.html", b"new")], "path string, content binary"), f"{tmp_path}/f")
    assert bytes(folder.read(spark, f"{tmp_path}/f").where("path = 'a/1.html'").first().content) == b"new"
    assert folder.read(spark, f"{tmp_path}/none").count() == 0 and [r.path for r in folder.read(spark, f"{tmp_path}/f", suffix=".md").collect()] == ["n.md"]


@pytest.mark.parametrize("text, scalars, lists", [
    ("---\na: 1\nb: 'it''s'\nc: \"x\\ny\"\nd:\ne: null\nf: ~\n---\nbody", {"a": "1", "b": "it's", "c": "x\ny"}, {}),
    ("---\ntags:\n  - one\n  - 'two, three'\n  -\nlist: [a, \"b, c\", 'd']\nempty: []\n---", {}, {"tags": ["one", "two, three"], "list": ["a", "b, c", "d"], "empty": []}),
    ("---\nlong: first\n  second\n  third\nnext: x # remark\nurl: http://a.b/c#d\n---\n", {"long": "first second third", "next": "x", "url": "http://a.b/c#d"}, {}),
])
def test_fields_of_notes(text, scalars, lists):
    assert folder.front_fields(text) == (scalars, lists)


@pytest.mark.parametrize("text", ["", "x", "---\na: 1\n", "---\n---\n", "---\n\n---\n", " ---\na: 1\n---\n", "---\n# only\n---\n"])
def test_no_fields(text):
    assert folder.front_fields(text) is None


def test_notes_come_back(spark, tmp_path):
    """Any text in a field of a note is read as it was."""
    odd = ["plain", "with: colon", "quote \" and 'single'", "- dash", "[a, b]", "# no remark", "back\\slash \\n", "line\nbreak\ttab", "é ☃ 𝒳", "null", " spaces ", "---", "100%"]
    rows = spark.createDataFrame([(f"{i}.md", t, [t, "x"]) for i, t in enumerate(odd)], "path string, t string, l array<string>")
    folder.write(rows.select("path", F.encode(folder.note_text({"t": F.col("t"), "l": F.col("l"), "n": F.lit(None).cast("string")}, F.col("t"), [F.lit("body")]), "UTF-8").alias("content")), str(tmp_path / "notes"))
    got = {r.path: (r.fields, r.lists) for r in folder.library(folder.read(spark, str(tmp_path / "notes"))).collect()}
    assert got == {f"{i}.md": ({"t": t}, {"l": [t, "x"]}) for i, t in enumerate(odd)}


# --- graph ---------------------------------------------------------------------------------------


def plain_centrality(edges, back, max_iter=1000, tol=1e-6):
    ids = sorted({x for e in edges for x in e})
    x = {v: 1 / len(ids) for v in ids}
    for _ in range(max_iter):
        y = dict(x)
        for a, b in set(edges):
            y[a if back else b] += x[b if back else a]
        norm = sum(v * v for v in y.values()) ** 0.5
        y = {k: v / norm for k, v in y.items()}
        if sum(abs(y[k] - x[k]) for k in y) < len(ids) * tol:
            return y
        x = y
    return dict.fromkeys(ids)


def test_centralities(spark, monkeypatch):
    rng = random.Random(3)
    edges = [("hub", f"n{i}") for i in range(40)] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(150)] + [("n1", "hub"), ("n2", "hub"), ("n2", "hub"), ("n3", "n3")]
    df = spark.createDataFrame(edges, "src string, dst string")
    for hubs in (1000, 6):  # with and without nodes that are joined by broadcast
        monkeypatch.setattr(graph, "HUBS", hubs)
        got = {r.id: (r.centrality_in, r.centrality_out) for r in graph.centralities(df).collect()}
        for j, back in enumerate((False, True)):
            want = plain_centrality(edges, back)
            assert got.keys() == want.keys() and max(abs(got[k][j] - want[k]) for k in want) < 1e-6
    short = graph.centralities(df, max_iter=2).collect()
    assert len(short) == 41 and all(r.centrality_in is None and r.centrality_out is None for r in short)
    one_way = graph.centralities(df, max_iter=12, tol=1e-4).collect()
    assert [r.centrality_in is None for r in one_way] == [plain_centrality(edges, False, 12, 1e-4)["hub"] is None] * 41
    assert graph.centralities(df.where("false")).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("citeloom_")]


def test_settled_directions_read_no_edges(spark, monkeypatch):
    """Edges are bucketed as they are joined, a round is written only if a direction needs it, and reads the edges of these directions only."""
    from citeloom.operators import scratch

    rng = random.Random(5)
    edges = [(f"n{int(60 * rng.random() ** 3)}", f"n{rng.randrange(60)}") for _ in range(400)]
    rounds = [next(k for k in range(1, 100) if plain_centrality(edges, back, k)["n0"] is not None) for back in (False, True)]
    assert rounds[0] != rounds[1]
    monkeypatch.setattr(graph, "HUBS", 1)
    plans, tags, bucketed, cut = [], [], scratch.Tables.bucketed, graph.cut_lineage
    monkeypatch.setattr(scratch.Tables, "bucketed", lambda self, df, *a, **b: (plans.append(df._jdf.queryExecution().executedPlan().toString()), bucketed(self, df, *a, **b))[1])
    monkeypatch.setattr(graph, "cut_lineage", lambda df, tag: (tags.append(tag), cut(df, tag))[1])
    got = {r.id: (r.centrality_in, r.centrality_out) for r in graph.centralities(spark.createDataFrame(edges, "src string, dst string")).collect()}
    for j, back in enumerate((False, True)):
        want = plain_centrality(edges, back)
        assert got.keys() == want.keys() and max(abs(got[k][j] - want[k]) for k in want) < 1e-6
    assert tags == ["plain-edges", "nodes"] and len(plans) == 1 + max(rounds)
    assert "there" not in plans[1]  # the first round's gains are counts of edges
    alone = [bool(re.search(r"PartitionFilters: \[[^\]]*back", x)) for x in plans[2:]]
    assert alone == [k > min(rounds) for k in range(2, max(rounds) + 1)]


def test_rows_that_are_weighed_are_made_once(spark):
    """Counting, summing and weighing rows made them four times."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(x):
        made.add(1)
        return x

    rows = [("a", 2000, 0.5, None), ("b", 1990, None, 0.25), ("b", 1990, None, 0.25), ("c", None, None, None), ("d", 2010, None, None), (None, 2000, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "paperId string, year int, c_in double, c_out double").withColumn("paperId", named("paperId"))
    got = graph.weights(df, 0.1, 2000)
    assert got.columns == [*df.columns, "weight"]
    low, own = 1e-5 / 7, []
    for _, year, *c in rows:
        raw = 0 if year is None else np.exp(-0.1 * (2000 - year)) * max(low if x is None else x for x in c)
        own.append(raw if raw > 0 else 1e-50)
    want = sorted(((str(r[0]), w / sum(own)) for r, w in zip(rows, own)))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 1e-12 * b[1] for a, b in zip(sorted((str(r.paperId), r.weight) for r in got.collect()), want, strict=True)) and made.value == 6
    assert graph.weights(df.where("year > 3000"), 0.1, 2000).count() == 0


@pytest.mark.parametrize("hubs", [1, 6])
def test_centralities_of_odd_edges(spark, monkeypatch, hubs):
    """Edges that come twice or lack an end, loops, an empty name, and edges none of which has both ends."""
    monkeypatch.setattr(graph, "HUBS", hubs)
    whole = [("a", "b"), ("a", "b"), ("b", "b"), ("", "b"), ("c", ""), ("b", "d"), ("d", "a")]
    for some in (whole, []):
        edges = spark.createDataFrame([*some, (None, "b"), ("x", None), (None, None)], "src string, dst string")
        got = {r.id: (r.centrality_in, r.centrality_out) for r in graph.centralities(edges).collect()}
        assert got.keys() == {x for e in some for x in e} | {None, "b", "x"}
        ids = sorted(got, key=str)
        loops = [(str(a), str(b)) for a, b in some]
        for j, back in enumerate((False, True)):
            x, settled = dict.fromkeys(map(str, ids), 1 / len(ids)), False
            while not settled:
                y = dict(x)
                for a, b in set(loops):
                    y[a if back else b] += x[b if back else a]
                norm = sum(v * v for v in y.values()) ** 0.5
                y = {k: v / norm for k, v in y.items()}
                x, settled = y, sum(abs(y[k] - x[k]) for k in y) < len(ids) * 1e-6
            assert max(abs(got[k][j] - x[str(k)]) for k in got) < 1e-6


def test_numbers_of_the_property_graph_have_no_gaps(spark, corpus):
    lines = [json.loads(r.value) for r in graph.property_graph(corpus.papers.repartition(7), corpus.references, corpus.citations_in, corpus.paper_author, corpus.authors.unionByName(spark.createDataFrame([("A999", None)], "authorId string, authorName string"))).collect()]
    links = [x for x in lines if x["type"] == "relationship"]
    assert sorted(int(x["id"]) for x in links) == list(range(len(links))) and {x["label"] for x in links} == {"PUBLISHED_BY", "AUTHORED_BY", "CITE"}
    nodes = {x["id"] for x in lines if x["type"] == "node"}
    assert len(nodes) == len(lines) - len(links) and all({x["start"]["id"], x["end"]["id"]} <= nodes for x in links)


# --- factors -------------------------------------------------------------------------------------


def plain_factors(x, k, rounds=1000, tol=1e-4):
    u, s, v = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((len(x), k)), np.zeros((k, x.shape[1]))
    for j in range(k):
        parts = [(np.maximum(sign * u[:, j], 0), np.maximum(sign * v[j], 0)) for sign in (1, -1)]
        weight = [np.linalg.norm(a) * np.linalg.norm(b) for a, b in parts]
        a, b = parts[int(weight[1] > weight[0])]
        w[:, j], h[j] = np.sqrt(s[j] * max(weight)) * a / np.linalg.norm(a), np.sqrt(s[j] * max(weight)) * b / np.linalg.norm(b)
    w[w < 1e-6], h[h < 1e-6], h = x.mean(), x.mean(), h.T
    first = None
    for r in range(1, rounds + 1):
        moved = 0.0
        for own, other, m in ((w, h, x), (h, w, x.T)):
            gram, top = other.T @ other, m @ other
            for t in range(k):
                slope = own @ gram[t] - top[:, t]
                moved += np.abs(np.where(own[:, t] == 0, np.minimum(slope, 0), slope)).sum()
                own[:, t] = np.maximum(own[:, t] - slope / gram[t, t], 0)
        first = first or moved
        if moved / first <= tol:
            break
    return r, np.linalg.norm(x - w @ h.T)


@pytest.mark.parametrize("k, hubs, observed", [(3, 1000, 8), (4, 30, 2)])
def test_factors(spark, monkeypatch, k, hubs, observed):
    monkeypatch.setattr(factors, "HUBS", hubs)
    monkeypatch.setattr(factors, "OBSERVED", observed)
    rng = np.random.default_rng(k)
    x = np.maximum(0, rng.normal(size=(60, k))) @ np.maximum(0, rng.normal(size=(k, 40))) * (rng.random((60, 40)) < 0.4)
    df = spark.createDataFrame([(f"d{i}", f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc string, term string, weight double")
    w, h, known = factors.nmf(df, k, tol=3e-2)
    rounds, error = plain_factors(x, k, tol=3e-2)
    assert known["settled"] and abs(known["error"] - error) < 0.01 * error and abs(known["rounds"] - rounds) <= 2
    at, to = {r.doc: np.array(r.w) for r in w.collect()}, {r.term: np.array(r.h) for r in h.collect()}
    left = sum((x[i, j] - (at[f"d{i}"] @ to[f"t{j}"] if f"d{i}" in at and f"t{j}" in to else 0)) ** 2 for i in range(60) for j in range(40)) ** 0.5
    assert abs(left - known["error"]) < 1e-6 and all((v >= 0).all() for v in at.values())
    none = factors.nmf(df.where("false"), k, rounds=2)
    assert none[0].count() == none[1].count() == 0


def test_packages_are_made_in_pieces(monkeypatch):
    """A batch's strings are not all objects of Python at once; rows, null ones too, keep their packages."""
    rows = [["a", None, "b" * 5000], None, [], ["c" * 3000], ["d"], ["e"]]
    seen = []
    monkeypatch.setattr(papers, "cuts", lambda values: (seen.append(x) or x for x in batches.cuts(values, 2000)), raising=False)
    got = papers.packed.func(pa.array(rows, pa.list_(pa.string()))).to_pylist()
    assert got == [papers.pack_docx([y or "" for y in x]) if x is not None else None for x in rows]
    assert len(seen) > 2 and papers.packed.func(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_small_files_are_dealt_to_many_tasks(spark, tmp_path):
    """Rows that lie in one partition are written by several tasks, and many small files are read by several."""
    rows = spark.range(0, 400, 1, 1).select(F.concat((F.col("id") % 3).cast("string"), F.lit("/n"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    told = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "files")
    folder.write(rows, str(tmp_path), dealt=False)
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("files") for s in told.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert any(s and s.numTasks == int(spark.conf.get("spark.sql.shuffle.partitions")) for s in stages)
    back = folder.read(spark, str(tmp_path), files=100)
    assert back.rdd.getNumPartitions() == 4
    assert {r.path: bytes(r.content) for r in back.collect()} == {f"{i % 3}/n{i}": str(i).encode() for i in range(400)}


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver never sees the names of a folder's files; what the format reads is the same."""
    files = {f"{'a/b/' * (i % 3)}c{i % 5}/n{i}.md": str(i).encode() for i in range(60)} | {"top.md": b"t", "a/.hidden": b"h", "a/_mark": b"m", "x.txt": b"x"}
    for path, content in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    want = {p: c for p, c in files.items() if p.endswith(".md")}
    folder.register(spark)
    plain = spark.read.format("papers_folder").option("suffix", ".md").load(str(tmp_path))
    assert {r.path: bytes(r.content) for r in plain.collect()} == want and plain.count() == len(want)
    parts = folder.Reader({"path": str(tmp_path)}).partitions()
    assert all(".md" not in str(vars(p)) for p in parts) and len(parts) == 7
    monkeypatch.setattr(folder.Reader, "partitions", None)
    back = folder.read(spark, f"file://{tmp_path}", suffix=".md", files=10)
    rows = back.collect()
    assert {r.path: bytes(r.content) for r in rows} == want and len(rows) == len(want) and back.rdd.getNumPartitions() == 7


def test_products_of_factors_for_docs_shuffle_nothing(spark, monkeypatch):
    """Partial sums for each doc and bucket of terms would be nearly as many as the entries."""
    from citeloom.operators import scratch

    monkeypatch.setattr(factors, "HUBS", 1)
    df = spark.createDataFrame([(f"d{i}", f"t{i * j % 17}", float(i + j)) for i in range(1, 30) for j in range(1, 9)], "doc string, term string, x double")
    with scratch.Tables(spark) as made:
        x = factors.Sparse(made, df)
        plan = x.times(x.ids("term").select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v")), "term", 2)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Broadcast" in plan


@pytest.mark.parametrize("hubs, held", [(1, 100), (1, 5), (60, 5), (60, 100), (1000, 5)])
def test_products_of_factors(spark, monkeypatch, hubs, held):
    """Both ways, with docs of very many entries and terms too rare to be broadcast, and with keys that come twice."""
    from citeloom.operators import scratch

    monkeypatch.setattr(factors, "HUBS", hubs)
    monkeypatch.setattr(factors, "HELD", held, raising=False)
    rows = [(f"d{i}", f"t{i * j % 17}", float(i + j)) for i in range(1, 30) for j in range(1, 3 + i)] + [("alone", "t18", 2.0), ("alone", "t19", 3.0), ("none", "t1", 1.0), ("none", "t1", -1.0)]
    with scratch.Tables(spark) as made:
        x = factors.Sparse(made, spark.createDataFrame(rows, "doc string, term string, x double"))
        for side, own, there in (("term", 1, 0), ("doc", 0, 1)):
            factor = x.ids(side).select("id", F.array(F.length("id").cast("double"), F.ascii(F.reverse("id")).cast("double")).alias("v"))
            want = {}
            for r in rows:
                v = np.array([len(r[own]), ord(r[own][-1])], float) * r[2]
                want[r[there]] = want.get(r[there], 0) + v
            want = {k: v for k, v in want.items() if k != "none"}
            got = {r.id: np.array(r.top) for r in x.times(factor, side, 2).collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("hubs", [1, 1000])
def test_sizes_of_factors_are_observed(spark, monkeypatch, hubs):
    """Numbers of entries, docs and terms come from the writes that make these, not from further passes."""
    from citeloom.operators import scratch

    asked, frame = [], type(spark.range(1))
    for name in ("count", "first", "isEmpty"):
        monkeypatch.setattr(frame, name, lambda self, name=name, plain=getattr(frame, name): (asked.append(name), plain(self))[1])
    monkeypatch.setattr(factors, "HUBS", hubs)
    rows = [("a", "t", 1.0), ("a", "t", 2.0), ("b", "t", 1.0), ("b", "u", -1.0), ("c", "u", 1.0), ("c", "u", -1.0), (None, "u", 2.0)]
    df = spark.createDataFrame(rows, "doc string, term string, x double")
    with scratch.Tables(spark) as made:
        x, none = factors.Sparse(made, df), factors.Sparse(made, df.where("x > 5"))
        factors._hashed_start(x, 2)
        assert not asked and (x.entries, x.sum, x.squares, x.size) == (4, 5.0, 15.0, {"doc": 3, "term": 2})
        assert (none.entries, none.sum, none.squares, none.size, none.hot) == (0, 0.0, 0.0, {"doc": 0, "term": 0}, None)
        assert (x.hot is not None) == (hubs > 1)


def test_a_turn_broadcasts_no_docs(spark, monkeypatch):
    """A factor has a row for each doc: it is neither broadcast nor shuffled, from its start on."""
    from citeloom.operators import scratch

    monkeypatch.setattr(factors, "HUBS", 1)
    df = spark.createDataFrame([(f"d{i}", f"t{i * j % 17}", float(i + j)) for i in range(1, 30) for j in range(1, 9)], "doc string, term string, x double")
    with scratch.Tables(spark) as made:
        x = factors.Sparse(made, df)
        w, h = factors._hashed_start(x, 2)
        plan = factors._descended(x, w, h, np.eye(2), "doc", 2)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan and "Exchange hashpartitioning(doc" not in plan


def test_kept_tables_stay(spark):
    from citeloom.operators import scratch

    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    with scratch.Tables(spark) as made:
        kept, gone = made.kept(made.bucketed(rows, "id").select("v")), made.bucketed(rows, "id")
        folder_, name = gone.inputFiles()[0].rpartition("/")[0], made.made[0][0]
        assert len(made.made) == 1 and made.kept(rows.where("false")).count() == 0
    assert sorted(r.v for r in kept.collect()) == list(range(0, 200, 2))
    assert not os.path.exists(folder_.removeprefix("file:")) and not spark.catalog.tableExists(name)


# --- the graph and its overview ------------------------------------------------------------------


def test_graph_is_hashed_and_joins_lines_once(spark, corpus, tmp_path):
    """Edges are made distinct once, by hashes; neighbouring lines are joined once for both directions."""
    made = catalogue._graph(corpus)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("l_linenumber:") == 2 and plan.count("HashAggregate") == 2
    # Lines that come twice, orders of negative and null numbers, a line without a part.
    lines = [(1, 1, 1), (1, 2, 2), (1, 2, 2), (1, 3, 1), (2, 1, 2), (2, 2, 2), (2, 3, 3), (-3, 1, 1), (-3, 2, 3), (-4, 1, 3), (-4, 2, 1), (None, 1, 1), (None, 2, 2), (5, 1, None), (5, 2, 1), (5, 4, 2)]
    spark.createDataFrame([(o, n, p, 4 + (p or 0) % 2 * 3) for o, n, p in lines], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").withColumn("l_shipdate", F.lit("1995-01-01").cast("date")).write.parquet(str(tmp_path / "lineitem.parquet"))
    corpus.table("part").where("p_partkey < 4").write.parquet(str(tmp_path / "part.parquet"))
    for c in (corpus, Corpus(spark, str(tmp_path))):
        now, old = catalogue._graph(c), graph.build(c.papers, c.references, c.citations_in, c.paper_author)
        assert now.count() and now.exceptAll(old).isEmpty() and old.exceptAll(now).isEmpty()
    papers_ = spark.createDataFrame([("p", "a"), ("q", None), ("r", "")], "paperId string, venue string")
    cited = spark.createDataFrame([("p", "q"), ("p", "q"), ("p", "a")], "paperId string, referencePaperId string")
    by = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", None)], "paperId string, authorId string")
    assert sorted(map(tuple, graph.build(papers_, cited, None, by).collect()), key=str) == sorted([("a", "p", "author"), ("q", "p", "cites"), (None, "q", "author")], key=str)


def test_overview_reads_the_graph_once(spark, tmp_path):
    from citeloom.operators import features

    rows = [("a1", "p1", "author"), ("v", "p1", "venue"), ("p1", "p2", "cites"), ("a1", "p2", "author"), ("p2", "p2", "cites"), ("x", "p1", "other"), ("y", "p1", None), (None, "p3", "author"), ("p4", None, "cites"), ("p1", "a1", "cites")]
    spark.createDataFrame(rows, "src string, dst string, etype string").write.parquet(str(tmp_path / "g"))
    papers_ = spark.createDataFrame([("p1", 0, " Yes"), ("p2", -1, "no"), ("p3", 1, None)], "paperId string, topic_id int, retracted string")
    told = features.overview(papers_, spark.read.parquet(str(tmp_path / "g")))
    kinds = {(s, "paper" if e == "cites" else e) for s, _, e in rows} | {(d, "paper") for _, d, _ in rows}
    assert told.first().asDict() == {"total_nodes": len({i for i, _ in kinds} - {None}), "paper_nodes": sum(k == "paper" for _, k in kinds), "author_nodes": sum(k == "author" for _, k in kinds), "total_edges": len(rows), "total_papers": 3, "total_topics": 2, "retracted_papers": 1}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan
    assert dict(told.dtypes) == dict.fromkeys(told.columns, "bigint")
    none = features.overview(papers_, spark.createDataFrame([], "src string, dst string, etype string")).first()
    assert (none.total_nodes, none.paper_nodes, none.author_nodes, none.total_edges) == (0, 0, 0, 0)


def test_bucketed_tables_have_a_file_for_each_bucket(spark):
    """However many tasks write one: else a round opens tasks times buckets files, and the rounds look numbers up without sorting edges."""
    from citeloom.operators import scratch

    with scratch.Tables(spark) as made:
        table = made.bucketed(spark.range(0, 1000, 1, 7).withColumn("here", F.col("id") % 50), "here", dealt=False)
        assert len(table.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and table.count() == 1000


def test_few_titles_are_compared_that_are_not_alike(spark, monkeypatch):
    """Titles of the same syllables share many pairs of letters; signatures, which never hide a pair that is alike, keep most of them apart."""
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "ing", "ed", "ha", "st", "en", "wh", "ou", "ti", "ea"]
    made = [" ".join("".join(rng.choices(syllables, k=3)) for _ in range(8))[:60] for _ in range(300)]
    a, b = made[:150], [*made[150:], *(t[:20] + t[21:] for t in made[:20])]
    for x, y in itertools.product(made[:40], repeat=2):
        for q in (1, 2):
            one, two = titles._elements(x, q), titles._elements(y, q)
            lacking = sum((s & ~z & (1 << 64) - 1).bit_count() for s, z in zip(titles._signature(one), titles._signature(two)))
            assert lacking <= len(set(one) - set(two))
    seen = []
    plain = titles._verified
    monkeypatch.setattr(titles, "_verified", lambda pairs, t, q: (seen.append(pairs.count()), plain(pairs, t, q))[1])
    df = lambda ts: spark.createDataFrame([(t,) for t in ts], "title string")
    found = lambda: sorted((r.a, r.b) for r in titles.alike(df(a), df(b)).collect())
    signed = found()
    monkeypatch.setattr(titles, "_signature", lambda xs: [0] * titles.LONGS)
    assert found() == signed and {x for x, _ in signed} >= set(made[:20])
    assert 2 * seen[0] < seen[1]


def test_items_and_papers_are_made_once(spark):
    """Titles that are parsed from files, say, cost a pass over these each time that they are made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parsed(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([(f"k{i}", f"title of the number {i}", None) for i in range(7)], "k string, title string, doi string").withColumn("title", parsed("title"))
    got = titles.match(rows.withColumnRenamed("k", "item"), rows.withColumnRenamed("k", "paperId")).collect()
    assert len(got) == 7 and all(r.item == r.match for r in got) and made.value == 14


@pytest.mark.parametrize("name", ["T15_join", "J14_join"])
def test_pages_are_parsed_once(spark, corpus, monkeypatch, name):
    made, plain = spark.sparkContext.accumulator(0), tables._page_titles

    @F.udf("string")
    def parsed(x):
        made.add(1)
        return x

    monkeypatch.setattr(tables, "_page_titles", lambda c: plain(c).withColumn("title", parsed("title")))
    assert catalogue.QUERIES[name](spark, SF).count() > 0 and made.value == corpus.table("pages").count()


def test_subsequences_are_as_long_as_a_table_says():
    rng = random.Random(11)
    texts = ["".join(rng.choices(abc, k=n)) for n in (1, 2, 30, 63, 64, 65, 127, 128, 129, 200) for abc in ("ab", "abcdefgh ", "é😀\0ab")]
    pairs = [(x, rng.choice(texts)) for x in texts for _ in range(6)] + [(x, x) for x in texts]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    assert titles.common(*map(list, zip(*pairs))).tolist() == [plain(a, b) for a, b in pairs]


def test_titles_of_several_chunks_meet_once_and_few_are_compared(spark, monkeypatch):
    """However the titles of a side are dealt, all pairs that are alike are found. Of all pairs, of the same syllables, less than one in twenty is compared."""
    rng = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "ing", "ed", "ha", "st", "en", "wh", "ou", "ti", "ea", "é", "😀"]
    made = [" ".join("".join(rng.choices(syllables, k=3)) for _ in range(40))[: rng.choice([20, 58, 59, 60, 61, 140, 260])].strip() for _ in range(200)]
    a, b = made[:100], [*made[100:], *(t[:9] + t[11:] for t in made[:60])]
    met, seen, plain, sizes = [], [], titles._verified, titles._meetings
    monkeypatch.setattr(titles, "_verified", lambda pairs, t, q: (seen.append(pairs.collect()), plain(pairs, t, q))[1])
    monkeypatch.setattr(titles, "_meetings", lambda *x: (met.append(sizes(*x)), met[-1])[1])
    want = plain_pairs(a, b, 0.85)
    assert found_pairs(spark, a, b, 0.85) == want and len(want) > 50
    monkeypatch.setattr(titles, "FEWEST", 5)
    monkeypatch.setattr(titles, "MOST", 12)
    assert found_pairs(spark, a, b, 0.85) == want
    monkeypatch.setattr(titles, "MOST", 1000)
    monkeypatch.setattr(titles, "CHARACTERS", 700)
    assert found_pairs(spark, a, b, 0.85) == want
    assert {n * m for *_, n, m in met[0]} == {1} and all(max(n * m for *_, n, m in x) > 9 for x in met[1:])
    assert all(len(x) == len(set(x)) and 20 * len(x) < len(a) * len(b) for x in seen)


# --- languages, stems, names ---------------------------------------------------------------------


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    known = languages.fit(docs.where("doc_id % 2 = 0"))
    told = docs.where("doc_id % 2 = 1 and length(text) >= 120").select("lang", languages.detect(F.col("text"), known, docs).alias("found")).collect()
    assert sum(r.lang == r.found for r in told) > 0.97 * len(told)
    odd = spark.createDataFrame([(t,) for t in (None, "", "12 !?", "これは日本語の文章です。今日は天気がいい。", "Det är en kall vinterdag i Stockholm och barnen leker i snön utanför skolan.", "wxyz qqq zzz kkk jjj xxx")], "t string")
    assert [r[0] for r in odd.select(languages.detect(F.col("t"), known, odd)).collect()] == [""] * 6
    nothing = languages.fit(docs.where("false"))
    assert [r[0] for r in odd.select(languages.detect(F.col("t"), nothing, odd)).collect()] == [""] * 6


def test_memory_of_languages_and_stems_follows_pieces(spark, monkeypatch):
    """However many texts a batch has, trigrams and words are held for a piece of it at a time."""
    import pyarrow as pa

    from citeloom.operators import batches

    texts = pa.array(["a long text " * 40_000, None, "", *["short text"] * 1000] * 9)
    lists = pa.array([["word"] * 60_000, None, [], ["a", None]] * 3, pa.list_(pa.string()))
    for values in (texts, lists, texts.slice(5), lists.slice(1)):
        found = list(batches.cuts(values, 1 << 17))
        assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == len(values)
        assert len(found) > 3
    sizes = []
    plain = languages._trigrams
    monkeypatch.setattr(languages, "_trigrams", lambda t: (sizes.append(sum(len(x or "") for x in t.to_pylist())), plain(t))[1])
    filled = pa.array([x or "" for x in texts.to_pylist()])
    known = languages.Profiles(["xx"], np.zeros(0, np.int64), np.zeros((1, 1)), np.full(1, -np.inf))

    class Sent:
        value = known

    docs = spark.createDataFrame([("x",)], "t string")
    made = []
    monkeypatch.setattr(languages.F, "arrow_udf", lambda kind: lambda f: (made.append(f), lambda c: c)[1])
    languages.detect(F.col("t"), known, docs)
    assert len(made[0](filled)) == len(filled)
    assert len(sizes) > 3 and max(sizes) <= batches.BYTES


#: Words and stems as published with the algorithm and its usual additions.
STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll flies fli dies die mules mule denied deni died die owned own humbled humbl meeting meet stating state siezing siez itemization item sensational sensat traditional tradit reference refer colonizer colon plotted plot dying die news news enjoy enjoy as as""".split()


def test_stems(spark):
    assert [languages.stem(w) for w in STEMS[::2]] == STEMS[1::2]
    df = spark.createDataFrame([(["cats", None, "cats"],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in df.select(languages.stems("w")).collect()] == [["cat", None, "cat"], None, []]


@pytest.mark.parametrize("a, b, want", [("this is a test", "this is a test!", 96.55), ("this is a test", "this is a new test!!!", 85.5), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0), ("fuzzy was a bear", "fuzzy fuzzy was a bear", 95.0), ("yankees", "new york yankees", 90.0), ("abcd", "abce", 75.0), ("", "x", 0.0), ("same", "same", 100.0)])
def test_weighted_ratios(a, b, want):
    assert round(names.weighted(a, b), 2) == want == round(names.weighted(b, a), 2)


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not b else (lambda old: (new := [0], [new.append(old[j] + 1 if x == y else max(old[j + 1], new[j])) for j, y in enumerate(b)], new)[-1])(row)
        assert names.common(a, b) == row[-1]


def test_nothing_possible_is_skipped():
    rng = random.Random(5)
    words = ["journal", "of", "steel", "steal", "review", "things", "a", "nature", "natura"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    for a, b in itertools.product(texts[:60], texts[60:]):
        if names.weighted(a, b) >= 90:
            assert names.possible(a, b, (Counter(a), Counter(b)), 90)


def test_nearest_names(spark):
    df = spark.createDataFrame([("nature physics",), ("physics nature",), ("natur physics",), ("",), (None,), ("zoology",)], "n string")
    assert [r[0] for r in df.select(names.nearest(F.col("n"), ["Nature", "Nature Physics"])).collect()] == ["Nature Physics"] * 3 + [None] * 3
    assert df.where(names.nearest(F.col("n"), []).isNotNull()).count() == 0


def test_misspelt_venues_are_in_the_query_of_names(spark):
    """T13 has the misspelt names of its first form beside the reordered and longer ones."""
    got = {r.name: r.n for r in catalogue.QUERIES["T13"](spark, "/root/testdata/sf0.001").groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"First Brand", "Steel Things Review", "Second Brandt", None}
