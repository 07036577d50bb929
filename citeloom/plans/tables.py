"""Queries whose operators need more than one pass over whole tables: title joins, files, models, centralities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import catalog, factors, features, graph, ingest, languages, names, records, scratch, temporal, text, titles, topics
from citeloom.operators import predicates as P
from citeloom.operators.corpus import Corpus
from citeloom.operators.text import title_key
from citeloom.plans.catalogue import _GRAPH, P_, PAPER, _graph, _number, _paper_query, query
from citeloom.plans.more import _SPLIT, _STAGING, _VALID, _WORDS, _staging, _unit, _works
from citeloom.sources import folder, markup, papers, works

# --- titles of one table against all of another --------------------------------------------------


def _page_titles(c: Corpus) -> DataFrame:
    return c.table("pages").select(F.col("page_id").alias("paperId"), papers.page("html")["title"].alias("title"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("10.1234/p."), F.col("page_id").cast("string"))).alias("doi"))


def _noted(c: Corpus, pages: DataFrame | None = None) -> DataFrame:
    """The pages' titles as somebody else wrote them down: as they are, with letters left out or doubled, with a subtitle, with two words changed over."""
    k, t = F.col("paperId"), F.col("title")
    words = F.split(t, " ")
    swapped = F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0)), F.array_join(F.slice(words, 3, 1000), " "))
    noted = F.when(k % 5 == 0, F.upper(t)).when(k % 5 == 1, F.regexp_replace(t, "^(..).(.*)(.)$", "$1$2$3$3")).when(k % 5 == 2, F.concat(t, F.lit(" - a note"))).when(k % 5 == 3, swapped).otherwise(F.lit(" "))
    return (_page_titles(c) if pages is None else pages).select(F.concat(F.lit("n"), k.cast("string")).alias("item"), noted.alias("title"), F.when(k % 10 == 0, F.concat(F.lit("https://doi.org/"), F.upper("doi"))).alias("doi"))


def _both_titles(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """What somebody noted, and the pages, which are parsed once."""
    pages = scratch.cut_lineage(_page_titles(c), "pages")
    return _noted(c, pages), pages


query("T15_join")(lambda c: titles.alike(*(x.select(title_key(F.col("title")).alias("title")) for x in _both_titles(c)), 0.85))
query("J14_join")(lambda c: titles.match(*_both_titles(c)))

# --- files ---------------------------------------------------------------------------------------

_XML = """, x AS (SELECT *, coalesce(cast(year AS varchar), '') AS y FROM papers)
"""


def _xml(c: Corpus) -> DataFrame:
    """A journal article of each paper: editors before authors, a year of history before that of publication, entities, CDATA; some malformed."""
    k, lit = _number(), F.lit
    person = "<contrib contrib-type='{}'><name><surname>{}</surname>{}</name></contrib>"
    people = F.when(k % 5 == 0, person.format("editor", "Itor", "<given-names>Ed</given-names>")).when(k % 5 == 1, "<author><surname>Old</surname><given-names>Way</given-names></author>").otherwise(
        person.format("editor", "Itor", "") + person.format("author", "Lee", "<given-names>Ann</given-names>") + person.format("author", "Li &amp; S&#246;n", ""))
    head = F.when(k % 3 == 0, "<?xml version=\"1.0\" encoding=\"UTF-8\"?><article xmlns=\"http://jats.example/ns\">").otherwise("<article>")
    return c.papers.select("paperId", F.concat(
        head, lit("<journal-meta><journal-title>"), "venue", lit("</journal-title></journal-meta><article-id pub-id-type='pmid'>1</article-id><article-id pub-id-type=\"doi\"> "), "doi", lit(" </article-id><article-title>"), "title",
        lit(" <italic>&lt;&#233;&gt;</italic></article-title><contrib-group>"), people, lit("</contrib-group><history><date><year>1700</year></date></history><pub-date><month>1</month><year>"), F.coalesce(F.col("year").cast("string"), lit("")),
        lit("</year></pub-date><abstract><p>On "), "topic", lit("</p>\n  <p><![CDATA[a < b]]></p></abstract>"), F.when(k % 13 != 0, "</article>").otherwise("</articl")).alias("x"))


query("S16", _XML + """SELECT "paperId", CASE WHEN good THEN concat(title, ' <é>') END AS title, CASE WHEN good THEN CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Way Old' ELSE 'Ann Lee|Li & Sön' END ELSE '' END AS authors, CASE WHEN good THEN concat('On ', topic, ' a < b') END AS abstract,
 CASE WHEN good THEN CASE WHEN y = '' THEN '1700' ELSE y END END AS year, CASE WHEN good THEN nullif(doi, '') END AS doi, CASE WHEN good THEN nullif(venue, '') END AS venue FROM (SELECT *, k % 13 <> 0 AS good FROM x)""")(
    lambda c: _xml(c).select("paperId", papers.article("x").alias("m")).select("paperId", "m.*").withColumn("authors", F.array_join("authors", "|")))


def _tei_files(c: Corpus) -> DataFrame:
    """A TEI header of each paper with a cited work's author and date after its own; some in no namespace, which say nothing."""
    k, lit = _number(), F.lit
    name = lambda a, b: f"<author><persName><forename type=\"first\">{a}</forename><surname>{b}</surname></persName></author>"
    authors = F.when(k % 4 == 0, name("Ann", "Lee")).when(k % 4 == 1, name("Ann", "Lee") + name("Bo", "Li")).when(k % 4 == 2, name("Ann", "Lee") + "<author>Group X</author>" + name("", "Li")).otherwise("")
    own = F.when(k % 3 == 0, "<title level=\"m\">Volume</title><title level=\"j\">Journal &amp; Co</title>").when(k % 3 == 1, "<title level=\"m\">Volume</title>").otherwise("")
    date = F.when(k % 2 == 0, F.concat(lit("<date type=\"published\" when=\""), F.col("year").cast("string"), lit("-05\"/>"))).otherwise(F.concat(lit("<date>May "), F.col("year").cast("string"), lit("</date>")))
    cited = "<text><listBibl><biblStruct><author><persName><forename>Ci</forename><surname>Ted</surname></persName></author><date when=\"1901\"/></biblStruct></listBibl></text>"
    return c.papers.select("paperId", F.concat(
        F.when(k % 7 == 0, "<TEI>").otherwise("<TEI xmlns=\"http://www.tei-c.org/ns/1.0\">"), lit("<teiHeader><fileDesc><titleStmt><title level=\"a\">"), "title", lit("</title></titleStmt><publicationStmt><publisher>House</publisher>"), F.coalesce(date, lit("")),
        lit("</publicationStmt><sourceDesc><biblStruct><analytic>"), authors, lit("<idno type=\"MD5\">0</idno><idno type=\"DOI\">"), "doi", lit("</idno></analytic><monogr>"), own, lit("</monogr></biblStruct></sourceDesc></fileDesc></teiHeader>"), lit(cited), lit("</TEI>")).alias("x"))


query("S20", """SELECT "paperId", CASE WHEN k % 7 <> 0 THEN title END AS title, CASE WHEN k % 7 <> 0 THEN CASE k % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Ann Lee and Bo Li' WHEN 2 THEN 'Ann Lee, Group X and Li' END END AS authors,
 CASE WHEN k % 7 <> 0 THEN coalesce(cast(year AS varchar), '1901') END AS year, CASE WHEN k % 7 <> 0 THEN nullif(doi, '') END AS doi, CASE WHEN k % 7 <> 0 THEN CASE k % 3 WHEN 0 THEN 'Journal & Co' WHEN 1 THEN 'Volume' ELSE 'House' END END AS venue FROM papers""")(
    lambda c: _tei_files(c).select("paperId", papers.tei("x").alias("m")).select("paperId", "m.title", papers.author_line(F.col("m.authors")).alias("authors"), "m.year", "m.doi", "m.venue"))


def _tagged(c: Corpus) -> DataFrame:
    """The pages, some of them with citation tags (attributes in either order) or a marked abstract, some without their title."""
    k, html = F.col("page_id"), F.col("html")
    tags = F.concat(F.lit("<META content='T &amp; &quot;"), k.cast("string"), F.lit("&quot;' name=citation_title><meta name=\"citation_author\" content=\"Lee, Ann\"/><meta content=\" Li &amp; Co \" name=\"citation_author\"><meta name=\"citation_doi\" content=\"10.1/"), k.cast("string"), F.lit("\"><meta name=\"citation_publication_date\" content=\"2001/02\"><meta name='citation_journal_title' content=Nature><meta name=\"citation_title\" content=\"second\">"))
    told = F.when(k % 3 == 0, F.regexp_replace(html, "<title>", F.concat(tags, F.lit("<title>")))).when(k % 3 == 1, F.regexp_replace(html, "<body>", "<body><section class=\"wide abstract\">no</section><div id=abstract><h2>On</h2> <p>a &lt; b<script>x()</script></p>\n<!-- c --></div>")).otherwise(F.regexp_replace(html, "(?s)<title>.*?</title>", ""))
    return c.table("pages").select("page_id", F.coalesce(told, F.lit("")).alias("html"))


_TITLE = "trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '\"'), '&amp;?', '&', 'g'))"
_H1 = "trim(regexp_replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '\"'), '&amp;?', '&', 'g'))"
query("S15", f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('T & "', page_id, '"') WHEN 1 THEN nullif({_TITLE}, '') ELSE nullif({_H1}, '') END AS title, CASE WHEN page_id % 3 = 0 THEN 'Lee, Ann|Li & Co' ELSE '' END AS authors, CASE WHEN page_id % 3 = 1 THEN 'On a < b' END AS abstract,
 CASE WHEN page_id % 3 = 0 THEN '2001/02' END AS year, CASE WHEN page_id % 3 = 0 THEN concat('10.1/', page_id) END AS doi, CASE WHEN page_id % 3 = 0 THEN 'Nature' END AS venue FROM pages""")(
    lambda c: _tagged(c).select("page_id", papers.page(papers.ended(F.col("html"))).alias("m")).select("page_id", "m.*").withColumn("authors", F.array_join("authors", "|")))


def _packages(c: Corpus) -> DataFrame:
    """A package of each document: its whole text is the abstract; authors after a word, below one, or in the second line."""
    k, lit = F.col("doc_id"), F.lit
    said = F.trim(F.regexp_replace(F.coalesce("text", lit("")), "[\\x00-\\x20\\x7F-\\u00A0]+", " "))
    who = F.when(k % 3 == 0, F.array(lit("Authors: Ann Lee; Bo Li and Cy Wu"))).when(k % 3 == 1, F.array(lit("AUTHORS"), lit("Ann Lee, Bo Li"))).otherwise(F.array(lit("Ann Lee AND Bo Li")))
    rest = F.array(lit("Abstract"), said, F.concat(lit("Year: "), (1990 + k % 30).cast("string")), F.concat(lit("see 10.5555/d."), k.cast("string")))
    return c.table("documents").select(F.concat((k % 7).cast("string"), lit("/"), k.cast("string"), F.when(k % 2 == 0, ".docx").otherwise("")).alias("path"), papers.packed(F.concat(F.array(F.concat(lit(" Doc "), k.cast("string")), lit(" ")), who, rest)).alias("content"))


def _written(c: Corpus, files: DataFrame, tag: str, dealt: bool = False) -> DataFrame:
    path = scratch.new_path(c.spark, tag)
    folder.write(files, path, dealt=dealt)
    return folder.read(c.spark, path, bytes=1 << 20)


_SAID = "trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x20\\x7F-\\xA0]+', ' ', 'g'))"
query("S18", f"""SELECT doc_id, concat('Doc ', doc_id) AS title, CASE doc_id % 3 WHEN 0 THEN 'Ann Lee|Bo Li|Cy Wu' ELSE 'Ann Lee|Bo Li' END AS authors, md5(CASE WHEN {_SAID} = '' THEN concat('Year: ', 1990 + doc_id % 30) ELSE {_SAID} END) AS abstract, cast(1990 + doc_id % 30 AS varchar) AS year, concat('10.5555/d.', doc_id) AS doi FROM documents""")(
    lambda c: folder.metadata(_written(c, _packages(c), "packages", dealt=True)).where("kind = 'docx'").select(F.regexp_extract("path", "/(\\d+)", 1).cast("bigint").alias("doc_id"), "title", F.array_join("authors", "|").alias("authors"), F.md5("abstract").alias("abstract"), "year", "doi"))


def _notes(c: Corpus) -> DataFrame:
    """path and note of each paper with an abstract."""
    told = features.author_names(c.papers, c.paper_author, c.authors).where(_number() % 4 != 0)
    named = {"paper_id": F.col("paperId"), "title": F.col("title"), "doi": F.nullif("doi", F.lit("")), "venue": F.nullif("venue", F.lit("")), "year": F.col("year"), "abstract": F.concat(F.lit("on \"it\": "), "title"), "authors": F.col("authors_display"), "is_seed": F.col("isSeed"), "is_selected": F.col("selected"), "processed": F.col("processed")}
    body = [F.concat(F.lit("*Authors:* "), F.nullif(F.array_join("authors_display", ", "), F.lit(""))), F.concat(F.lit("*Venue:* "), F.nullif("venue", F.lit(""))), F.lit("## Abstract"), F.concat(F.lit("on \"it\": "), "title"), F.lit("## Notes")]
    return told.select(F.concat(F.lit("papers/"), "paperId", F.lit(".md")).alias("path"), folder.note_text(named, F.col("title"), body).alias("note"))


_NOTE = """, who AS (SELECT "paperId", list(DISTINCT "authorName" ORDER BY "authorName") AS a FROM pa JOIN authors USING ("authorId") GROUP BY 1), noted AS (SELECT papers.*, coalesce(a, []) AS a FROM papers LEFT JOIN who USING ("paperId") WHERE k % 4 <> 0)
"""
query("K6", _NOTE + """SELECT concat('papers/', "paperId", '.md') AS path, concat('---', chr(10), 'paper_id: "', "paperId", '"', chr(10), 'title: "', title, '"', chr(10), 'doi: ', coalesce('"' || nullif(doi, '') || '"', 'null'), chr(10), 'venue: ', coalesce('"' || nullif(venue, '') || '"', 'null'), chr(10), 'year: ', coalesce(cast(year AS varchar), 'null'), chr(10),
 'abstract: "on \\"it\\": ', title, '"', chr(10), 'authors: [', array_to_string(list_transform(a, lambda x: concat('"', x, '"')), ','), ']', chr(10), 'is_seed: ', "isSeed", chr(10), 'is_selected: ', selected, chr(10), 'processed: ', processed, chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10),
 CASE WHEN len(a) > 0 THEN concat('*Authors:* ', array_to_string(a, ', '), chr(10), chr(10)) ELSE '' END, CASE WHEN venue <> '' THEN concat('*Venue:* ', venue, chr(10), chr(10)) ELSE '' END, '## Abstract', chr(10), chr(10), 'on "it": ', title, chr(10), chr(10), '## Notes', chr(10)) AS note FROM noted""")(
    lambda c: _written(c, _notes(c).select("path", F.encode("note", "UTF-8").alias("content")), "notes").select("path", folder.text_of("content").alias("note")))


def _library(c: Corpus) -> DataFrame:
    """Notes as other programs write them (lists over several lines, quotes, long values over two lines, remarks), notes without fields, and other files."""
    k, lit = _number(), F.lit
    front = F.when(k % 5 == 0, F.format_string("---\npaper_id: %s\ntitle: '%s''s\n  second line'\nauthors:\n- Ann Lee\n- \"Bo: Li\"\n  the elder\nyear: %d # of print\nnested:\n  a: 1\n---\nbody: no\n", "paperId", "title", "year")).when(k % 5 == 1, F.format_string("---\r\npaper_id: \"%s\"\r\ntitle: %s\r\nauthors: [Ann Lee, 'Bo, Li']\r\nyear: %d\r\n---\r\n", "paperId", "title", "year")).when(k % 5 == 2, F.format_string("# %s\n---\nyear: %d\n---\n", "title", "year")).when(k % 5 == 3, "---\nno end: 1\n")
    files = c.papers.select(F.concat((k % 3).cast("string"), lit("/"), "paperId", F.when(k % 5 == 4, ".txt").otherwise(".md")).alias("path"), F.encode(F.coalesce(front, lit("---\npaper_id: x\n---\n")), "UTF-8").alias("content"))
    return folder.library(_written(c, files, "library"))


query("S6", """SELECT "paperId", CASE WHEN k % 5 = 0 THEN concat(title, '''s second line') ELSE title END AS title, CASE WHEN k % 5 = 0 THEN 'Ann Lee|"Bo: Li" the elder' ELSE 'Ann Lee|Bo, Li' END AS authors, cast(year AS varchar) AS year FROM papers WHERE k % 5 < 2""")(
    lambda c: _library(c).select(F.col("fields")["paper_id"].alias("paperId"), F.col("fields")["title"].alias("title"), F.array_join(F.col("lists")["authors"], "|").alias("authors"), F.col("fields")["year"].alias("year")))
_HEADS = ["%PDF-1.7 ", "\n<!DOCTYPE HTML><html>", "<?xml version='1.0'?><article>", "<?xml version='1.0'?>\n<TEI xmlns='x'>", "% c\n\\documentclass{a}", "---\ntitle: x\n---", "plain", "PK zip"]
query("S21_bytes", """SELECT "paperId", CASE k % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'xml' WHEN 3 THEN 'tei' WHEN 4 THEN 'latex' WHEN 5 THEN 'note' ELSE CASE k % 4 WHEN 0 THEN 'latex' WHEN 1 THEN 'docx' WHEN 2 THEN 'xml' ELSE 'unknown' END END AS kind FROM papers""")(
    lambda c: c.papers.select("paperId", papers.kind_of_bytes(F.encode(F.concat(F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (_number() % 8 + 1).cast("int")), "title"), "UTF-8"), F.concat(F.lit("a/b"), F.element_at(F.array(*[F.lit(x) for x in (".tex", ".DOCX", ".nxml", ".pdf")]), (_number() % 4 + 1).cast("int")))).alias("kind")))

# --- centralities and what reads them ------------------------------------------------------------

#: Rounds that the SQL writes out; it gives nulls where a direction needs more.
_ROUNDS = 14


def _centralities_sql() -> str:
    sql = _GRAPH + ", e AS (SELECT DISTINCT src, dst FROM g), nn AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)), x0 AS (SELECT id, 1.0::double / n AS i, 1.0::double / n AS o FROM (SELECT src AS id FROM e UNION SELECT dst FROM e), nn)"
    for k in range(_ROUNDS):
        sql += f", y{k} AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT * FROM x{k} UNION ALL SELECT dst, i, 0 FROM e JOIN x{k} ON id = src UNION ALL SELECT src, 0, o FROM e JOIN x{k} ON id = dst) GROUP BY 1), z{k} AS (SELECT sqrt(sum(i * i)) AS i, sqrt(sum(o * o)) AS o FROM y{k}), x{k + 1} AS (SELECT y.id, y.i / z.i AS i, y.o / z.o AS o FROM y{k} y, z{k} z)"
    moved = " UNION ALL ".join(f"SELECT {k + 1} AS k, sum(abs(a.i - b.i)) AS i, sum(abs(a.o - b.o)) AS o FROM x{k + 1} a JOIN x{k} b USING (id)" for k in range(_ROUNDS))
    every = " UNION ALL ".join(f"SELECT {k + 1} AS k, * FROM x{k + 1}" for k in range(_ROUNDS))
    return sql + f""", mv AS ({moved}), last AS (SELECT min(k) FILTER (mv.i < n * 1e-6) AS ki, min(k) FILTER (mv.o < n * 1e-6) AS ko FROM mv, nn),
cen AS (SELECT id, max(CASE WHEN k = ki THEN i END) AS centrality_in, max(CASE WHEN k = ko THEN o END) AS centrality_out FROM ({every}), last GROUP BY 1)
"""


_CEN = _centralities_sql()
_both = lambda: [F.round(c, 6).alias(c) for c in ("centrality_in", "centrality_out")]
_BOTH = "round(centrality_in, 6) AS centrality_in, round(centrality_out, 6) AS centrality_out"
_central = lambda c: graph.centralities(_graph(c))

query("G4", _CEN + f"SELECT id, {_BOTH} FROM cen")(lambda c: _central(c).select("id", *_both()))
query("G5", _CEN + f"""SELECT id, {_BOTH} FROM cen WHERE id IN (SELECT "authorId" FROM authors)""")(lambda c: topics.of_type(_central(c), c.authors.select(F.col("authorId").alias("id"), F.lit("author").alias("ntype")), "author").select("id", *_both()))

# --- models of titles and abstracts --------------------------------------------------------------

_K, _TURNS = 3, 3


def _nmf_sql(turns: int) -> str:
    """Coordinate descent from the hashed start, written out: x is the table of weights, w_n and h_n the factors after n rounds."""
    first = lambda key, j: f"CAST(concat('0x', substr(md5(concat({key}, '|{j}')), 1, 8)) AS bigint) / 4294967296.0::double * sc + 0.1 * sc"
    sql = f""", tw AS (SELECT "paperId" AS doc, unnest(regexp_extract_all(lower(title), '\\b\\w\\w+\\b')) AS term FROM papers), tf AS (SELECT doc, term, count(*) AS n FROM tw GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
tx AS (SELECT doc, term, n * (ln((1.0 + (SELECT count(*) FROM papers)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), x AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS x FROM tx),
sl AS (SELECT sqrt(sum(x) / (count(DISTINCT doc) * count(DISTINCT term)) / {_K}) AS sc FROM x), w_0 AS (SELECT doc, {', '.join(f"{first('doc', j)} AS w{j}" for j in range(_K))} FROM (SELECT DISTINCT doc FROM x), sl), h_0 AS (SELECT term, {', '.join(f"{first('term', j)} AS h{j}" for j in range(_K))} FROM (SELECT DISTINCT term FROM x), sl)"""

    def turn(new: str, own: str, other: str, key: str, at: str, a: str, b: str) -> str:
        gram = ", ".join(f"sum({b}{i} * {b}{j}) AS g{i}{j}" for i in range(_K) for j in range(_K))
        out = f", g{new} AS (SELECT {gram} FROM {other}), t{new} AS (SELECT {key}, {', '.join(f'sum(x * {b}{j}) AS t{j}' for j in range(_K))} FROM x JOIN {other} USING ({at}) GROUP BY 1), s{new}_0 AS (SELECT * FROM {own} JOIN t{new} USING ({key}), g{new})"
        for j in range(_K):
            slope = " + ".join(f"g{j}{i} * {a}{i}" for i in range(_K))
            out += f", s{new}_{j + 1} AS (SELECT * REPLACE (CASE WHEN g{j}{j} = 0 THEN {a}{j} ELSE greatest(0.0, {a}{j} - ({slope} - t{j}) / g{j}{j}) END AS {a}{j}) FROM s{new}_{j})"
        return out + f", {new} AS (SELECT {key}, {', '.join(f'{a}{j}' for j in range(_K))} FROM s{new}_{_K})"

    for r in range(turns):
        sql += turn(f"w_{r + 1}", f"w_{r}", f"h_{r}", "doc", "term", "w", "h") + turn(f"h_{r + 1}", f"h_{r}", f"w_{r + 1}", "term", "doc", "h", "w")
    return sql


_NMF = _nmf_sql(_TURNS) + f""", hl AS (SELECT term, unnest([{', '.join(f"{{'topic': {j}, 'weight': h{j}}}" for j in range(_K))}], recursive := true) FROM h_{_TURNS}), tops AS (SELECT topic, cast(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS int) AS place, term, weight FROM hl WHERE weight > 0 QUALIFY place <= 8),
tp AS (SELECT doc AS "paperId", cast(CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS int) AS topic FROM w_{_TURNS}), topical AS (SELECT p.*, cast(CASE WHEN k % 4 <> 0 THEN coalesce(topic_, -1) ELSE -1 END AS int) AS topic_id FROM papers p LEFT JOIN (SELECT "paperId", topic AS topic_ FROM tp) USING ("paperId"))
"""


def _counts(made: scratch.Tables, rows: DataFrame, words: str, key: str) -> DataFrame:
    """The counts of terms by key, bucketed: texts are dealt out, not their terms, and whatever is asked by key needs no shuffle."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return made.bucketed(text.terms(dealt, words, key), key)


def _title_model(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """The factors of all papers' titles; a few rounds from a start that SQL can write, too."""
    with scratch.Tables(c.spark) as made:
        counts = _counts(made, c.papers.select("paperId", "title"), "title", "paperId")
        return factors.nmf(text.tf_idf(counts, "paperId", c.papers.count()), _K, rounds=_TURNS, tol=0.0, start="hash", key="paperId")[:2]


def _assigned(w: DataFrame) -> DataFrame:
    """The topics of papers with an abstract."""
    return factors.largest(w).select(F.col("doc").alias("paperId"), "topic").where(_number() % 4 != 0)


def _catalog(c: Corpus) -> DataFrame:
    """The final catalog: topics of a model, centralities of the graph."""
    return topics.catalog(c.papers, _assigned(_title_model(c)[0]), _central(c))


query("T6", _NMF + f"SELECT doc, topic, round(w0, 5) AS w0, round(w1, 5) AS w1, round(w2, 5) AS w2 FROM w_{_TURNS} JOIN tp ON tp.\"paperId\" = doc")(
    lambda c: (w := _title_model(c)[0]).join(factors.largest(w), "doc").select("doc", "topic", *[F.round(F.col("w")[j], 5).alias(f"w{j}") for j in range(_K)]))
query("T24", _NMF + "SELECT topic, place, term, round(weight, 6) AS weight FROM tops")(lambda c: factors.top_terms(_title_model(c)[1], 8).select("topic", "place", "term", F.round("weight", 6).alias("weight")))
query("T8", _NMF + 'SELECT "paperId", topic_id FROM topical')(lambda c: topics.topic_column(c.papers, _assigned(_title_model(c)[0])).select("paperId", "topic_id"))
query("T10", _NMF + 'SELECT topic_id, count(*) AS papers, min("paperId") AS first_paper FROM topical GROUP BY 1')(lambda c: topics.grouped(topics.topic_column(c.papers, _assigned(_title_model(c)[0]))))


def _labelled(c: Corpus) -> DataFrame:
    """Each topic's label: the concepts of its papers for the first topic, the model's heaviest terms for the second, else a number."""
    w, h = _title_model(c)
    rows = topics.topic_column(c.papers, _assigned(w)).select(F.col("topic_id").alias("grp"), F.array(F.struct(F.col("venue").alias("name"), F.lit(2).alias("level")), F.struct(F.lit("wide").alias("name"), F.lit(1).alias("level"))).alias("concepts"))
    words = factors.top_terms(h, 8).select(F.col("topic").alias("grp"), "place", F.col("term").alias("name"))
    return topics.labels(rows, "grp", [topics.concepts(rows.where("grp = 0"), "grp"), words.where("grp = 1")])


query("T9", _NMF + """, cn AS (SELECT venue AS name, count(*) AS n FROM topical WHERE topic_id = 0 AND venue <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 2) SELECT DISTINCT topic_id AS grp, CASE topic_id WHEN 0 THEN (SELECT string_agg(name, ' & ' ORDER BY n DESC, name) FROM cn) WHEN 1 THEN (SELECT string_agg(term, ' & ' ORDER BY place) FROM tops WHERE topic = 1 AND place <= 2) ELSE concat('Cluster_', topic_id) END AS label FROM topical""")(_labelled)

_LANGUAGE = f""", vd AS (SELECT doc_id, text, lang, {_VALID} AS valid, concat(' ', trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')), ' ') AS l FROM documents), gr AS (SELECT doc_id, substr(l, i, 3) AS g, count(*) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM vd) GROUP BY 1, 2),
gc AS (SELECT lang, g, sum(n) AS n FROM gr JOIN vd USING (doc_id) WHERE lang IS NOT NULL AND doc_id % 2 = 0 GROUP BY 1, 2), al AS (SELECT lang, sum(n) AS n FROM gc GROUP BY 1), gt AS (SELECT g FROM gc GROUP BY 1 ORDER BY sum(n) DESC, g LIMIT {languages.GRAMS}), gn AS (SELECT count(*) AS size FROM gt),
lp AS (SELECT al.lang, gt.g, ln((coalesce(gc.n, 0) + 1.0::double) / (al.n + size + 1)) AS p FROM al CROSS JOIN gt CROSS JOIN gn LEFT JOIN gc ON gc.lang = al.lang AND gc.g = gt.g), lo AS (SELECT al.lang, ln((al.n - coalesce(sum(gc.n) FILTER (gt.g IS NOT NULL), 0) + 1.0::double) / (any_value(al.n) + any_value(size) + 1)) AS p FROM al CROSS JOIN gn LEFT JOIN gc ON gc.lang = al.lang LEFT JOIN gt ON gt.g = gc.g GROUP BY al.lang, al.n),
sc AS (SELECT doc_id, lo.lang, sum(n * coalesce(lp.p, lo.p)) / sum(n) AS s FROM gr CROSS JOIN lo LEFT JOIN lp ON lp.lang = lo.lang AND lp.g = gr.g GROUP BY 1, 2), fl AS (SELECT sc.lang, avg(s) - {languages.WIDE} * greatest(stddev_pop(s), 1e-9) AS floor FROM sc JOIN vd ON vd.doc_id = sc.doc_id AND vd.lang = sc.lang WHERE vd.doc_id % 2 = 0 GROUP BY 1),
be AS (SELECT doc_id, lang, s FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1), lg AS (SELECT vd.doc_id, vd.text, valid, CASE WHEN s >= floor THEN be.lang ELSE '' END AS lang FROM vd LEFT JOIN be USING (doc_id) LEFT JOIN fl ON fl.lang = be.lang)
"""


def _judged(c: Corpus) -> DataFrame:
    """The documents with their validity and language; the profiles are those of every second one."""
    docs = c.table("documents")
    profiles = languages.fit(docs.where("doc_id % 2 = 0").select("text", "lang"))
    return docs.select("doc_id", "text", text.valid(F.col("text")).alias("valid"), languages.detect(F.col("text"), profiles, docs).alias("lang"))


query("T3", _LANGUAGE + "SELECT doc_id, lang FROM lg WHERE valid")(lambda c: _judged(c).where("valid").select("doc_id", "lang"))
query("T4", _LANGUAGE + f"SELECT doc_id, len(list_filter({_WORDS}, lambda w: w <> ''))::int AS n, md5(array_to_string(list_filter({_WORDS}, lambda w: w <> ''), ' ')) AS words FROM lg WHERE valid AND lang = 'en'")(lambda c: topics.in_language(_judged(c), "en").select("doc_id", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("words")))
query("T4_stem")(lambda c: topics.in_language(_judged(c), "en", stemmed=True).select("doc_id", F.array_join("words", " ").alias("words")))
query("T5", """, w AS (SELECT "paperId" AS p, list_filter(regexp_extract_all(lower(title), '\\b\\w\\w+\\b'), lambda x: x NOT IN ('red', 'survey', 'hot')) AS w FROM papers), tm AS (SELECT p, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM w), tf AS (SELECT p, term, count(*) AS n FROM tm GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 x AS (SELECT p, term, n * (ln((1.0 + (SELECT count(*) FROM papers)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT p AS "paperId", term, round(w / sqrt(sum(w * w) OVER (PARTITION BY p)), 6) AS weight FROM x""")(
    lambda c: text.tf_idf(text.terms(c.papers, "title", "paperId", ["red", "survey", "hot"], 2), "paperId", c.papers.count()).select("paperId", "term", F.round("weight", 6).alias("weight")))


def _abstract_topics(c: Corpus) -> DataFrame:
    """Twenty topics of the stems of all valid English documents, after a few rounds from the singular vectors."""
    words = topics.in_language(_judged(c), "en", stemmed=True).select("doc_id", F.array_join("words", " ").alias("stems"))
    with scratch.Tables(c.spark) as made:
        counts = _counts(made, words, "stems", "doc_id")
        n = counts.agg(F.countDistinct("doc_id")).first()[0]
        w, _, _ = factors.nmf(text.tf_idf(counts, "doc_id", n), 20, rounds=8, tol=1e-2, key="doc_id")
    return w.join(factors.largest(w), "doc").select(F.col("doc").alias("doc_id"), "topic", F.round(F.array_max("w"), 6).alias("weight"))


query("T6_svd")(_abstract_topics)
query("T7")(lambda c: topics.lda(topics.in_language(_judged(c), "en"), 4)[0])

# --- the catalog's centralities and topics -------------------------------------------------------

_CAT = _CEN + _NMF + """, ct AS (SELECT topical.*, centrality_in, centrality_out FROM topical JOIN cen ON id = "paperId")
"""
query("J3", _CAT + f'SELECT "paperId", year, topic_id, {_BOTH} FROM ct')(lambda c: _catalog(c).select("paperId", "year", "topic_id", *_both()))
_STATS = "count(*) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, round(min({0}), 6) AS low, round(median({0}), 6) AS middle, round(max({0}), 6) AS high"
query("A22", _CEN + " UNION ALL ".join(f"""SELECT '{x}' AS "column", {_STATS.format(x)} FROM cen""" for x in ("centrality_in", "centrality_out")))(
    lambda c: topics.described(_central(c), ["centrality_in", "centrality_out"]).select("column", "n", *[F.round(x, 6).alias(x) for x in ("mean", "std", "low", "middle", "high")]))
query("O2", _CEN + """SELECT "paperId" FROM papers JOIN cen ON id = "paperId" ORDER BY round(centrality_out, 9) DESC, "paperId" LIMIT 20""")(
    lambda c: (df := c.papers.join(_central(c).withColumnRenamed("id", "paperId"), "paperId")).orderBy(F.desc(F.round(topics.default_sort(df.columns), 9)), "paperId").limit(20).select("paperId"))
query("O6", _CEN + """SELECT "paperId", round(centrality_in, 6) AS score FROM papers LEFT JOIN cen ON id = "paperId" ORDER BY round(centrality_in, 9) DESC NULLS LAST, "paperId" LIMIT 50""")(
    lambda c: c.papers.join(_central(c).withColumnRenamed("id", "paperId"), "paperId", "left").orderBy(F.desc_nulls_last(F.round("centrality_in", 9)), "paperId").limit(50).select("paperId", F.round("centrality_in", 6).alias("score")))


def _report(c: Corpus) -> DataFrame:
    """Papers not selected yet: the ten with the most important references, and the ten that are most influential."""
    rows = c.papers.where("not selected").join(_central(c).withColumnRenamed("id", "paperId"), "paperId")
    part = lambda by: rows.orderBy(F.desc(F.round(by, 9)), "paperId").limit(10).select(F.lit(by).alias("section"), "paperId", *_both())
    return part("centrality_in").unionByName(part("centrality_out"))


query("O9", _CEN + " UNION ALL ".join(f"""SELECT * FROM (SELECT '{x}' AS section, "paperId", {_BOTH} FROM papers JOIN cen ON id = "paperId" WHERE NOT selected ORDER BY round(cen.{x}, 9) DESC, "paperId" LIMIT 10)""" for x in ("centrality_in", "centrality_out")))(_report)
query("O10", _CEN + """SELECT "paperId", round(centrality_out, 6) AS centrality_out FROM papers JOIN cen ON id = "paperId" WHERE "isSeed\"""")(lambda c: c.papers.where("isSeed").join(_central(c).withColumnRenamed("id", "paperId"), "paperId").orderBy(F.desc("centrality_out")).select("paperId", F.round("centrality_out", 6).alias("centrality_out")))
query("A8", _CEN + """SELECT "authorId", count(*) AS papers, cast(coalesce(sum(n) FILTER (id IS NOT NULL), 0) AS bigint) AS citations, round(avg(centrality_in), 6) AS centrality FROM pa LEFT JOIN (SELECT "paperId", id, centrality_in, n FROM papers JOIN cen ON id = "paperId" LEFT JOIN cc USING ("paperId")) USING ("paperId") GROUP BY 1 HAVING count(id) > 0 ORDER BY round(avg(centrality_in), 9) DESC, "authorId" LIMIT 50""")(
    lambda c: features.top_authors(c.papers.join(_central(c).withColumnRenamed("id", "paperId"), "paperId"), c.edges, c.paper_author).withColumn("centrality", F.round("centrality", 6)))
_FLAG = "CASE WHEN k % 4 <> 0 THEN k % 3 = 0 END"
query("K1", _CAT + f'SELECT "paperId", topic_id, {_BOTH}, coalesce({_FLAG}, false) AS retracted FROM ct')(
    lambda c: markup.write_catalog(_catalog(c).select("paperId", "topic_id", *_both(), F.when(_number() % 4 != 0, _number() % 3 == 0).alias("retracted")), scratch.new_path(c.spark, "catalog"), ["retracted"]))
query("S1", _CAT + f'SELECT "paperId", topic_id, {_BOTH} FROM ct')(lambda c: (p := scratch.new_path(c.spark, "catalog"), rows := markup.write_catalog(_catalog(c).select("paperId", "topic_id", *_both()), p, []), works.frame(c.spark, p, rows.schema))[2])
query("A9", _NMF + """SELECT topic_id, count(*) AS papers, (SELECT string_agg(term, ' ' ORDER BY place) FROM tops WHERE topic = topic_id AND place <= 5) AS topic_label FROM topical WHERE topic_id >= 0 GROUP BY 1""")(
    lambda c: (m := _title_model(c), features.topic_overview(topics.topic_column(c.papers, _assigned(m[0])), factors.top_terms(m[1], 8)))[1])
query("A9_links", _NMF + """SELECT topic_id, "paperId", doi, concat('https://works.example/', "paperId") AS url FROM topical WHERE topic_id >= 0""")(lambda c: features.topic_links(topics.topic_column(c.papers, _assigned(_title_model(c)[0])), "https://works.example/"))
query("D4", _NMF + """, en AS (SELECT year, topic_id, n FROM (SELECT year, topic_id, count(*) AS n FROM topical WHERE topic_id >= 0 AND year IS NOT NULL GROUP BY 1, 2)), ps AS (SELECT year, count(*) AS size, count(*) FILTER (topic_id >= 0) AS labelled FROM topical WHERE year IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
 SELECT cast(ps.year AS varchar) AS period, cast(t.topic_id AS varchar) AS topic, round(coalesce(n, 0) / labelled, 6)::double AS share FROM ps CROSS JOIN (SELECT DISTINCT topic_id FROM topical WHERE topic_id >= 0) t LEFT JOIN en ON en.year = ps.year AND en.topic_id = t.topic_id""")(lambda c: _evolution(c))


def _evolution(c: Corpus) -> DataFrame:
    """The model's topics by year; papers without one count for the size of a period, but have no share."""
    rows = topics.topic_column(c.papers, _assigned(_title_model(c)[0])).withColumn("topic", F.when(F.col("topic_id") >= 0, F.col("topic_id").cast("string")))
    rows = scratch.cut_lineage(rows.select("paperId", "year", "topic"), "topical")
    return temporal.evolution(rows, temporal.fixed_periods(rows, 1)).select("period", "topic", F.round("share", 6).alias("share"))


query("A7", _GRAPH + _NMF + """SELECT (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)) AS total_nodes, (SELECT count(*) FROM (SELECT dst FROM g UNION SELECT src FROM g WHERE etype = 'cites')) AS paper_nodes, (SELECT count(DISTINCT src) FROM g WHERE etype = 'author') AS author_nodes, (SELECT count(*) FROM g) AS total_edges,
 count(*) AS total_papers, count(DISTINCT topic_id) FILTER (topic_id >= 0) AS total_topics, count(*) FILTER (k % 6 < 2) AS retracted_papers FROM topical""")(
    lambda c: features.overview(topics.topic_column(c.papers, _assigned(_title_model(c)[0])).withColumn("isRetracted", F.when(_number() % 6 == 0, " Yes").when(_number() % 6 == 1, "TRUE").when(_number() % 6 == 2, "no")), _graph(c)))


def _drawn(c: Corpus) -> DataFrame:
    """A sampling round: the graph and its centralities, the frontier, what passes, weights and the draw."""
    central = _central(c).select(F.col("id").alias("paperId"), F.col("centrality_in").alias("c_in"), F.col("centrality_out").alias("c_out"))
    forbidden = ingest.forbidden(ingest.retraction_hits(c.papers, c.retractions), True, True)
    return graph.sampling_round(c.papers, forbidden, central, P.keywords(F.col("title"), ["survey"]), P.venue_allowed(F.col("venue"), ["Brand#11"]), decay=0.01, age_decay=0.1, as_of_year=2000, k=20, seed=5).select("paperId", "selected")


query("X6", _CEN + _SPLIT + f""", ok AS (SELECT * FROM sp WHERE venue <> '' AND venue <> 'Brand#11'), low AS (SELECT 1e-5 / (count(*) + 1) AS c FROM ok), w AS (SELECT "paperId", exp(-0.1 * (2000 - year)) * greatest(coalesce(centrality_in, c), coalesce(centrality_out, c)) AS w FROM ok LEFT JOIN cen ON id = "paperId", low), wd AS (SELECT "paperId", CASE WHEN w > 0 THEN w ELSE 1e-50 END AS w FROM w),
 dr AS (SELECT "paperId" FROM wd ORDER BY -ln({_unit(5)}) / (w / (SELECT sum(w) FROM wd)), "paperId" LIMIT 20) SELECT "paperId", selected OR "paperId" IN (SELECT "paperId" FROM dr) AS selected FROM papers""")(_drawn)

# --- details of records, filters and files -------------------------------------------------------

query("T13", """SELECT "paperId", CASE k % 10 WHEN 0 THEN 'First Brand' WHEN 1 THEN 'Steel Things Review' WHEN 2 THEN 'First Brand' WHEN 3 THEN 'Steel Things Review' WHEN 4 THEN 'First Brand' WHEN 7 THEN 'First Brand' WHEN 8 THEN 'Second Brandt' WHEN 9 THEN 'First Brand' END AS name FROM papers""")(
    lambda c: c.papers.select("paperId", names.nearest(F.element_at(F.array(*[F.lit(x) for x in ("brand first", "stel things review", "journal of first brand studies", "review things steel things", "brand", "", "quite another name", "first brnd", "second brand", "frist brand")]), (_number() % 10 + 1).cast("int")), ["First Brand", "Steel Things Review", "Proceedings of Nothing", "Second Brandt"]).alias("name")))
query("I33", """SELECT "paperId", doi, CASE WHEN venue <> '' THEN venue WHEN k % 22 = 0 THEN 'Host' ELSE topic END AS venue, CASE WHEN venue <> '' AND k % 2 = 0 THEN concat('S', k % 10) WHEN k % 22 = 0 THEN 'S77' END AS venue_id, year, title, concat('N', k % 5, '|B|C|D') AS authors, concat('again ', "paperId", ' again') AS abstract, 2 AS n_topics FROM papers""")(
    lambda c: records.paper_of(_works(c)).withColumn("authors", F.array_join("authors", "|")))
_paper_query("P7", "regexp_matches(lower(venue), 'brand#[12]3') AND regexp_matches(lower(doi), '^10\\.5555/(small|econ)')", lambda df: catalog.CatalogQuery(venue=" Brand#[12]3 ", doi_search="^10\\.5555/(SMALL|econ)").where(df), marked=True)


def _routed(c: Corpus) -> DataFrame:
    df = catalog.with_marks(features.author_names(c.papers, c.paper_author, c.authors), c.marks)
    return df.where(catalog.CatalogQuery(rules=["title::contains::e", "year::ge::1992", "identifier::contains::.1", "authors::not_contains::002 || Supplier", "gone::contains::x", "broken"]).where(df)).select(*PAPER)


query("P16", f"""SELECT {P_} FROM papers LEFT JOIN (SELECT "paperId", string_agg(DISTINCT "authorName", ' || ' ORDER BY "authorName") AS a FROM pa JOIN authors USING ("authorId") GROUP BY 1) USING ("paperId") WHERE contains(lower(title), 'e') AND year >= 1992 AND contains(lower(doi), '.1') AND NOT contains(lower(coalesce(a, '')), '002 || supplier')""")(_routed)
_FRAMES = {"papers": ("papers", lambda c: c.papers), "authors": ("authors", lambda c: c.authors), "citations": ("cites", lambda c: c.citations_in), "references": ("refs", lambda c: c.references), "paper_author": ("pa", lambda c: c.paper_author), "marks": ("marks", lambda c: c.marks)}


def _shapes(c: Corpus) -> DataFrame:
    out = None
    for name, (_, frame) in _FRAMES.items():
        df = frame(c)
        one = df.agg(F.lit(name).alias("frame"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), (F.count_if("processed") if "processed" in df.columns else F.lit(None).cast("bigint")).alias("processed"))
        out = one if out is None else out.unionByName(one)
    return out


query("I22", " UNION ALL ".join(f"SELECT '{n}' AS frame, count(*) AS rows, {columns} AS columns, {'count(*) FILTER (WHERE processed)' if n == 'papers' else 'NULL::bigint'} AS processed FROM {t}" for (n, (t, _)), columns in zip(_FRAMES.items(), (9, 2, 2, 2, 2, 2))))(_shapes)
query("I28", """SELECT "paperId", round(((trim(title) <> '')::int + (coalesce(a, 0) > 0)::int + (k % 4 <> 0)::int + (year IS NOT NULL)::int + (trim(doi) <> '')::int + (trim(venue) <> '')::int) / 6.0, 6)::double AS completeness FROM papers LEFT JOIN (SELECT "paperId", count(*) AS a FROM pa JOIN authors USING ("authorId") GROUP BY 1) USING ("paperId")""")(
    lambda c: (df := features.author_names(c.papers, c.paper_author, c.authors).withColumn("abstract", F.when(_number() % 4 != 0, F.col("title")).otherwise(" "))).select("paperId", F.round(ingest.completeness(df, ["title", "authors_display", "abstract", "year", "doi", "venue"]), 6).alias("completeness")))
query("S14", """, al AS (SELECT "paperId", string_agg(DISTINCT "authorName", '|' ORDER BY "authorName") AS a FROM pa JOIN authors USING ("authorId") GROUP BY 1) SELECT "paperId", title, 'Ann Lee' || coalesce('|' || a, '') AS authors, year, doi, topic AS tags, venue AS publication, 'journalArticle' AS kind FROM papers LEFT JOIN al USING ("paperId")""")(
    lambda c: _items(c).select("paperId", markup.library_item(F.col("item")).alias("m")).select("paperId", "m.title", F.array_join("m.authors", "|").alias("authors"), "m.year", "m.doi", F.array_join("m.tags", "|").alias("tags"), "m.publication", "m.kind"))


def _items(c: Corpus) -> DataFrame:
    """Each paper as a reference manager's item in JSON: an editor, an institution and its own authors among the creators."""
    people = features.author_names(c.papers, c.paper_author, c.authors)
    fixed = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("creatorType", "firstName", "lastName", "name"), r)]) for r in (("author", " Ann", "Lee ", ""), ("editor", "Ed", "Itor", ""), ("author", "", "", "Group"), ("author", "Only", "", ""))]
    own = F.transform("authors_display", lambda n: F.struct(F.lit("author").alias("creatorType"), F.lit("").alias("firstName"), n.alias("lastName"), F.lit("").alias("name")))
    return people.select("paperId", F.to_json(F.struct("title", F.col("doi").alias("DOI"), F.concat(F.lit("May 3, "), F.col("year").cast("string")).alias("date"), F.col("venue").alias("publicationTitle"), F.lit("journalArticle").alias("itemType"), F.concat(F.array(*fixed), own).alias("creators"), F.array(F.struct(F.col("topic").alias("tag"))).alias("tags"))).alias("item"))


query("A14", _STAGING + """, f AS (SELECT unnest([{'facet': 'title', 'value': trim(title)}, {'facet': 'authors', 'value': trim(authors)}, {'facet': 'venue', 'value': trim(venue)}, {'facet': 'year', 'value': cast(year AS varchar)}, {'facet': 'identifier', 'value': 'doi::' || nullif(trim(doi), '')}, {'facet': 'identifier', 'value': 'url::' || nullif(trim(url), '')}], recursive := true) FROM st),
 fc AS (SELECT facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY 1, 2) SELECT * FROM fc UNION ALL SELECT 'venue', 'Gamma', 0 UNION ALL SELECT 'identifier', 'url::none', 0""")(
    lambda c: catalog.facet_options(catalog.staging_facets(_staging(c)), [("venue", "Gamma"), ("identifier", "url::none"), ("venue", "Brand#12")], cap=None))
query("A21", _STAGING + """SELECT count(*) AS total, count(*) FILTER (WHERE year IS NULL OR year >= 1993) AS filtered, count(*) FILTER (WHERE is_selected) AS selected, count(*) FILTER (WHERE is_retracted) AS retracted FROM st""")(
    lambda c: (df := _staging(c)).agg(F.count("*").alias("total"), F.count_if(records.StagingFilter(year_min=1993).column(dict(df.dtypes))).alias("filtered"), F.count_if("is_selected").alias("selected"), F.count_if("is_retracted").alias("retracted")))
query("A20", """SELECT (SELECT count(*) FROM papers WHERE k % 5 <> 0 OR k % 3 = 0) AS papers_collected, (SELECT count(*) FROM papers WHERE "isSeed" AND (k % 5 <> 0 OR k % 3 = 0)) AS seed_papers, (SELECT count(*) FROM papers WHERE k % 5 = 0 AND k % 3 = 0) AS papers_added, (SELECT count(*) FROM cites) AS citations_collected, (SELECT count(*) FROM refs) AS references_collected""")(
    lambda c: features.progress(c.papers.where(_number() % 5 != 0), c.papers.where(_number() % 3 == 0), c.citations_in, c.references, scratch.new_path(c.spark, "iteration")))
_LINES = """, ok AS (SELECT "paperId", lower(trim(venue)) AS v, md5(lower(trim(venue))) AS vid FROM papers WHERE lower(trim(venue)) NOT IN ('', 'none', 'na')), nm AS (SELECT DISTINCT "paperId", "authorId", "authorName" FROM pa JOIN authors USING ("authorId") JOIN papers USING ("paperId")),
ct AS (SELECT "paperId" AS s, "referencePaperId" AS e FROM refs UNION ALL SELECT "citingPaperId", "paperId" FROM cites), rl AS (SELECT 'PUBLISHED_BY' AS label, "paperId" AS s, vid AS e, 'venue' AS kind FROM ok UNION ALL SELECT 'AUTHORED_BY', "paperId", "authorId", 'author' FROM nm UNION ALL SELECT 'CITE', s, e, 'paper' FROM ct WHERE s IN (SELECT "paperId" FROM papers) AND e IN (SELECT "paperId" FROM papers))
SELECT concat('{"type":"node","id":"', "paperId", '","labels":["paper"],"properties":{"title":["', title, '"]', coalesce(',"year":' || year, ''), ',"processed":', processed, '}}') AS value FROM papers UNION ALL SELECT DISTINCT concat('{"type":"node","id":"', vid, '","labels":["venue"],"properties":{"venue":"', v, '"}}') FROM ok
 UNION ALL SELECT DISTINCT concat('{"type":"node","id":"', "authorId", '","labels":["author"],"properties":{"name":"', "authorName", '"}}') FROM nm
 UNION ALL SELECT concat('{"type":"relationship","id":"', row_number() OVER (ORDER BY label, s, e) - 1, '","label":"', label, '","start":{"id":"', s, '","labels":["paper"]},"end":{"id":"', e, '","labels":["', kind, '"]}}') FROM rl"""
_property_graph = lambda c: graph.property_graph(c.papers, c.references, c.citations_in, c.paper_author, c.authors)
query("G6", _LINES)(_property_graph)
query("K4", _LINES)(lambda c: (p := scratch.new_path(c.spark, "graph"), _property_graph(c).write.text(p), c.spark.read.text(p))[2])
query("S3", """SELECT 'papers' AS frame, count(*) AS n, count(*) FILTER (WHERE processed) AS processed FROM papers UNION ALL SELECT 'missing', 0, 0""")(lambda c: _checkpoint(c))


def _checkpoint(c: Corpus) -> DataFrame:
    """The frames of a checkpoint that was written, and one that it doesn't have."""
    path = scratch.new_path(c.spark, "checkpoint")
    markup.write_checkpoint({"papers": c.papers}, path)
    part = lambda name: works.frame(c.spark, f"{path}/{name}", c.papers.schema).agg(F.lit(name).alias("frame"), F.count("*").alias("n"), F.count_if("processed").alias("processed"))
    return part("papers").unionByName(part("missing"))


def _asked(c: Corpus) -> DataFrame:
    """Expressions made of the papers' words; one in two doesn't parse."""
    a, b, k = F.get(F.split("title", " "), F.lit(0)), F.get(F.split("title", " "), F.lit(1)), _number()
    said = F.when(k % 6 == 0, F.concat(a, F.lit(" AND NOT ("), b, F.lit(")"))).when(k % 6 == 1, F.concat(F.lit("("), a, F.lit(" OR "), b)).when(k % 6 == 2, "  ").when(k % 6 == 3, F.concat(F.lit("(("), a, F.lit(") OR "), b, F.lit(")"))).when(k % 6 == 4, F.concat(a, F.lit("))(("), b)).otherwise(a)
    return c.papers.select("paperId", said.alias("expression"))


query("P5", """SELECT "paperId", k % 6 IN (0, 3, 5) AS valid FROM papers""")(lambda c: _asked(c).select("paperId", P.balanced(F.col("expression")).alias("valid")))
query("P17", """SELECT "paperId", CASE WHEN k % 4 = 1 THEN 'year' ELSE 'title' END AS name, CASE WHEN k % 4 = 1 THEN 'between' ELSE 'contains' END AS rule, CASE WHEN k % 4 = 1 THEN cast(year AS varchar) ELSE title END AS value, CASE WHEN k % 4 = 1 THEN '2000' END AS value_to FROM papers WHERE k % 4 < 2""")(
    lambda c: c.papers.select("paperId", P.rules_of(F.when(_number() % 4 == 0, F.concat(F.lit("title::contains:: "), "title")).when(_number() % 4 == 1, F.concat(F.lit(" year :: between :: "), F.col("year").cast("string"), F.lit(" :: 2000"))).when(_number() % 4 == 2, F.concat("title", F.lit("::b"))).otherwise(F.concat(F.lit("::"), "title", F.lit("::y")))).alias("r")).where("r is not null").select("paperId", "r.*"))
query("D3", """SELECT DISTINCT a AS start_year, b AS end_year, CASE WHEN a = b THEN cast(a AS varchar) ELSE concat(a, '-', b) END AS label FROM (SELECT year(min(o_orderdate)) + o_custkey % 3 AS a, year(max(o_orderdate)) - o_custkey % 4 AS b FROM orders GROUP BY o_custkey) WHERE a <= b""")(
    lambda c: temporal.custom_periods_of(c.table("orders").groupBy("o_custkey").agg((F.year(F.min("o_orderdate")) + F.col("o_custkey") % 3).alias("start_year"), (F.year(F.max("o_orderdate")) - F.col("o_custkey") % 4).alias("end_year"))))
