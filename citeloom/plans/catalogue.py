"""The queries of the reference's own operators and their SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import ids
from citeloom.operators import catalog, editing, features, graph, ingest, temporal, text
from citeloom.operators import predicates as P
from citeloom.operators.corpus import Corpus
from citeloom.sources import works

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The corpus in SQL; each query's own part follows.
VIEWS = """WITH first_year AS (SELECT l_partkey, min(year(l_shipdate)) y FROM lineitem GROUP BY 1),
papers AS (SELECT concat('W', cast(p_partkey AS varchar)) AS "paperId", CASE WHEN p_partkey % 5 <> 0 THEN concat('10.5555/', lower(p_type), '.', cast(p_partkey AS varchar)) ELSE '' END AS doi,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS venue, cast(y AS int) AS year,
  concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' survey' WHEN 1 THEN ' benchmark' WHEN 2 THEN ' review' ELSE '' END) AS title,
  p_partkey % 3 = 0 AS processed, p_partkey % 97 = 0 AS "isSeed", p_partkey % 7 = 0 AS selected, p_type AS topic, p_partkey AS k FROM part LEFT JOIN first_year ON l_partkey = p_partkey),
pairs AS (SELECT DISTINCT concat('W', a.l_partkey) AS citing, concat('W', b.l_partkey) AS cited, a.l_orderkey % 2 AS side FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
refs AS (SELECT citing AS "paperId", cited AS "referencePaperId" FROM pairs WHERE side = 0), cites AS (SELECT cited AS "paperId", citing AS "citingPaperId" FROM pairs WHERE side = 1),
edges AS (SELECT citing AS "paperId", cited AS "referencePaperId" FROM pairs),
pa AS (SELECT DISTINCT concat('W', l_partkey) AS "paperId", concat('A', l_suppkey) AS "authorId" FROM lineitem WHERE l_suppkey % 4 = l_partkey % 4),
authors AS (SELECT concat('A', s_suppkey) AS "authorId", s_name AS "authorName" FROM supplier),
marks AS (SELECT "paperId", CASE k % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE 'neutral' END AS mark FROM papers WHERE k % 4 <> 3),
marked AS (SELECT papers.*, coalesce(mark, 'standard') AS mark FROM papers LEFT JOIN marks USING ("paperId")),
retr AS (SELECT concat('10.9999/r.', k) AS a, lower(doi) AS b, concat('reason ', k % 3) AS reason FROM papers WHERE k % 53 = 0 AND doi <> ''),
cc AS (SELECT "paperId", count(*) AS n FROM edges GROUP BY 1)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, root: f(Corpus(spark, root))
        if sql is not None:
            SQL[name] = VIEWS + sql
        return f

    return add


P_ = '"paperId", title, venue, year, doi'
PAPER = ["paperId", "title", "venue", "year", "doi"]

# --- features ------------------------------------------------------------------------------------

query("A1", """SELECT pa."authorId", count(*) AS num_papers, cast(sum(coalesce(n, 0)) AS bigint) AS num_citations, max(coalesce(n, 0)) AS max_citations, count(DISTINCT pa."paperId") AS num_coauthors,
 coalesce(min(year), 0) AS year_first_publication, coalesce(max(year), 0) AS year_last_publication, round(sum(coalesce(n, 0)) / (count(*) + 1e-8), 6) AS avg_citations, coalesce(any_value(mates), 0) AS num_distinct_coauthors
 FROM pa LEFT JOIN cc USING ("paperId") LEFT JOIN papers USING ("paperId") LEFT JOIN (SELECT x."authorId", count(DISTINCT y."authorId") AS mates FROM pa x JOIN pa y ON x."paperId" = y."paperId" AND x."authorId" <> y."authorId" GROUP BY 1) m ON m."authorId" = pa."authorId" GROUP BY pa."authorId\"""")(lambda c: features.author_features(c.papers, c.edges, c.paper_author))
query("A2", """SELECT papers."paperId", coalesce(cc.n, 0) AS citation_count, coalesce(i.n, 0) AS in_citations, coalesce(a.n, 0) AS num_authors FROM papers LEFT JOIN cc USING ("paperId")
 LEFT JOIN (SELECT "referencePaperId" AS p, count(DISTINCT "paperId") AS n FROM edges GROUP BY 1) i ON i.p = papers."paperId" LEFT JOIN (SELECT "paperId" AS p, count(*) AS n FROM pa GROUP BY 1) a ON a.p = papers."paperId\"""")(lambda c: features.paper_features(c.papers, c.edges, c.paper_author))
_VENUES = """, ev AS (SELECT x.venue AS a, y.venue AS b FROM edges e LEFT JOIN papers x ON x."paperId" = e."paperId" LEFT JOIN papers y ON y."paperId" = e."referencePaperId"),
vf AS (SELECT venue, cast(sum(p) AS bigint) AS total_papers, cast(sum(s) AS bigint) AS self_citations, cast(sum(c) AS bigint) AS citing_others, cast(sum(o) AS bigint) AS being_cited_by_others FROM (
 SELECT venue, 1 AS p, 0 AS s, 0 AS c, 0 AS o FROM papers UNION ALL SELECT a, 0, CASE WHEN a IS NOT DISTINCT FROM b THEN 1 ELSE 0 END, 0, CASE WHEN a IS DISTINCT FROM b THEN 1 ELSE 0 END FROM ev UNION ALL SELECT b, 0, 0, CASE WHEN a IS DISTINCT FROM b THEN 1 ELSE 0 END, 0 FROM ev) WHERE venue IS NOT NULL GROUP BY 1)
"""
query("A3", _VENUES + "SELECT * FROM vf")(lambda c: features.venue_features(c.papers, c.edges))
query("A4", """SELECT "paperId", contains(lower(title), 'review') AS tc_review, contains(lower(title), 'survey') AS tc_survey, contains(lower(title), 'tutorial') AS tc_tutorial, contains(lower(title), 'benchmark') AS tc_benchmark, contains(lower(title), 'dataset') AS tc_dataset, CASE WHEN lower(venue) IN ('arxiv','hal','ssrn') THEN 1 ELSE 0 END AS is_preprint FROM papers""")(lambda c: features.title_flags(c.papers))
query("A5", _VENUES.replace("FROM edges e LEFT JOIN papers x", "FROM edges e LEFT JOIN np x").replace("LEFT JOIN papers y", "LEFT JOIN np y").replace("FROM papers UNION", "FROM np UNION").replace(", ev AS", """, np AS (SELECT "paperId", CASE WHEN lower(venue) NOT IN ('brand#11', 'brand#12') THEN venue END AS venue FROM papers), ev AS""", 1) + "SELECT * FROM vf")(lambda c: features.venue_features(c.papers, c.edges, ["brand#11", "brand#12"]))
query("A6", "SELECT year, count(*) AS papers FROM papers WHERE year IS NOT NULL GROUP BY 1")(lambda c: features.year_histogram(c.papers))
query("O7", _VENUES + """, t AS (SELECT * FROM (SELECT venue, 0 AS place, total_papers AS v FROM vf ORDER BY v DESC, venue LIMIT 5) UNION ALL SELECT * FROM (SELECT venue, 1, self_citations AS v FROM vf ORDER BY v DESC, venue LIMIT 5) UNION ALL SELECT * FROM (SELECT venue, 2, citing_others AS v FROM vf ORDER BY v DESC, venue LIMIT 5) UNION ALL SELECT * FROM (SELECT venue, 3, being_cited_by_others AS v FROM vf ORDER BY v DESC, venue LIMIT 5))
 SELECT venue, cast(min(place) AS int) AS place FROM t GROUP BY 1""")(lambda c: features.top_by_measures(features.venue_features(c.papers, c.edges), "venue", ["total_papers", "self_citations", "citing_others", "being_cited_by_others"]))
query("J1", """SELECT x.venue AS citing_venue, y.venue AS cited_venue, count(*) AS n FROM edges e LEFT JOIN papers x ON x."paperId" = e."paperId" LEFT JOIN papers y ON y."paperId" = e."referencePaperId" GROUP BY 1, 2""")(lambda c: features.edge_venues(c.papers, c.edges).groupBy("citing_venue", "cited_venue").agg(F.count("*").alias("n")))
query("J4", """SELECT papers."paperId", coalesce(string_agg(DISTINCT "authorName", '|' ORDER BY "authorName"), '') AS authors FROM papers LEFT JOIN pa USING ("paperId") LEFT JOIN authors USING ("authorId") GROUP BY 1""")(lambda c: features.author_names(c.papers, c.paper_author, c.authors).select("paperId", F.array_join("authors_display", "|").alias("authors")))

# --- predicates ----------------------------------------------------------------------------------


def _paper_query(name: str, where: str, column, marked: bool = False):
    def run(c: Corpus) -> DataFrame:
        df = catalog.with_marks(c.papers, c.marks) if marked else c.papers
        return df.where(column(df)).select(*PAPER)

    query(name, f"SELECT {P_} FROM {'marked' if marked else 'papers'} WHERE {where}")(run)


_paper_query("P1", "contains(lower(title), 'survey') OR contains(lower(title), 'steel')", lambda df: P.keywords(F.col("title"), ["Survey", "steel"]))
_paper_query("P2", "(contains(lower(title), 'survey') OR contains(lower(title), 'review')) AND contains(lower(title), 'red')", lambda df: P.Expression("survey OR review AND red").compile(F.col("title")))
_paper_query("P3", "(NOT contains(lower(title), 'survey') AND contains(lower(title), 'blue')) OR contains(lower(title), 'benchmark')", lambda df: P.any_expression(F.col("title"), ["NOT survey AND blue", "benchmark"]))
_paper_query("P4", "contains(lower(title), 'steel') OR (contains(lower(title), 'review') AND NOT contains(lower(title), 'a'))", lambda df: P.keywords(F.col("title"), ["steel"]) | P.any_expression(F.col("title"), ["review AND NOT a"]))
_paper_query("P6", """contains(lower(title), '12') OR contains(lower("paperId"), '12')""", lambda df: P.literal_search([F.col("title"), F.col("paperId")], "12"))
_paper_query("P8", "year BETWEEN 1993 AND 1995", lambda df: P.year_range(F.col("year"), 1993, 1995))
_paper_query("P9", "trim(doi) <> ''", lambda df: ids.presence(F.col("doi")))
_paper_query("P12", "mark IN ('good', 'standard')", lambda df: P.mark_filter(F.col("mark"), ["good", "standard"]), marked=True)
_paper_query("P14", "NOT ends_with(lower(trim(title)), 'survey') AND starts_with(lower(trim(venue)), 'brand#1')", lambda df: P.text_rule(F.col("title"), "not_ends_with", "survey") & P.text_rule(F.col("venue"), "begins_with", "Brand#1"))
_paper_query("P15", "year IS NOT NULL AND NOT (year BETWEEN 1992 AND 1993)", lambda df: P.number_rule(F.col("year"), "not_between", 1993, 1992))
_paper_query("P21", """regexp_full_match("paperId", 'W[0-9]+')""", lambda df: P.paper_id_valid(F.col("paperId")))
_paper_query("P22", "venue <> '' AND venue NOT IN ('Brand#11')", lambda df: P.venue_allowed(F.col("venue"), ["Brand#11"]))
_paper_query("P23", "trim(venue) <> ''", lambda df: P.meaningful_venue(F.col("venue")))

# --- catalog, facets, pages ----------------------------------------------------------------------

_Q = catalog.CatalogQuery(search="1", year_min=1992, doi="with", marks=["good", "bad", "standard"], sort="year", page=2, page_size=30)
query("O1", """SELECT "paperId", title, venue, year, doi, mark FROM marked WHERE (contains(lower(title), '1') OR contains(lower("paperId"), '1')) AND year >= 1992 AND trim(doi) <> '' AND mark IN ('good', 'bad', 'standard') ORDER BY year DESC NULLS FIRST, "paperId" LIMIT 30 OFFSET 30""")(lambda c: catalog.page(catalog.select(c.papers, c.marks, _Q), _Q).select(*PAPER, "mark"))
query("O3", """SELECT "paperId", doi FROM papers ORDER BY trim(doi) = '', lower(doi) DESC, "paperId" LIMIT 100 OFFSET 100""")(lambda c: catalog.staging_page(c.papers, "doi", True, 2, 100, "paperId").select("paperId", "doi"))
_FACETS = """, f AS (SELECT 'title' AS facet, trim(title) AS value FROM papers UNION ALL SELECT 'venue', trim(venue) FROM papers UNION ALL SELECT 'year', cast(year AS varchar) FROM papers UNION ALL SELECT 'authors', "authorName" FROM (SELECT DISTINCT "paperId", "authorName" FROM papers JOIN pa USING ("paperId") JOIN authors USING ("authorId")) UNION ALL SELECT 'identifier', concat('doi::', doi) FROM papers WHERE trim(doi) <> ''),
fc AS (SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2)
"""
query("A13", _FACETS + "SELECT * FROM fc")(lambda c: catalog.paper_facets(features.author_names(c.papers, c.paper_author, c.authors)))
query("A10", _FACETS + "SELECT value, n FROM fc WHERE facet = 'venue' AND regexp_matches(lower(value), '#2')")(lambda c: catalog.facets(c.papers, {"venue": F.array("venue")}).where(F.lower("value").rlike("#2")).select("value", "n"))
query("A11", _FACETS + "SELECT value, n FROM fc WHERE facet = 'authors'")(lambda c: catalog.facets(features.author_names(c.papers, c.paper_author, c.authors), {"authors": F.col("authors_display")}).select("value", "n"))
query("A12", _FACETS + "SELECT value, n FROM fc WHERE facet = 'identifier'")(lambda c: catalog.facets(c.papers, {"identifier": F.array(F.when(F.trim("doi") != "", F.concat(F.lit("doi::"), "doi")))}).select("value", "n"))
query("O11", _FACETS + "SELECT value, n FROM fc WHERE facet = 'venue' ORDER BY n DESC, value LIMIT 10 OFFSET 5")(lambda c: catalog.facets(c.papers, {"venue": F.array("venue")}).select("value", "n").orderBy(F.desc("n"), "value").offset(5).limit(10))
query("J5", """SELECT mark, count(*) AS n FROM marked GROUP BY 1""")(lambda c: catalog.with_marks(c.papers, c.marks).groupBy("mark").agg(F.count("*").alias("n")))
query("J11", """SELECT "paperId", CAST(CASE "paperId" WHEN 'W9' THEN 0 WHEN 'W3' THEN 1 ELSE 2 END AS int) AS position FROM papers WHERE "paperId" IN ('W9', 'W3', 'W100')""")(lambda c: catalog.in_order(c.papers, ["W9", "W3", "W9", "W100"]).select("paperId", "position"))
query("S2", f"""SELECT {P_} FROM papers WHERE "paperId" = 'W42'""")(lambda c: c.papers.where("paperId = 'W42'").limit(1).select(*PAPER))
# --- ingest, retraction, sets --------------------------------------------------------------------


def _upserted(c: Corpus) -> DataFrame:
    new = c.papers.where("year = 1996").withColumns({"title": F.concat("title", F.lit(" v2")), "processed": F.lit(False), "selected": F.lit(False), "isSeed": F.lit(False)})
    return ingest.upsert(c.papers, new)


query("I1", f"SELECT {P_} FROM papers WHERE title IS NOT NULL")(lambda c: ingest.valid_papers(c.papers).select(*PAPER))
query("I4", """SELECT "paperId", CASE WHEN year = 1996 THEN concat(title, ' v2') ELSE title END AS title, processed, "isSeed", selected FROM papers""")(lambda c: _upserted(c).select("paperId", "title", "processed", "isSeed", "selected"))
_GONE = """, gone AS (SELECT "paperId" FROM papers WHERE k % 13 = 0), r2 AS (SELECT * FROM refs WHERE "paperId" NOT IN (SELECT * FROM gone) AND "referencePaperId" NOT IN (SELECT * FROM gone)), c2 AS (SELECT * FROM cites WHERE "paperId" NOT IN (SELECT * FROM gone) AND "citingPaperId" NOT IN (SELECT * FROM gone)),
p2 AS (SELECT * FROM papers WHERE "paperId" NOT IN (SELECT * FROM gone) AND "paperId" IN (SELECT "paperId" FROM r2 UNION SELECT "referencePaperId" FROM r2 UNION SELECT "paperId" FROM c2 UNION SELECT "citingPaperId" FROM c2))
"""


def _cascade(c: Corpus) -> dict[str, DataFrame]:
    gone = c.papers.where(F.col("paperId").substr(F.lit(2), F.lit(20)).cast("long") % 13 == 0)
    return ingest.cascade(c.papers, c.references, c.citations_in, c.paper_author, c.authors, gone)


query("I16", _GONE + "SELECT * FROM r2")(lambda c: _cascade(c)["references"])
query("I17", _GONE + f"SELECT {P_} FROM p2")(lambda c: _cascade(c)["papers"].select(*PAPER))
query("I18", _GONE + """SELECT * FROM authors WHERE "authorId" IN (SELECT "authorId" FROM pa WHERE "paperId" IN (SELECT "paperId" FROM p2))""")(lambda c: _cascade(c)["authors"])
query("I19", _GONE + """SELECT "paperId" FROM papers WHERE "paperId" NOT IN (SELECT "paperId" FROM p2)""")(lambda c: _cascade(c)["removed"])
query("J6", """SELECT "paperId", reason FROM papers JOIN retr ON lower(doi) = b""")(lambda c: ingest.retraction_hits(c.papers, c.retractions).where("retracted").select("paperId", "reason"))
query("J8", """SELECT count(*) AS rows, count(*) FILTER (WHERE doi <> '') AS eligible, count(*) FILTER (WHERE doi IN (SELECT b FROM retr)) AS retracted FROM papers""")(lambda c: ingest.retraction_hits(c.papers, c.retractions).agg(F.count("*").alias("rows"), F.count_if(F.col("doi") != "").alias("eligible"), F.count_if("retracted").alias("retracted")))
query("I30", """SELECT "paperId", doi, 'Retracted' AS reason, true AS sampler, false AS "textProcessing" FROM papers WHERE doi IN (SELECT b FROM retr)""")(lambda c: ingest.forbidden(ingest.retraction_hits(c.papers, c.retractions), True, False))
query("I20", """SELECT "paperId" FROM papers WHERE selected EXCEPT SELECT "paperId" FROM papers WHERE processed""")(lambda c: ingest.reconcile(c.papers.where("selected").select("paperId"), c.papers.where("processed").select("paperId")))
query("J9", """SELECT "paperId", title FROM papers WHERE "paperId" IN (SELECT "paperId" FROM refs)""")(lambda c: c.papers.join(c.references, "paperId", "left_semi").select("paperId", "title"))
query("J10", """SELECT "paperId" FROM papers WHERE doi NOT IN (SELECT b FROM retr)""")(lambda c: ingest.retraction_hits(c.papers, c.retractions).where("not retracted").select("paperId"))
query("J17", """SELECT r.* FROM refs r WHERE "paperId" IN (SELECT "paperId" FROM papers WHERE processed) AND "referencePaperId" IN (SELECT "paperId" FROM papers WHERE processed)""")(lambda c: c.references.join(c.papers.where("processed").select("paperId"), "paperId", "left_semi").join(c.papers.where("processed").select(F.col("paperId").alias("referencePaperId")), "referencePaperId", "left_semi").select("paperId", "referencePaperId"))
query("U1", "SELECT * FROM edges")(lambda c: c.references.unionByName(c.citations_in.select(F.col("citingPaperId").alias("paperId"), F.col("paperId").alias("referencePaperId"))))
query("U2", """SELECT "paperId" FROM refs UNION SELECT "paperId" FROM cites""")(lambda c: c.references.select("paperId").union(c.citations_in.select("paperId")).distinct())
query("U3", """SELECT "paperId" FROM refs INTERSECT SELECT "paperId" FROM cites""")(lambda c: c.references.select("paperId").intersect(c.citations_in.select("paperId")))
query("U4", """SELECT "paperId", CASE WHEN processed THEN 'added' ELSE 'removed' END AS change FROM papers WHERE processed <> selected""")(lambda c: ingest.difference(c.papers.where("selected"), c.papers.where("processed"), "paperId"))
query("U6", """SELECT venue, min(k) AS k FROM papers GROUP BY 1""")(lambda c: ingest.first_by(c.papers.select("venue", F.col("paperId").substr(F.lit(2), F.lit(20)).cast("long").alias("k")), "venue", "k"))
query("K8", """SELECT "paperId", CASE WHEN k % 8 = 0 THEN 'bad' ELSE mark END AS mark FROM papers JOIN marks USING ("paperId") WHERE k % 8 <> 1""")(lambda c: ingest.previous_marks(c.marks, c.marks.withColumn("k", F.col("paperId").substr(F.lit(2), F.lit(20)).cast("long") % 8).where("k < 2").select("paperId", F.when(F.col("k") == 0, "bad").otherwise("standard").alias("mark"))))

# --- graph and sampling --------------------------------------------------------------------------

_GRAPH = """, g AS (SELECT src, dst, min(etype) AS etype FROM (SELECT "authorId" AS src, "paperId" AS dst, 'author' AS etype FROM pa UNION ALL SELECT venue, "paperId", 'venue' FROM papers WHERE venue <> '' UNION ALL SELECT "paperId", "citingPaperId", 'cites' FROM cites UNION ALL SELECT "referencePaperId", "paperId", 'cites' FROM refs) GROUP BY 1, 2)
"""
_graph = lambda c: graph.build(c.papers, c.links, None, c.authorships)
query("G1", _GRAPH + "SELECT etype, count(*) AS n, min(src) AS a, max(dst) AS b FROM g GROUP BY 1")(lambda c: _graph(c).groupBy("etype").agg(F.count("*").alias("n"), F.min("src").alias("a"), F.max("dst").alias("b")))
query("G3", _GRAPH + "SELECT (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)) AS nodes, (SELECT count(*) FROM g) AS edges")(lambda c: graph.size(_graph(c)))


def _rounds(n: int) -> str:
    sql = _GRAPH + ", ids AS (SELECT src AS id FROM g UNION SELECT dst FROM g), x0 AS (SELECT id, 1.0::double / (SELECT count(*) FROM ids) AS v FROM ids)"
    for k in range(n):
        sql += f", y{k} AS (SELECT id, sum(v) AS v FROM (SELECT id, v FROM x{k} UNION ALL SELECT dst, v FROM g JOIN x{k} ON src = id) GROUP BY 1), x{k + 1} AS (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM y{k}) AS v FROM y{k})"
    return sql + f" SELECT id, round(v, 6) AS v FROM x{n}"


query("G4_rounds", _rounds(4))(lambda c: graph.centrality(_graph(c), 4, fixed=True).select("id", F.round("v", 6).alias("v")))
_FORBIDDEN = """, fr AS (SELECT * FROM papers WHERE NOT selected AND NOT processed AND doi NOT IN (SELECT b FROM retr))
"""
_frontier = lambda c: graph.frontier(c.papers, ingest.forbidden(ingest.retraction_hits(c.papers, c.retractions), True, True))
query("X1", _FORBIDDEN + 'SELECT "paperId" FROM fr')(lambda c: _frontier(c).select("paperId"))
query("X2", _FORBIDDEN + """SELECT "paperId", round(exp(-0.01 * (row_number() OVER (ORDER BY "paperId") - 1)), 6) AS threshold FROM fr""")(lambda c: graph.bypass_threshold(_frontier(c), 0.01).select("paperId", F.round("threshold", 6).alias("threshold")))
_weighted = lambda c: graph.weights(_frontier(c).join(features.citation_counts(c.edges), "paperId", "left").select("paperId", "year", (F.col("citation_count") / 1000).alias("c_in"), F.lit(0.001).alias("c_out")), 0.1, 2000)
query("X4", _FORBIDDEN + """, w AS (SELECT fr."paperId", exp(-0.1 * (2000 - year)) * greatest(coalesce(n / 1000.0, 1e-5 / ((SELECT count(*) FROM fr) + 1)), 0.001) AS w FROM fr LEFT JOIN cc USING ("paperId")) SELECT "paperId", round(w / (SELECT sum(w) FROM w), 9)::double AS weight FROM w""")(lambda c: _weighted(c).select("paperId", F.round("weight", 9).alias("weight")))

# --- temporal ------------------------------------------------------------------------------------

_PER = """, span AS (SELECT min(year) AS a, max(year) AS b FROM papers), starts AS (SELECT unnest(generate_series(a, b, 2)) AS s, b FROM span), per AS (SELECT s::int AS start_year, least(s + 1, b)::int AS end_year, CASE WHEN least(s + 1, b) = s THEN cast(s AS varchar) ELSE concat(s, '-', least(s + 1, b)) END AS label FROM starts),
cn AS (SELECT label AS period, start_year, topic, count(*) AS n FROM papers JOIN per ON year BETWEEN start_year AND end_year GROUP BY 1, 2, 3), sz AS (SELECT period, start_year, sum(n) AS size FROM cn GROUP BY 1, 2 HAVING sum(n) >= 2),
sh AS (SELECT sz.period, sz.start_year, t.topic, coalesce(n, 0) / size AS share FROM sz CROSS JOIN (SELECT DISTINCT topic FROM papers) t LEFT JOIN cn ON cn.period = sz.period AND cn.topic = t.topic)
"""
_shares = lambda c: temporal.shares(c.papers, temporal.fixed_periods(c.papers, 2))
query("D1", _PER + "SELECT * FROM per")(lambda c: temporal.fixed_periods(c.papers, 2))
query("D2")(lambda c: temporal.adaptive_periods(c.papers, 1, 50))
SQL["D2"] = VIEWS.replace("WITH first_year", "WITH RECURSIVE first_year") + """, yn AS (SELECT year AS y, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY 1), sp AS (SELECT min(y) AS a, max(y) AS b FROM yn), ss AS (SELECT unnest(generate_series(a, b)) AS s, b FROM sp),
 en AS (SELECT s, any_value(b) AS b, coalesce(min(e) FILTER (held >= 50), any_value(b)) AS e, max(held) >= 50 AS enough FROM (SELECT s, b, e, (SELECT sum(n) FROM yn WHERE y BETWEEN s AND e) AS held FROM (SELECT s, b, unnest(generate_series(s, b)) AS e FROM ss)) GROUP BY s),
 ch AS (SELECT a AS s FROM sp UNION ALL SELECT e + 1 FROM ch JOIN en USING (s) WHERE e + 1 <= b) SELECT s::int AS start_year, e::int AS end_year, CASE WHEN s = e THEN cast(s AS varchar) ELSE concat(s, '-', e) END AS label FROM ch JOIN en USING (s) WHERE enough"""
query("J12", _PER + """SELECT "paperId", label AS period FROM papers JOIN per ON year BETWEEN start_year AND end_year""")(lambda c: temporal.assign(c.papers, temporal.fixed_periods(c.papers, 2)).select("paperId", "period"))
query("A17", _PER + "SELECT period, topic, round(share, 6)::double AS share FROM sh")(lambda c: _shares(c).select("period", "topic", F.round("share", 6).alias("share")))
query("D5", _PER + """, tr AS (SELECT topic, arg_min(share, start_year) AS f, arg_max(share, start_year) AS l, count(*) AS n FROM sh GROUP BY 1) SELECT topic, n >= 2 AND CASE WHEN f > 0 THEN (l - f) / f >= 0.5 ELSE l > 0.1 END AS emerging, n >= 2 AND coalesce((f - l) / nullif(f, 0) >= 0.5, false) AS declining FROM tr""")(lambda c: temporal.trends(_shares(c)).select("topic", "emerging", "declining"))
query("A15", "SELECT year, topic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6)::double AS share FROM papers WHERE year IS NOT NULL GROUP BY 1, 2")(lambda c: temporal.topic_years(c.papers).select("year", "topic", "n", F.round("share", 6).alias("share")))
query("A16", ", n AS (SELECT topic, year, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY 1, 2) SELECT topic, cast(sum(n) AS bigint) AS total, min(year) AS first_year, max(year) AS last_year, arg_max(year, n * 10000 - year) AS peak_year, max(n) AS peak FROM n GROUP BY 1")(lambda c: temporal.topic_activity(c.papers))
query("A18", _PER + "SELECT topic, round(avg(share), 6)::double AS mean FROM sh GROUP BY 1 HAVING avg(share) >= 0.01")(lambda c: temporal.trends(_shares(c)).where("mean >= 0.01").select("topic", F.round("mean", 6).alias("mean")))

# --- text ----------------------------------------------------------------------------------------

_docs = lambda c: c.table("documents").select("doc_id", "text")
query("T1", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '<jats:[^>]+>', '', 'g'), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g')) AS cleaned FROM documents")(lambda c: _docs(c).select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned")))
query("T16", """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::double[], q.embedding::double[]) DESC, vec_id LIMIT 10""")(lambda c: text.cosine_top(c.table("embeddings"), c.table("embeddings").where("vec_id = 0").first()["embedding"], 10).select("vec_id", F.round("cosine", 6).alias("cosine")))
query("T17")(lambda c: text.linucb(c.table("embeddings"), c.table("embeddings").where("vec_id % 20 = 0").select("vec_id", (F.col("vec_id") % 2).cast("double").alias("reward"))))
query("T18", """SELECT "paperId", len(list_filter(string_split_regex(title, '[,; ]'), lambda x: trim(x) <> '')) AS parts FROM papers""")(lambda c: c.papers.select("paperId", F.size(ids.split_authors(F.translate("title", " ", ","))).cast("bigint").alias("parts")))
query("T19", """SELECT "paperId", nullif(regexp_extract(concat('see ', doi, ' for'), '10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+'), '') AS found FROM papers""")(lambda c: c.papers.select("paperId", ids.find_doi(F.concat(F.lit("see "), F.col("doi"), F.lit(" for"))).alias("found")))

# --- sources and editing -------------------------------------------------------------------------

_number = lambda: F.col("paperId").substr(F.lit(2), F.lit(20)).cast("long")
_every = lambda c, n: c.papers.where(_number() % n == 0)

query("S4", 'SELECT * FROM marks')(lambda c: works.marks(c.marks.select(F.to_json(F.create_map("paperId", "mark")).alias("value"))))
query("S5", 'SELECT a AS "RetractionDOI", b AS "OriginalPaperDOI", reason AS "Reason" FROM retr')(lambda c: works.clean_retractions(c.retractions.unionByName(c.spark.createDataFrame([(None, " ", "none")], c.retractions.schema))))
query("S9", f"""SELECT {P_} FROM papers WHERE "paperId" IN (SELECT "referencePaperId" FROM refs WHERE "paperId" IN (SELECT "paperId" FROM papers WHERE "isSeed"))""")(lambda c: works.references_of(c.papers, c.references, c.papers.where("isSeed")).select(*PAPER))
query("S10", f"""SELECT {P_} FROM papers WHERE "paperId" IN (SELECT "paperId" FROM edges WHERE "referencePaperId" IN (SELECT "paperId" FROM papers WHERE "isSeed"))""")(lambda c: works.citing_works(c.papers, c.edges, c.papers.where("isSeed")).select(*PAPER))
query("S11", f"""SELECT {P_} FROM papers WHERE "paperId" IN (SELECT "paperId" FROM pa WHERE "authorId" = 'A1') ORDER BY year DESC NULLS LAST, "paperId" LIMIT 10 OFFSET 10""")(lambda c: works.works_page(c.papers, c.paper_author.where("authorId = 'A1'"), 2, 10).select(*PAPER))
query("S12", """SELECT "authorId", "authorName", n AS works_count FROM authors JOIN (SELECT "authorId", count(*) AS n FROM pa GROUP BY 1) USING ("authorId") WHERE contains(lower("authorName"), 'supplier#') ORDER BY n DESC, "authorId" LIMIT 1""")(
    lambda c: works.best_match(c.authors.join(c.paper_author.groupBy("authorId").agg(F.count("*").alias("works_count")), "authorId"), "Supplier#", "works_count"))
query("S17", """SELECT "paperId", trim(title) AS title, concat(venue, '|', topic) AS authors, year FROM papers WHERE venue <> ''""")(
    lambda c: c.papers.where("venue <> ''").select("paperId", F.format_string("\\title{%s}\n\\author{%s \\and %s}\n\\date{May %d}", "title", "venue", "topic", "year").alias("text")).select("paperId", works.latex().alias("m")).select("paperId", "m.title", F.array_join("m.authors", "|").alias("authors"), "m.year"))


def _index(c: Corpus, gaps: bool) -> DataFrame:
    return works.inverted_index(c.table("documents"), "doc_id", "text", gaps)


query("I10", "SELECT doc_id, sha256(trim(text)) AS digest FROM documents WHERE trim(text) <> ''")(lambda c: _index(c, False).select("doc_id", F.sha2(ids.from_inverted_index(F.col("index")), 256).alias("digest")).where("digest IS NOT NULL"))
query("I11", "SELECT doc_id, sha256(rtrim(text)) AS digest FROM documents WHERE trim(text) <> ''")(lambda c: _index(c, True).where(F.size("index") > 0).select("doc_id", F.sha2(ids.gapped_text(F.col("index")), 256).alias("digest")))
query("I13", """SELECT "paperId", CASE WHEN venue <> '' THEN venue WHEN k % 3 = 0 THEN topic WHEN k % 3 = 1 THEN 'open' ELSE '' END AS venue FROM papers""")(
    lambda c: c.papers.select("paperId", F.struct(F.col("venue").alias("primary"), F.array(F.lit(None).cast("string"), F.lit(""), F.when(_number() % 3 == 0, F.col("topic"))).alias("locations"), F.when(_number() % 3 == 1, "open").alias("best_oa")).alias("work")).select("paperId", editing.venue_of().alias("venue")))
query("I14", """SELECT "paperId", "isSeed" OR k % 17 = 0 AS "isSeed" FROM papers""")(lambda c: editing.set_flag(c.papers, _every(c, 17), "isSeed").select("paperId", "isSeed"))
query("I15", """SELECT "paperId", processed AND k % 17 <> 0 AS processed FROM papers""")(lambda c: editing.mark_failed(c.papers, _every(c, 17)).select("paperId", "processed"))
query("I21", """SELECT count(*) FILTER (WHERE NOT processed) AS missing, count(*) FILTER (WHERE NOT processed) = 0 AS consistent FROM papers WHERE selected""")(lambda c: editing.unflagged(c.papers, c.papers.where("selected"), "processed"))
query("I24", """SELECT k AS staging_id, CASE WHEN k % 106 = 0 THEN 'new' ELSE doi END AS doi, CASE WHEN k % 106 <> 0 THEN k % 53 = 0 END AS is_retracted, CASE WHEN k % 106 <> 0 AND k % 53 = 0 THEN 'fraud' END AS retraction_reason FROM papers""")(
    lambda c: editing.edit_staging(c.papers.select(_number().alias("staging_id"), "doi", (_number() % 53 == 0).alias("is_retracted"), F.when(_number() % 53 == 0, "fraud").alias("retraction_reason")), _every(c, 106).select(_number().alias("staging_id"), F.lit("new").alias("doi"))))
query("I26", """SELECT "paperId", CASE WHEN venue = '' THEN topic ELSE venue END AS venue FROM papers""")(lambda c: editing.fill(c.papers.select("paperId", "venue"), c.papers.select("paperId", F.col("topic").alias("venue")), "paperId", ["venue"]))
query("I27", """SELECT count(*) FILTER (WHERE k % 89 = 0 AND NOT "isSeed") AS added, count(*) FILTER (WHERE k % 89 = 0) + 1 - count(*) FILTER (WHERE k % 89 = 0 AND NOT "isSeed") AS duplicate, count(*) FILTER (WHERE k % 89 = 0 OR "isSeed") AS total FROM papers""")(
    lambda c: editing.add_seeds(c.papers.where("isSeed"), _every(c, 89).select("paperId").union(_every(c, 89).select("paperId").orderBy("paperId").limit(1))))
query("I29", """SELECT "paperId", selected OR "paperId" IN (SELECT "paperId" FROM pa WHERE "authorId" = 'A1') AS selected FROM papers""")(lambda c: editing.set_flag(c.papers, c.paper_author.where("authorId = 'A1'"), "selected").select("paperId", "selected"))
query("I38", """SELECT "paperId", k AS pos FROM papers WHERE k % 3 = 0""")(
    lambda c: editing.frontier(_every(c, 3).select(F.explode(F.array(_number(), _number() + 7)).alias("pos"), F.concat(F.lit(" "), "paperId").alias("paperId")).union(_every(c, 5).select(_number(), F.lit("X1"))), c.papers))
query("J7", """SELECT b AS doi, reason FROM retr""")(
    lambda c: ingest.first_by(works.clean_retractions(c.retractions).select(F.col("OriginalPaperDOI").alias("doi"), F.col("Reason").alias("reason"), F.lit(0).alias("pos")).unionByName(works.clean_retractions(c.retractions).select(F.col("OriginalPaperDOI").alias("doi"), F.lit("later").alias("reason"), F.lit(1).alias("pos"))), "doi", "pos").select("doi", "reason"))
query("J16", """SELECT "paperId" FROM papers WHERE NOT (CASE WHEN doi <> '' THEN k % 3 = 0 ELSE k % 2 = 0 END)""")(
    lambda c: catalog.export_new(c.papers.withColumn("url", F.concat(F.lit("u/"), "paperId")), c.papers.where((_number() % 3 == 0) & (F.col("doi") != "")).select(F.upper("doi").alias("doi"), F.lit("").alias("url")).union(_every(c, 2).where("doi = ''").select(F.lit(" "), F.concat(F.lit("U/"), "paperId")))).select("paperId"))
query("G2", """SELECT "paperId" AS id, 'paper' AS ntype FROM papers UNION ALL SELECT "authorId", 'author' FROM authors UNION ALL SELECT DISTINCT venue, 'venue' FROM papers WHERE venue <> ''""")(
    lambda c: c.papers.select(F.col("paperId").alias("id"), F.lit("paper").alias("ntype")).unionByName(c.authors.select(F.col("authorId").alias("id"), F.lit("author").alias("ntype"))).unionByName(c.papers.where("venue <> ''").select(F.col("venue").alias("id"), F.lit("venue").alias("ntype")).distinct()))
query("O5", f"""SELECT {P_} FROM papers WHERE selected ORDER BY "paperId" LIMIT 20 OFFSET (SELECT greatest(0, (count(*) - 1) // 20) * 20 FROM papers WHERE selected)""")(lambda c: catalog.clamped_page(c.papers.where("selected"), 10_000_000, 20, "paperId").select(*PAPER))