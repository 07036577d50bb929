"""More queries of the reference's own operators and their SQL, by operator id: records, matching, topics, sampling, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import ids
from citeloom.operators import catalog, features, graph, ingest, matching, records, scratch, temporal, text, topics
from citeloom.operators import predicates as P
from citeloom.operators.corpus import Corpus
from citeloom.plans.catalogue import _FORBIDDEN, _PER, P_, PAPER, _frontier, _number, _paper_query, _weighted, query
from citeloom.sources import markup, works

# --- nested records ------------------------------------------------------------------------------


def _records(c: Corpus) -> DataFrame:
    """Papers with their authors, what cites them and what they cite, as one nested row each."""
    own = c.paper_author.groupBy("paperId").agg(F.collect_list("authorId").alias("authors"))
    plain = c.papers.select("paperId").join(own, "paperId", "left")
    other = lambda df, key, col: df.join(own.select(F.col("paperId").alias(key), "authors"), key, "left").groupBy("paperId").agg(F.collect_list(F.struct(F.col(key).alias("paperId"), "authors")).alias(col))
    return plain.join(other(c.citations_in, "citingPaperId", "citations"), "paperId", "left").join(other(c.references, "referencePaperId", "references"), "paperId", "left")


_WITH_AUTHORS = """SELECT "paperId", "authorId" FROM pa"""
query("I6", _WITH_AUTHORS)(lambda c: records.authorship(_records(c)))
query("I7", 'SELECT * FROM cites')(lambda c: records.nested_edges(_records(c), "citations", "citingPaperId"))
query("I8", 'SELECT * FROM refs')(lambda c: records.nested_edges(_records(c), "references", "referencePaperId"))
query("I9", """SELECT DISTINCT "paperId", concat('on ', title) AS abstract FROM papers WHERE k % 4 <> 0""")(
    lambda c: records.abstracts(c.papers.select("paperId", F.when(_number() % 4 == 0, "  ").otherwise(F.concat(F.lit("on "), "title")).alias("abstract")).unionByName(c.papers.where(_number() % 4 == 1).select("paperId", F.concat(F.lit("on "), "title").alias("abstract")))))
query("I2", """SELECT "paperId" FROM papers WHERE NOT processed OR k % 2 = 0""")(lambda c: records.valid_legacy(c.papers.withColumn("abstract", F.when(_number() % 2 == 0, ""))).select("paperId"))
query("I3", "SELECT count(*) FILTER (WHERE k % 10 <> 0) AS valid, count(*) FILTER (WHERE k % 10 = 0) AS invalid FROM papers")(lambda c: records.validation_counts(c.papers.withColumn("title", F.when(_number() % 10 != 0, F.col("title")))))
query("I5", """SELECT "paperId", k % 3 = 0 AS flag, CASE WHEN k % 5 <> 0 THEN k END AS n, CASE WHEN k % 2 = 0 THEN title ELSE '' END AS name FROM papers""")(
    lambda c: records.coerced(c.papers.select("paperId", F.when(_number() % 3 == 0, "True").when(_number() % 3 == 1, "no").alias("flag"), F.when(_number() % 5 == 0, "x").otherwise(_number().cast("string")).alias("n"), F.when(_number() % 2 == 0, F.col("title")).alias("name")), {"flag": "boolean", "n": "bigint", "name": "string"}))


def _works(c: Corpus) -> DataFrame:
    """Papers as works with nested fields."""
    k, none = _number(), F.lit(None).cast("string")
    name = lambda n, level: F.struct(n.alias("name"), F.lit(level).alias("level"))
    author = lambda n, *at: F.struct(n.alias("name"), F.array(*at).alias("institutions"))
    return c.papers.select(F.concat(F.lit("https://works.example/"), F.lower("paperId")).alias("id"), F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), F.upper("doi"))).alias("doi"), F.col("year").alias("publication_year"), "title",
                           F.struct(F.col("venue").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("u/"), "paperId")).alias("url"), F.when((F.col("venue") != "") & (k % 2 == 0), F.concat(F.lit("https://works.example/s"), (k % 10).cast("string"))).alias("id")).alias("primary_location"),
                           F.when(k % 22 == 0, F.struct(F.lit("Host").alias("name"), F.lit("S77").alias("id"))).alias("host_venue"), F.array(F.struct(F.lit(" ").alias("name")), F.struct(F.col("topic").alias("name"))).alias("locations"),
                           F.array(author(F.concat(F.lit("N"), (k % 5).cast("string")), F.concat(F.lit("I"), (k % 3).cast("string")), F.lit("I0")), author(F.lit("B"), F.lit("I2"), F.lit("")), author(F.lit("C"), none), author(F.lit("D"), F.lit("I1"))).alias("authorships"),
                           F.create_map(F.lit("again"), F.array(F.lit(0), F.lit(2)), F.col("paperId"), F.array(F.lit(1))).alias("abstract_index"),
                           F.array(name(F.col("topic"), 0), name(F.col("venue"), 1), name(F.concat(F.lit("s"), (k % 4).cast("string")), 2), name(F.lit("t1"), 3), name(F.lit("t2"), 4), name(none, 0)).alias("concepts"),
                           F.array_repeat(F.lit("x"), (k % 7).cast("int")).alias("referenced_works"), F.when(k % 2 == 0, k % 11).alias("cited_by_count"))


query("I12", """SELECT "paperId", topic AS domains, venue AS fields, concat('s', k % 4) AS subfields, 't1|t2' AS topics FROM papers""")(
    lambda c: _works(c).select(ids.work_id(F.col("id")).alias("paperId"), records.hierarchy(F.col("concepts")).alias("h")).select("paperId", *[F.array_join(f"h.{x}", "|").alias(x) for x in ("domains", "fields", "subfields", "topics")]))
query("I34", """SELECT "paperId", cast(k % 7 AS int) AS references_count, CASE WHEN k % 2 = 0 THEN k % 11 ELSE 0 END AS cited_by_count, CASE k % 3 WHEN 0 THEN 'I0|I2|I1' WHEN 1 THEN 'I1|I0|I2' ELSE 'I2|I0|I1' END AS institutions,
 CASE WHEN k % 3 = 0 THEN concat('u/', "paperId") WHEN doi <> '' THEN concat('https://doi.org/', doi) ELSE concat('https://works.example/', lower("paperId")) END AS url, concat('N', k % 5, ', B, C et al.') AS authors FROM papers""")(lambda c: records.detail_of(_works(c)).withColumn("institutions", F.array_join("institutions", "|")))
query("T21", """SELECT "paperId", CASE k % 3 WHEN 0 THEN 'I0|I2|I1' WHEN 1 THEN 'I1|I0|I2' ELSE 'I2|I0|I1' END AS institutions FROM papers""")(lambda c: _works(c).select(ids.work_id(F.col("id")).alias("paperId"), F.array_join(records.institutions(F.col("authorships")), "|").alias("institutions")))
query("T20", """SELECT "paperId", CASE WHEN n > 3 THEN concat(array_to_string(a[1:3], ', '), ' et al.') ELSE array_to_string(a, ', ') END AS authors FROM (SELECT "paperId", list("authorId" ORDER BY "authorId") AS a, count(*) AS n FROM pa GROUP BY 1)""")(
    lambda c: c.paper_author.groupBy("paperId").agg(F.array_sort(F.collect_list("authorId")).alias("a")).select("paperId", ids.author_summary(F.col("a")).alias("authors")))
query("T23", """SELECT "paperId", substr(regexp_replace(regexp_replace(concat(title, ': a/b - c?'), '[^A-Za-z0-9_\\s-]', '', 'g'), '[\\s-]+', '_', 'g'), 1, 50) AS name FROM papers""")(lambda c: c.papers.select("paperId", ids.safe_name(F.concat("title", F.lit(": a/b - c?"))).alias("name")))
query("I35", """SELECT CASE WHEN k % 2 = 0 THEN "paperId" ELSE concat('i', k) END AS paper_id, CASE WHEN k % 3 = 0 THEN 'shown' ELSE title END AS title, cast(year AS varchar) AS year, nullif(venue, '') AS venue FROM papers WHERE k % 5 <> 0""")(
    lambda c: records.normalised(c.papers.select(F.when(_number() % 5 == 0, " ").when(_number() % 2 == 0, F.col("paperId")).alias("paperId"), F.when(_number() % 5 != 0, F.concat(F.lit("i"), _number().cast("string"))).alias("id"), F.when(_number() % 3 == 0, "").otherwise(F.col("title")).alias("title"), F.lit("shown").alias("display_name"), F.col("year").alias("publication_year"), F.col("venue").alias("journal"))))
query("I37", """SELECT "paperId", title, concat(topic, ', ', venue) AS authors, venue, year, doi, 'lib' AS source, 'library' AS source_type, true AS is_selected FROM papers""")(lambda c: records.staged(c.papers.withColumn("authors", F.array("topic", "venue")), "lib"))
query("I32", """SELECT count(*) FILTER (WHERE k % 6 = 1) AS added, count(*) FILTER (WHERE k % 6 = 0) AS skipped, count(*) FILTER (WHERE k % 12 IN (0, 1)) AS removed, count(*) FILTER (WHERE k % 12 = 5) AS missing FROM papers""")(
    lambda c: records.library_edit(c.papers.where(_number() % 2 == 0).select("paperId"), c.papers.where(_number() % 6 <= 1).select("paperId"), c.papers.where((_number() % 12).isin(0, 1, 5)).select("paperId"))[1])
query("I23", """SELECT "paperId" FROM papers WHERE k % 4 = 1 AND (doi <> '' OR k % 3 = 0) UNION ALL SELECT min("paperId") FROM papers p WHERE k % 4 = 1 AND doi = '' AND k % 3 <> 0
 AND NOT EXISTS (SELECT 1 FROM papers e WHERE e.k % 4 = 0 AND e.doi = '' AND e.k % 3 <> 0 AND lower(e.title) = lower(p.title) AND CASE WHEN e.k % 9 <> 0 THEN e.year END IS NOT DISTINCT FROM CASE WHEN p.k % 9 <> 0 THEN p.year END)
 GROUP BY lower(title), CASE WHEN k % 9 <> 0 THEN year END""")(
    lambda c: ingest.insert_staging(_staging(c).where("k % 4 = 0"), _staging(c).where("k % 4 = 1"), "paperId").select("paperId"))
query("I25", """SELECT k AS staging_id, k % 3 = 0 AS is_selected FROM papers WHERE k % 7 <> 0""")(lambda c: records.staging_selection(c.papers.select(_number().alias("staging_id"), F.lit(True).alias("is_selected")), c.papers.where(_number() % 3 == 0).select(_number().alias("staging_id")), c.papers.where(_number() % 7 == 0).select(_number().alias("staging_id"))))
query("I31", """SELECT "paperId", doi, 'Retracted' AS reason, true AS sampler, true AS "textProcessing" FROM papers WHERE k % 53 = 0 AND doi <> ''""")(lambda c: ingest.forbidden(c.papers.withColumn("retracted", (_number() % 53 == 0) & (F.col("doi") != "")), True, True))
query("I36", """SELECT event_id FROM events WHERE epoch(TIMESTAMP '2030-01-01 00:00:00') - epoch(ts) >= 3600 * 24 * 1000""")(lambda c: ingest.expired(c.table("events").select("event_id", F.col("ts").cast("timestamp").alias("updated_at")), "2030-01-01 00:00:00", 24 * 1000).select("event_id"))
query("U5", """SELECT "paperId", 'a' AS reason, cast(NULL AS varchar) AS doi FROM papers WHERE k % 4 = 0 UNION ALL SELECT "paperId", 'b', doi FROM papers WHERE k % 6 = 0""")(
    lambda c: c.papers.where(_number() % 4 == 0).select("paperId", F.lit("a").alias("reason")).unionByName(c.papers.where(_number() % 6 == 0).select("paperId", F.lit("b").alias("reason"), "doi"), allowMissingColumns=True))
query("J2", """SELECT pa."paperId", pa."authorId", coalesce(n, 0) AS citations, year FROM pa LEFT JOIN cc USING ("paperId") LEFT JOIN papers USING ("paperId")""")(
    lambda c: c.paper_author.join(features.citation_counts(c.edges), "paperId", "left").join(c.papers.select("paperId", "year"), "paperId", "left").select("paperId", "authorId", F.coalesce("citation_count", F.lit(0)).alias("citations"), "year"))

# --- staging and catalog filters -----------------------------------------------------------------


def _staging(c: Corpus) -> DataFrame:
    k = _number()
    return c.papers.select("paperId", k.alias("k"), "doi", "title", "venue", F.when(k % 9 != 0, F.col("year")).alias("year"), F.concat(F.lit("https://u.example/"), "paperId").alias("url"), F.concat(F.lit("A. "), "topic").alias("authors"), F.concat(F.lit("on "), "topic").alias("abstract"),
                           F.when(k % 2 == 0, "Upload").otherwise("Manual").alias("source"), F.when(k % 3 == 0, "file").otherwise("other").alias("source_type"), F.when(k % 3 == 0, k.cast("string")).alias("source_id"), F.col("selected").alias("is_selected"), (k % 53 == 0).alias("is_retracted"))


_STAGING = """, st AS (SELECT "paperId", k, doi, title, venue, CASE WHEN k % 9 <> 0 THEN year END AS year, concat('https://u.example/', "paperId") AS url, concat('A. ', topic) AS authors, concat('on ', topic) AS abstract,
 CASE WHEN k % 2 = 0 THEN 'Upload' ELSE 'Manual' END AS source, CASE WHEN k % 3 = 0 THEN 'file' ELSE 'other' END AS source_type, selected AS is_selected, k % 53 = 0 AS is_retracted FROM papers)
"""


def _staged(name: str, where: str, f: records.StagingFilter) -> None:
    query(name, _STAGING + f'SELECT "paperId", year FROM st WHERE {where}')(lambda c: _staging(c).where(f.column(dict(_staging(c).dtypes))).select("paperId", "year"))


_staged("P19", """(lower(source) IN ('upload', 'file') OR lower(source_type) IN ('upload', 'file')) AND (year IS NULL OR year BETWEEN 1992 AND 1997) AND contains(lower(title), 'e') AND contains(lower(venue), 'brand') AND contains(lower(authors), 'a. ')
 AND (contains(lower(title), 'eco') OR contains(lower(abstract), 'eco')) AND doi <> '' AND NOT is_retracted AND lower(trim(venue)) IN ('brand#11', 'brand#12', 'brand#21', 'brand#22', 'brand#31', 'brand#32')""",
        records.StagingFilter(sources=["Upload", "FILE"], year_min=1992, year_max=1997, title="E", venue=" brand", author="a.", keyword="ECO", doi="with", retraction="not_retracted", venues=["Brand#11", "brand#12 ", "Brand#21", "Brand#22", "Brand#31", "Brand#32"]))
_staged("P20", """NOT contains(lower(trim(concat_ws(' ', doi, url))), '7') AND coalesce(cast(year AS double) BETWEEN 1995 AND 1996, false) AND starts_with(lower(trim(authors)), 'a.')""", records.StagingFilter(rules=["identifier::not_contains::7", "year::between::1996::1995", "authors::begins_with::A."]))
_staged("P18", """lower(trim(doi)) = '10.5555/x' OR lower(trim(url)) IN ('https://u.example/w7', 'https://u.example/w8')""", records.StagingFilter(identifiers=["doi::10.5555/X", "url::https://u.example/W7", "url:: https://u.example/w8 ", "broken", "isbn::1"]))
query("O4", _STAGING + """SELECT "paperId" FROM st ORDER BY "paperId" LIMIT 200 OFFSET 200""")(lambda c: catalog.staging_page(_staging(c), "paperId", False, 2, 10_000, "paperId").select("paperId"))
_paper_query("P10", '"isSeed" OR selected', lambda df: records.flagged(df, ["isSeed", "seed", "is_seed", "selected"]))
query("P11", f"""SELECT {P_} FROM papers WHERE k % 4 = 1 OR k % 3 = 2""")(lambda c: (df := c.papers.withColumns({"nmf_topic": _number() % 4, "lda_topic": _number() % 3})).where(records.topic_filter(df, ["1"], ["nmf", "gone"]) | records.topic_filter(df, ["2"], ["nmf", "lda"], "lda")).select(*PAPER))
query("P13", f"""SELECT {P_} FROM papers WHERE trim(venue) IN ('Brand#11', 'Brand#23', 'Brand#32', 'Brand#45') AND year IN (SELECT DISTINCT year FROM papers WHERE year < 1996) AND "paperId" IN (SELECT "paperId" FROM pa JOIN authors USING ("authorId") WHERE "authorName" IN (SELECT s_name FROM supplier WHERE s_suppkey < 60)) AND (doi <> '' OR venue <> '')""")(
    lambda c: (df := features.author_names(c.papers, c.paper_author, c.authors)).where(records.column_values(df, venues=["Brand#11", "Brand#23", "Brand#32", "Brand#45"], years=list(range(1985, 1996)), authors=[f"Supplier#{i:09}" for i in range(60)])).select(*PAPER))
# --- matching ------------------------------------------------------------------------------------

_MORE = " with words that others lack"


def _found(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Items, and what a search answers for each: a title with much more, one with a little more, the title itself."""
    k = _number()
    items = c.papers.select(F.col("paperId").alias("item"), "title", "doi")
    answers = [(0, F.concat("title", F.lit(_MORE)), F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/"), F.upper("doi")))), (1, F.concat("title", F.lit(" 77")), F.lit(None).cast("string")), (2, F.when(k % 3 == 0, F.col("title")).otherwise("9"), F.lit(None).cast("string"))]
    rows = c.papers.select(F.col("paperId").alias("item"), F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.concat("paperId", F.lit(f"-{p}")).alias("candidate"), t.alias("title"), d.alias("doi")) for p, t, d in answers])).alias("x")).select("item", "x.*")
    return items, rows


_RATIOS = f""", r AS (SELECT "paperId" AS item, k, doi, doi <> '' AND k % 4 = 0 AS d, 2.0 * length(title) / (2 * length(title) + {len(_MORE)}) AS r0, 2.0 * length(title) / (2 * length(title) + 3) AS r1 FROM papers)
"""
query("J13", _RATIOS + """SELECT item, CASE WHEN d OR r0 >= 0.85 THEN concat(item, '-0') WHEN r1 >= 0.85 THEN concat(item, '-1') WHEN k % 3 = 0 THEN concat(item, '-2') END AS match, round(CASE WHEN d THEN 1.0 WHEN r0 >= 0.85 THEN r0 WHEN r1 >= 0.85 THEN r1 WHEN k % 3 = 0 THEN 1.0 END, 6)::double AS confidence,
 CASE WHEN d OR r1 >= 0.85 OR k % 3 = 0 THEN 0 ELSE (r0 >= 0.6)::int + (r1 >= 0.6)::int END::bigint AS candidates FROM r""")(lambda c: matching.first_match(*_found(c)).withColumn("confidence", F.round("confidence", 6)))
query("J14", _RATIOS + """SELECT item, CASE WHEN d THEN concat(item, '-0') WHEN k % 3 = 0 THEN concat(item, '-2') ELSE concat(item, '-1') END AS match, round(CASE WHEN d OR k % 3 = 0 THEN 1.0 ELSE r1 END, 6)::double AS confidence FROM r WHERE d OR k % 3 = 0 OR r1 >= 0.85""")(lambda c: matching.best_match(*_found(c)).withColumn("confidence", F.round("confidence", 6)))
query("T15", _RATIOS + """SELECT item, round(CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN r1 ELSE 0.0 END, 6)::double AS similarity FROM r""")(
    lambda c: c.papers.select(F.col("paperId").alias("item"), F.round(text.title_similarity(text.title_key(F.col("title")), text.title_key(F.when(_number() % 3 == 0, F.upper("title")).when(_number() % 3 == 1, F.concat("title", F.lit(" -77"))).otherwise(""))), 6).alias("similarity")))
query("J15", """, own AS (SELECT "paperId", k, CASE k % 5 WHEN 0 THEN "paperId" WHEN 1 THEN "paperId" WHEN 2 THEN CASE WHEN doi <> '' THEN "paperId" END END AS m, lower(trim(regexp_replace(regexp_replace(lower(title), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t, doi FROM papers), byt AS (SELECT t, min("paperId") AS m3 FROM own GROUP BY 1)
SELECT k AS staging_id, CASE WHEN k % 5 = 3 THEN m3 ELSE m END AS match, CASE WHEN k % 5 < 2 THEN 'id' WHEN k % 5 = 2 AND doi <> '' THEN 'doi' WHEN k % 5 = 3 THEN 'title' ELSE 'nothing to match by' END AS how FROM own JOIN byt USING (t)""")(
    lambda c: matching.staging_cascade(c.papers.select(_number().alias("staging_id"), F.when(_number() % 5 == 0, F.col("paperId")).alias("source_id"), F.when(_number() % 5 == 1, F.concat(F.lit("https://works.example/"), "paperId")).alias("url"), F.when(_number() % 5 == 2, F.concat(F.lit("doi:"), F.upper("doi"))).alias("doi"), F.when(_number() % 5 == 3, F.upper("title")).otherwise(" ").alias("title")), c.papers))

# --- venues --------------------------------------------------------------------------------------

_SHAPES = ["IEEE: {}", "2020 Proceedings of {}", "{} 2019", "In: {}", "{} 12(3)", "{} pp. 12-15", "{} (ITC)", "Proc. {}!!", "  ACM - {}  & more  "]


def _venues(c: Corpus):
    shape = F.lit("")
    for i, s in enumerate(_SHAPES):
        a, b = s.split("{}")
        shape = F.when(_number() % 9 == i, F.concat(F.lit(a), "title", F.lit(b))).otherwise(shape)
    return c.papers.select("paperId", shape.alias("venue"))


_RAW = "CASE k % 9 " + " ".join(f"WHEN {i} THEN concat('{s.split('{}')[0]}', title, '{s.split('{}')[1]}')" for i, s in enumerate(_SHAPES)) + " END"
_CLEANED = f"lower(trim({_RAW}))"
for _pattern, _by in (("^(springer|elsevier|acm|mdpi|ieee)\\s*[:\\-]\\s*", ""), ("^\\d{4}\\s+", ""), ("\\s+\\d{4}$", ""), ("^(in:|proceedings of|proc\\.?)\\s+", ""), ("\\(?\\d+\\s*\\(\\d+\\)\\)?", " "), ("(pp\\.?|pages)\\s*\\d+(\\s*[-–]\\s*\\d+)?", " "), ("\\(.*?\\)", " "), ("[^a-z0-9\\s]", " "), ("\\s+", " ")):
    _CLEANED = f"regexp_replace({_CLEANED}, '{_pattern}', '{_by}', 'g')"
_VENUE = f""", v AS (SELECT "paperId", trim({_CLEANED}) AS c FROM papers)
"""
_CANON = ["steel things review", "first brand"]
query("T11", _VENUE + 'SELECT "paperId", c AS cleaned FROM v')(lambda c: _venues(c).select("paperId", text.clean_venue(F.col("venue")).alias("cleaned")))
_aliases = lambda c: c.papers.where(_number() % 10 == 0).select(text.clean_venue(F.col("title")).alias("alias"), F.lit("TESTCONF").alias("canonical")).distinct()
_ALIAS = """, al AS (SELECT DISTINCT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS c FROM papers WHERE k % 10 = 0)
"""
query("T12", _VENUE + _ALIAS + """SELECT "paperId" FROM v SEMI JOIN al USING (c)""")(lambda c: text.normalise_venue(_venues(c), "venue", _aliases(c)).where("venue_normal = 'TESTCONF'").select("paperId"))
query("T14", _VENUE + _ALIAS + """SELECT "paperId", CASE WHEN c IN (SELECT c FROM al) THEN 'TESTCONF' ELSE array_to_string(list_transform(string_split(c, ' '), lambda x: concat(upper(x[1]), x[2:])), ' ') END AS venue_normal FROM v""")(lambda c: text.normalise_venue(_venues(c), "venue", _aliases(c), ["First Brand", "Second Brandt"]).select("paperId", "venue_normal"))

# --- languages and topics ------------------------------------------------------------------------

_docs = lambda c: c.table("documents").select("doc_id", "text")
_CLEAN = "regexp_replace(regexp_replace(text, '<jats:[^>]+>', '', 'g'), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g')"
_VALID = f"coalesce(NOT contains(lower(text), 'none') AND length({_CLEAN}) >= 120, false)"
_WORDS = "regexp_split_to_array(lower(text), '\\s+')"
query("T2", f"SELECT doc_id, {_VALID} AS valid FROM documents")(lambda c: _docs(c).select("doc_id", text.valid(F.col("text")).alias("valid")))
_CONCEPTS = """, cn0 AS (SELECT topic AS grp, unnest([venue, concat('s', k % 3)]) AS name FROM papers), top2 AS (SELECT * FROM (SELECT grp, name, count(*) AS n, cast(row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, name) AS int) AS place FROM cn0 WHERE name <> '' GROUP BY 1, 2) WHERE place <= 2)
"""
_named = lambda c: c.papers.select(F.col("topic").alias("grp"), F.array(F.struct(F.col("venue").alias("name"), F.lit(2).alias("level")), F.struct(F.lit("wide").alias("name"), F.lit(1).alias("level")), F.struct(F.concat(F.lit("s"), (_number() % 3).cast("string")).alias("name"), F.lit(3).alias("level"))).alias("concepts"))
query("A19", _CONCEPTS + "SELECT grp, name, n, place FROM top2")(lambda c: topics.concepts(_named(c), "grp").select("grp", "name", "n", "place"))
_AUTHORS = """, af AS (SELECT "authorId", count(*) AS num_papers, cast(sum(coalesce(n, 0)) AS bigint) AS num_citations, max(coalesce(n, 0)) AS max_citations FROM pa LEFT JOIN cc USING ("paperId") GROUP BY 1)
"""
query("O8", _AUTHORS + " , t AS (" + " UNION ALL ".join(f'SELECT * FROM (SELECT "authorId", {i} AS place, {m} AS v FROM af ORDER BY v DESC, "authorId" LIMIT 5)' for i, m in enumerate(("num_papers", "num_citations", "max_citations"))) + """) SELECT "authorId", cast(min(place) AS int) AS place FROM t GROUP BY 1""")(
    lambda c: features.top_by_measures(features.author_features(c.papers, c.edges, c.paper_author), "authorId", ["num_papers", "num_citations", "max_citations"]))

# --- sampling ------------------------------------------------------------------------------------

_unit = lambda seed: f"""((CAST(concat('0x', substr(md5(concat("paperId", '|{seed}')), 1, 13)) AS bigint) + 0.5::double) / 4503599627370496.0::double)"""
_W = """, w AS (SELECT fr."paperId", exp(-0.1 * (2000 - year)) * greatest(coalesce(n / 1000.0, 1e-5 / ((SELECT count(*) FROM fr) + 1)), 0.001) AS w FROM fr LEFT JOIN cc USING ("paperId"))
"""
query("X5", _FORBIDDEN + _W + f"""SELECT "paperId" FROM w ORDER BY -ln({_unit(7)}) / (w / (SELECT sum(w) FROM w)), "paperId" LIMIT 50""")(lambda c: graph.sample(_weighted(c), 50, 7).select("paperId"))
_SPLIT = _FORBIDDEN + f""", th AS (SELECT *, exp(-0.01 * (row_number() OVER (ORDER BY "paperId") - 1)) AS threshold FROM fr), sp AS (SELECT * FROM th WHERE {_unit(5)} < threshold OR contains(lower(title), 'survey'))
"""
query("X3", _SPLIT + 'SELECT "paperId" FROM sp')(lambda c: graph.split(graph.bypass_threshold(_frontier(c), 0.01), P.keywords(F.col("title"), ["survey"]), 5).select("paperId"))

# --- topics over time ----------------------------------------------------------------------------

_two = lambda c: temporal.fixed_periods(c.papers, 2)
query("D7", _PER + "SELECT period, round(share, 6)::double AS share FROM sh WHERE topic = (SELECT min(topic) FROM papers)")(
    lambda c: temporal.evolution(c.papers, _two(c)).join(F.broadcast(c.papers.agg(F.min("topic").alias("topic"))), "topic").select("period", F.round("share", 6).alias("share")))
_COUNTED = """, yt AS (SELECT *, concat('t', k % 5) AS tp, 1990 + CASE WHEN k % 5 < 2 AND k % 3 = 0 THEN 2 WHEN k % 5 < 2 THEN 0 WHEN k % 3 = 0 THEN 0 ELSE 2 END AS yr FROM papers), ys AS (SELECT tp, yr, count(*) / sum(count(*)) OVER (PARTITION BY yr) AS share FROM yt GROUP BY 1, 2), ends AS (SELECT tp, arg_min(share, yr) AS f, arg_max(share, yr) AS l FROM ys GROUP BY 1)
"""
query("D6", _COUNTED + "SELECT tp AS topic FROM ends WHERE f > 0 AND (f - l) / f >= 0.5")(
    lambda c: temporal.trends(temporal.shares((df := c.papers.select("paperId", F.concat(F.lit("t"), (_number() % 5).cast("string")).alias("topic"), (1990 + F.when((_number() % 5 < 2) & (_number() % 3 == 0), 2).when(_number() % 5 < 2, 0).when(_number() % 3 == 0, 0).otherwise(2)).alias("year"))), temporal.fixed_periods(df, 2))).where("declining").select("topic"))

# --- files and sinks -----------------------------------------------------------------------------

query("S21", """SELECT "paperId", CASE k % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'xml' WHEN 3 THEN 'latex' WHEN 4 THEN 'docx' ELSE 'unknown' END AS kind FROM papers""")(lambda c: c.papers.select("paperId", markup.kind_of(F.concat(F.lit("/a.b/"), "title", F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".htm", ".nxml", ".tex", ".docx", ".zip")]), (_number() % 6 + 1).cast("int")))).alias("kind")))
query("S23", """SELECT "paperId" FROM papers WHERE k % 3 = 0""")(lambda c: (p := scratch.new_path(c.spark, "seeds"), c.papers.where(_number() % 3 == 0).select(F.explode(F.array("paperId", F.concat(F.lit("  "), "paperId"), F.lit(" "))).alias("value")).write.text(p), works.seed_file(c.spark, p))[2])
query("K2", """SELECT 'papers' AS frame, count(*) AS rows FROM papers UNION ALL SELECT 'references', count(*) FROM refs""")(lambda c: markup.write_checkpoint({"papers": c.papers, "references": c.references}, scratch.new_path(c.spark, "checkpoint")))
query("K3", """SELECT concat('{"paperId":"', "paperId", '","year":', year, '}') AS value FROM papers""")(lambda c: markup.write_lines(c.papers.select("paperId", "year"), scratch.new_path(c.spark, "lines")))
