"""Matching rows to candidates by identifier and title.

Candidates come with their item, as a search answers with a few for each, so that no title meets all
others. Defined results: an item without candidates has no match; empty titles are alike to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import ids
from citeloom.operators.keys import with_key
from citeloom.operators.text import title_key, title_similarity


def scored(items: DataFrame, candidates: DataFrame, least: float, key: str = "item") -> DataFrame:
    """candidates (item, place, candidate, title, doi) with confidence: 1 where the DOIs or titles are equal, else the titles' ratio.
    Those whose lengths alone keep the ratio below least are left out; the ratio is computed for what is left."""
    own = items.select(key, title_key(F.coalesce("title", F.lit(""))).alias("__t"), ids.match_doi(F.col("doi")).alias("__d"))
    both = candidates.join(own, key).withColumn("__u", title_key(F.coalesce("title", F.lit(""))))
    both = both.withColumn("by_doi", F.coalesce(ids.match_doi(F.col("doi")) == F.col("__d"), F.lit(False)))
    a, b = F.length("__t"), F.length("__u")
    sure = F.col("by_doi") | ((F.col("__t") == F.col("__u")) & (a > 0))
    open_ = both.where(~sure & (2 * F.least(a, b) >= least * (a + b) - 1e-9) & (a > 0) & (b > 0))
    out = both.where(sure).withColumn("confidence", F.lit(1.0)).unionByName(open_.withColumn("confidence", title_similarity("__t", "__u")))
    return out.drop("__t", "__u", "__d")


def first_match(items: DataFrame, candidates: DataFrame, sure: float = 0.85, maybe: float = 0.60, key: str = "item") -> DataFrame:
    """Per item: the match with an equal DOI, else the first candidate as sure; without either, how many may be it."""
    rows = scored(items, candidates, min(sure, maybe), key)
    auto = F.when(F.col("by_doi") | (F.col("confidence") >= sure), F.struct((~F.col("by_doi")).alias("later"), F.col("place"), F.col("candidate"), F.col("confidence")))
    found = rows.groupBy(key).agg(F.min(auto).alias("m"), F.count_if(F.col("confidence") >= maybe).alias("n"))
    found = found.select(key, F.col("m.candidate").alias("match"), F.col("m.confidence").alias("confidence"), F.when(F.col("m").isNull(), F.col("n")).otherwise(0).alias("candidates"))
    return items.select(key).join(found, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def best_match(items: DataFrame, candidates: DataFrame, least: float = 0.85, first: int = 5, key: str = "item") -> DataFrame:
    """Per item with one: the most alike of its first candidates, if alike enough."""
    rows = scored(items, candidates.where(F.col("place") < first), least, key).where(F.col("confidence") >= least)
    return rows.groupBy(key).agg(F.max(F.struct("confidence", -F.col("place"), "candidate")).alias("m")).select(key, F.col("m.candidate").alias("match"), F.col("m.confidence").alias("confidence"))


def staging_cascade(rows: DataFrame, papers: DataFrame, key: str = "staging_id") -> DataFrame:
    """How each staging row is matched: by a work id in its source id or URL, then a DOI, then an equal title; else why not."""
    work = F.coalesce(ids.strict_work_id(F.col("source_id")), ids.strict_work_id(F.col("url")))
    found_doi = F.coalesce(ids.match_doi(F.col("doi")), ids.match_doi(ids.find_doi(F.col("source_id"))), ids.match_doi(ids.find_doi(F.col("url"))))
    title = F.nullif(title_key(F.coalesce("title", F.lit(""))), F.lit(""))
    own = rows.select(key, work.alias("w"), found_doi.alias("d"), title.alias("t"))
    by_id = papers.select(F.col("paperId").alias("w"), F.col("paperId").alias("m1")).distinct()
    by_doi = papers.where("doi <> ''").groupBy(ids.match_doi(F.col("doi")).alias("d")).agg(F.min("paperId").alias("m2"))
    by_title = papers.groupBy(title_key(F.col("title")).alias("t")).agg(F.min("paperId").alias("m3"))
    out = own
    for by, found, name in (("w", by_id, "m1"), ("d", by_doi, "m2"), ("t", by_title, "m3")):
        out = with_key(out, found, by, name)
    how = F.when(F.col("m1").isNotNull(), "id").when(F.col("m2").isNotNull(), "doi").when(F.col("m3").isNotNull(), "title").when(F.coalesce("w", "d", "t").isNull(), "nothing to match by").otherwise("no match")
    return out.select(key, F.coalesce("m1", "m2", "m3").alias("match"), how.alias("how"))
