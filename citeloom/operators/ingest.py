"""Ingest, mutation, data quality and retraction screening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import ids
from citeloom.operators.keys import with_key


def valid_papers(papers: DataFrame) -> DataFrame:
    return papers.where(F.coalesce(F.trim("paperId") != "", F.lit(False)) & F.col("title").isNotNull())


def upsert(old: DataFrame, new: DataFrame, key: str = "paperId", sticky: tuple[str, ...] = ("processed", "isSeed", "selected")) -> DataFrame:
    """new's rows replace old's; flags that were set stay set (sticky=() for the last writer)."""
    rows = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__v").alias("r"), *[F.max(F.coalesce(c, F.lit(False))).alias(f"__{c}") for c in sticky])
    return last.select(key, *[F.col(f"__{c}").alias(c) if c in sticky else F.col(f"r.{c}").alias(c) for c in rest])


def remove_papers(papers: DataFrame, references: DataFrame, citations_in: DataFrame, unwanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = unwanted.select("paperId").distinct()

    def without(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.join(gone.withColumnRenamed("paperId", c), c, "left_anti")
        return df

    return without(papers, "paperId"), without(references, "paperId", "referencePaperId"), without(citations_in, "paperId", "citingPaperId")


def connected_papers(papers: DataFrame, references: DataFrame, citations_in: DataFrame) -> DataFrame:
    ends = references.select("paperId").union(references.select("referencePaperId")).union(citations_in.select("paperId")).union(citations_in.select("citingPaperId"))
    return papers.join(ends, "paperId", "left_semi")


def cascade(papers: DataFrame, references: DataFrame, citations_in: DataFrame, paper_author: DataFrame, authors: DataFrame, unwanted: DataFrame) -> dict[str, DataFrame]:
    """All frames without the unwanted papers, then without papers and authors that nothing links to."""
    left, refs, cites = remove_papers(papers, references, citations_in, unwanted)
    left = connected_papers(left, refs, cites)
    own = paper_author.join(left.select("paperId"), "paperId", "left_semi")
    return {"papers": left, "references": refs, "citations_in": cites, "paper_author": own, "authors": authors.join(own, "authorId", "left_semi"), "removed": papers.select("paperId").subtract(left.select("paperId"))}


def dedup_key(doi: str = "doi", source_type: str = "source_type", source_id: str = "source_id", title: str = "title", year: str = "year"):
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    by_source = F.when(some(source_id).isNotNull(), F.concat_ws("|", F.lit("s"), source_type, source_id))
    by_title = F.when(some(title).isNotNull(), F.concat_ws("|", F.lit("t"), F.lower(some(title)), F.col(year).cast("string")))
    return F.coalesce(F.concat(F.lit("d"), F.lower(some(doi))), by_source, by_title)


def insert_staging(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The rows of new that get in: the first of each key, unless it exists; rows without a key always."""
    keyed = new.withColumn("__k", dedup_key())
    first = keyed.where("__k is not null").groupBy("__k").agg(F.min_by(F.struct(*new.columns), order).alias("r"))
    fresh = first.join(existing.select(dedup_key().alias("__k")), "__k", "left_anti").select("r.*")
    return fresh.unionByName(keyed.where("__k is null").drop("__k"))


def completeness(df: DataFrame, columns: list[str]):
    """The share of columns that say something: text that isn't empty, lists with elements, any number."""
    kinds = dict(df.dtypes)
    said = [F.coalesce(F.size(c) > 0, F.lit(False)) if kinds[c].startswith("array") else ids.presence(F.col(c).cast("string")) for c in columns]
    return sum((x.cast("int") for x in said), F.lit(0)) / len(columns)


def retraction_hits(papers: DataFrame, retractions: DataFrame) -> DataFrame:
    """papers with retracted and the reason of the first matching row, over both DOIs of each row."""
    pairs = retractions.select(F.explode(F.array(ids.match_doi(F.col("RetractionDOI")), ids.match_doi(F.col("OriginalPaperDOI")))).alias("k"), "Reason").where("k is not null")
    first = pairs.groupBy("k").agg(F.min("Reason").alias("reason"))
    return with_key(papers.withColumn("k", ids.match_doi(F.col("doi"))), first, "k", "reason").withColumn("retracted", F.col("reason").isNotNull()).drop("k")


def forbidden(marked: DataFrame, sampler: bool, text: bool) -> DataFrame:
    return marked.where("retracted").select("paperId", "doi", F.lit("Retracted").alias("reason"), F.lit(sampler).alias("sampler"), F.lit(text).alias("textProcessing"))


def reconcile(requested: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        requested = requested.subtract(o)
    return requested


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; one aggregate, no window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def previous_marks(old: DataFrame, update: DataFrame) -> DataFrame:
    """Marks after an update; 'standard' deletes an entry."""
    rows = old.withColumn("__v", F.lit(0)).unionByName(update.withColumn("__v", F.lit(1)))
    return rows.groupBy("paperId").agg(F.max_by("mark", "__v").alias("mark")).where("mark <> 'standard'")


def expired(sessions: DataFrame, now, hours: float, at: str = "updated_at") -> DataFrame:
    return sessions.where(F.timestamp_diff("SECOND", F.col(at), F.lit(now)) / 3600 >= hours)
