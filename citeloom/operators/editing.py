"""Flags, staging edits, seeds and the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRACTION = ("is_retracted", "retraction_reason", "retraction_date", "retraction_doi")


def set_flag(papers: DataFrame, wanted: DataFrame, *flags: str) -> DataFrame:
    """papers with the flags set where the paper is wanted."""
    hit = wanted.select("paperId", F.lit(True).alias("hit__")).distinct()
    return papers.join(hit, "paperId", "left").withColumns({f: F.coalesce("hit__", f) for f in flags}).drop("hit__")


def mark_failed(papers: DataFrame, failed: DataFrame) -> DataFrame:
    hit = failed.select("paperId", F.lit(True).alias("hit__")).distinct()
    return papers.join(hit, "paperId", "left").withColumn("processed", F.when(F.col("hit__"), False).otherwise(F.col("processed"))).drop("hit__")


def unflagged(papers: DataFrame, retrieved: DataFrame, flag: str) -> DataFrame:
    """How many of the retrieved papers lack a flag, and whether the tables agree."""
    n = F.count_if(~F.coalesce(flag, F.lit(False)))
    return papers.join(retrieved.select("paperId"), "paperId", "left_semi").agg(n.alias("missing"), (n == 0).alias("consistent"))


def edit_staging(rows: DataFrame, edits: DataFrame, key: str = "staging_id") -> DataFrame:
    """rows with the edited DOIs; a changed DOI clears what was known of a retraction."""
    joined = rows.join(edits.select(key, F.col("doi").alias("new__")), key, "left")
    changed = F.col("new__").isNotNull() & ~F.col("new__").eqNullSafe(F.col("doi"))
    cleared = {c: F.when(~changed, F.col(c)) for c in RETRACTION if c in rows.columns}
    return joined.withColumns(cleared | {"doi": F.coalesce("new__", "doi")}).drop("new__")


def fill(rows: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with found's values where their own are null or empty."""
    other = found.select(key, *[F.col(c).alias(f"{c}__") for c in columns])
    return rows.join(other, key, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), f"{c}__") for c in columns}).drop(*[f"{c}__" for c in columns])


def add_seeds(seeds: DataFrame, new: DataFrame) -> DataFrame:
    """added, duplicate and total, as one row."""
    known = seeds.select("paperId", F.lit(1).alias("known")).distinct()
    met = new.select("paperId").distinct().join(known, "paperId", "full").agg(F.count_if(F.col("known").isNull()).alias("added"), F.count("*").alias("total"))
    return met.crossJoin(new.agg(F.count("*").alias("asked"))).select("added", (F.col("asked") - F.col("added")).alias("duplicate"), "total")  # one row beside one row


def frontier(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """Known ids among those asked for (pos, paperId), trimmed, each at its first place."""
    tidy = asked.select("pos", F.trim("paperId").alias("paperId")).groupBy("paperId").agg(F.min("pos").alias("pos"))
    return tidy.join(papers.select("paperId"), "paperId", "left_semi")


def venue_of(work: str = "work") -> Column:
    """The first name among a work's primary location, its locations and its best open one."""
    other = F.filter(F.col(f"{work}.locations"), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.nullif(F.col(f"{work}.primary"), F.lit("")), F.try_element_at(other, F.lit(1)), F.nullif(F.col(f"{work}.best_oa"), F.lit("")), F.lit(""))
