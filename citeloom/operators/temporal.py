"""Periods and topic evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fixed_periods(papers: DataFrame, width: int, keep_partial: bool = True) -> DataFrame:
    span = papers.where("year is not null").agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null")
    starts = span.select(F.explode(F.sequence("a", "b", F.lit(width))).alias("start_year"), "b")
    out = starts.select("start_year", F.least(F.col("start_year") + width - 1, "b").alias("end_year"), (F.col("start_year") + width - 1 > F.col("b")).alias("partial"))
    return label(out if keep_partial else out.where(~F.col("partial")))


def label(periods: DataFrame) -> DataFrame:
    return periods.select("start_year", "end_year", F.when(F.col("start_year") == F.col("end_year"), F.col("start_year").cast("string")).otherwise(F.concat_ws("-", "start_year", "end_year")).alias("label"))


def adaptive_periods(papers: DataFrame, width: int, least: int) -> DataFrame:
    """Periods that grow until they hold enough papers; the histogram has a row per year."""
    years = {r["year"]: r["n"] for r in papers.where("year is not null").groupBy("year").agg(F.count("*").alias("n")).collect()}
    found, start = [], min(years, default=0)
    while years and start <= max(years):
        end = start + width - 1
        held = lambda: sum(n for y, n in years.items() if start <= y <= end)  # noqa: B023,E731
        while held() < least and end < max(years):
            end += 1
        if held() >= least:
            found.append((start, end))
        start = end + 1
    return label(papers.sparkSession.createDataFrame(found, "start_year int, end_year int"))


def custom_periods(spark: SparkSession, periods: list[tuple[int, int]]) -> DataFrame:
    return label(spark.createDataFrame(sorted(periods), "start_year int, end_year int"))


def custom_periods_of(rows: DataFrame, start: str = "start_year", end: str = "end_year") -> DataFrame:
    """As custom_periods of a table's rows: each distinct period that begins before it ends, or with it."""
    given = rows.select(F.col(start).cast("int").alias("start_year"), F.col(end).cast("int").alias("end_year")).where("start_year <= end_year").distinct()
    return label(given)


def assign(papers: DataFrame, periods: DataFrame) -> DataFrame:
    """papers with the label of the first period that holds their year: years, not papers, meet periods."""
    years = papers.select("year").distinct().join(F.broadcast(periods), F.col("year").between(F.col("start_year"), F.col("end_year")))  # a row per year and period
    first = years.groupBy("year").agg(F.min_by("label", "start_year").alias("period"), F.min("start_year").alias("start_year"))
    return papers.join(F.broadcast(first), "year")


def shares(papers: DataFrame, periods: DataFrame, least: int = 2) -> DataFrame:
    """(period, start_year, topic, share): every topic in every period with at least that many papers; shares sum to 1."""
    counts = assign(papers, periods).groupBy("period", "start_year", "topic").agg(F.count("*").alias("n"))
    size = counts.groupBy("period", "start_year").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("topic").isNotNull(), F.col("n"))).alias("labelled")).where(F.col("size") >= least)
    topics = papers.where("topic is not null").select("topic").distinct()
    grid = size.crossJoin(topics)  # periods by topics
    return grid.join(counts.select("period", "topic", "n"), ["period", "topic"], "left").select("period", "start_year", "topic", (F.coalesce("n", F.lit(0)) / F.col("labelled")).alias("share"))


def trends(share: DataFrame) -> DataFrame:
    """Per topic: the first and last share and whether it emerges or declines."""
    ends = share.groupBy("topic").agg(F.min_by("share", "start_year").alias("first"), F.max_by("share", "start_year").alias("last"), F.avg("share").alias("mean"), F.count("*").alias("periods"))
    change = (F.col("last") - F.col("first")) / F.when(F.col("first") > 0, F.col("first"))
    more = F.col("periods") >= 2
    return ends.withColumn("emerging", more & F.when(F.col("first") > 0, change >= 0.5).otherwise(F.col("last") > 0.1)).withColumn("declining", more & F.coalesce(-change >= 0.5, F.lit(False)))


def topic_years(papers: DataFrame) -> DataFrame:
    n = papers.where("topic is not null and year is not null").groupBy("year", "topic").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("year")))  # a year has a row per topic


def topic_activity(papers: DataFrame) -> DataFrame:
    n = papers.where("topic is not null and year is not null").groupBy("topic", "year").agg(F.count("*").alias("n"))
    return n.groupBy("topic").agg(F.sum("n").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.max("n").alias("peak"))


def evolution(papers: DataFrame, periods: DataFrame, least: int = 5) -> DataFrame:
    """shares, of papers that are enough: at the least so many, so many with a year, and some topic."""
    n = papers.agg(F.count("*").alias("all"), F.count("topic").alias("topic"), F.count("year").alias("year")).first()
    if n["all"] < least:
        raise ValueError("too few papers")
    if not n["topic"]:
        raise ValueError("no paper has a topic")
    if n["year"] < least:
        raise ValueError("too few papers have a year")
    return shares(papers, periods)
