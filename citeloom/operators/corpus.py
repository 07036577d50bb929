"""The citation corpus as DataFrames, made here from the order tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _authorship(rows: DataFrame) -> DataFrame:
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return rows.select(c("W", "l_partkey").alias("paperId"), c("A", "l_suppkey").alias("authorId"))


@dataclass(frozen=True)
class Corpus:
    """papers, edge frames and authors; each lazily derived, so that a query scans what it needs."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        first = self.table("lineitem").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("y"))
        k = F.col("p_partkey")
        kind = F.when(k % 6 == 0, " survey").when(k % 6 == 1, " benchmark").when(k % 6 == 2, " review").otherwise("")
        return self.table("part").join(first, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.concat(F.lit("W"), k.cast("string")).alias("paperId"),
            F.when(k % 5 != 0, F.concat(F.lit("10.5555/"), F.lower("p_type"), F.lit("."), k.cast("string"))).otherwise("").alias("doi"),
            F.when(k % 11 == 0, "").otherwise(F.col("p_brand")).alias("venue"),
            F.col("y").cast("int").alias("year"),
            F.concat("p_name", kind).alias("title"),
            (k % 3 == 0).alias("processed"), (k % 97 == 0).alias("isSeed"), (k % 7 == 0).alias("selected"),
            F.col("p_type").alias("topic"),
        )

    @cached_property
    def _met(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        nxt = line.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("cited"))
        return line.join(nxt, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n"))).where("l_partkey <> cited").select("l_partkey", "cited", (F.col("l_orderkey") % 2).alias("side"))

    @cached_property
    def _pairs(self) -> DataFrame:
        w = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
        # Numbers are compared and shuffled for less than what is written with them.
        return self._met.distinct().select(w("l_partkey").alias("citing"), w("cited").alias("cited"), "side")

    @cached_property
    def references(self) -> DataFrame:
        return self._pairs.where("side = 0").select(F.col("citing").alias("paperId"), F.col("cited").alias("referencePaperId"))

    @cached_property
    def citations_in(self) -> DataFrame:
        return self._pairs.where("side = 1").select(F.col("cited").alias("paperId"), F.col("citing").alias("citingPaperId"))

    @cached_property
    def edges(self) -> DataFrame:
        """References and reversed citations: a pair seen from both sides counts twice."""
        return self._pairs.select(F.col("citing").alias("paperId"), F.col("cited").alias("referencePaperId"))

    @cached_property
    def links(self) -> DataFrame:
        """What references and reversed citations hold, in any number: for whoever makes it distinct anyway."""
        w = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
        return self._met.where("side in (0, 1)").select(w("l_partkey").alias("paperId"), w("cited").alias("referencePaperId"))

    @property
    def _signed(self) -> DataFrame:
        return self.table("lineitem").where("l_suppkey % 4 = l_partkey % 4").select("l_partkey", "l_suppkey")

    @cached_property
    def paper_author(self) -> DataFrame:
        return _authorship(self._signed.distinct())

    @cached_property
    def authorships(self) -> DataFrame:
        """What paper_author holds, in any number: for whoever makes it distinct anyway."""
        return _authorship(self._signed)

    @cached_property
    def authors(self) -> DataFrame:
        return self.table("supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("authorId"), F.col("s_name").alias("authorName"))

    @cached_property
    def marks(self) -> DataFrame:
        k = F.col("paperId").substr(F.lit(2), F.lit(20)).cast("long")
        return self.papers.where(k % 4 != 3).select("paperId", F.when(k % 4 == 0, "good").when(k % 4 == 1, "bad").otherwise("neutral").alias("mark"))

    @cached_property
    def retractions(self) -> DataFrame:
        k = F.col("paperId").substr(F.lit(2), F.lit(20)).cast("long")
        return self.papers.where((k % 53 == 0) & (F.col("doi") != "")).select(F.concat(F.lit("10.9999/r."), k.cast("string")).alias("RetractionDOI"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("OriginalPaperDOI"), F.concat(F.lit("reason "), (k % 3).cast("string")).alias("Reason"))
