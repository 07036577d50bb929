"""Documents through language, quality, near duplicates, benchmark items and tokens, stage by stage.

A null or empty text goes with the first stage; a table without rows gives one without rows; repeated
rows meet in the third. Columns beyond those of ``documents`` are carried along, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import common, decontaminate, jaccard, langid, quality, registry, sentencepieces


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, F.lit(True))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    found = langid.identify(docs.select(others, "text"), model)
    return found.where(~F.col("rejected")).select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("print")))
    return common.matching(docs, judged.where("kept").select("doc_id", "print"), "left_semi", key="doc_id", text="text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, n=5, percent=80)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, registry.piece_model(), keep=["doc_id", "lang", "source"], digests=True)


STAGES = [("language", language), ("quality", quality_rules), ("near duplicates", near_duplicates), ("benchmark", benchmark_items), ("pieces", pieces)]

#: SQL can express neither the centroids, the robust estimates nor the pieces: the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs, name.replace(" ", "-"))
    return docs
