"""Words of texts in a language, topics and their labels.

Defined results: null and empty texts are in no language and have no topic; ties go to the first in
order (language, topic number, name); tables without rows give none.
"""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.languages import stems

def words_of(text: Column) -> Column:
    return F.split(F.lower(text), "\\s+")


def in_language(docs: DataFrame, wanted: str, text: str = "text", stemmed: bool = False) -> DataFrame:
    """The words of valid rows in a language, or their stems: docs has valid and lang."""
    words = F.filter(words_of(F.col(text)), lambda w: w != "")
    return docs.where(F.col("valid") & (F.col("lang") == wanted)).withColumn("words", stems(words) if stemmed else words)


def lda(docs: DataFrame, k: int, rounds: int = 10, prior: float = 0.8, key: str = "doc_id", words: str = "words", seed: int = 7, least: int = 1, vocabulary: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(key, topic, share) and (topic, place, term, weight) by latent Dirichlet allocation over the words that stand in
    least rows at least. The model is kept on the driver, so words beyond the commonest ``vocabulary`` have no part in it."""
    if docs.where(F.size(words) > 0).isEmpty():
        return docs.select(key, F.lit(0).alias("topic"), F.lit(0.0).alias("share")).where("false"), docs.sparkSession.createDataFrame([], "topic int, place int, term string, weight double")
    counted = CountVectorizer(inputCol=words, outputCol="features", minDF=least, vocabSize=vocabulary).fit(docs)
    ready = counted.transform(docs.where(F.size(words) > 0)).select(key, "features")
    model = LDA(k=k, maxIter=rounds, docConcentration=[prior] * k, seed=seed, optimizer="online").fit(ready)
    mix = vector_to_array("topicDistribution")
    best = F.array_max(F.transform(mix, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    found = model.transform(ready).select(key, (-best["i"]).alias("topic"), best["v"].alias("share"))
    # Of the vocabulary only the few words that describe a topic go into a plan.
    tops = [(r.topic, place, counted.vocabulary[i], w) for r in model.describeTopics(8).collect() for place, (i, w) in enumerate(zip(r.termIndices, r.termWeights), 1)]
    return found, docs.sparkSession.createDataFrame(tops, "topic int, place int, term string, weight double")


def topic_column(papers: DataFrame, assigned: DataFrame, key: str = "paperId") -> DataFrame:
    """papers with topic_id: that assigned, else -1."""
    return papers.join(assigned.select(key, F.col("topic").alias("topic_id")), key, "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))


def grouped(papers: DataFrame, key: str = "paperId") -> DataFrame:
    """(topic_id, papers, first_paper) of papers with a topic column."""
    return papers.groupBy("topic_id").agg(F.count("*").alias("papers"), F.min(key).alias("first_paper"))


def concepts(rows: DataFrame, group: str, level: int = 2, n: int = 2) -> DataFrame:
    """The n commonest concepts of a level or more in each group: group, place, name, n. rows has concepts (name, level)."""
    flat = rows.select(group, F.explode("concepts").alias("c")).where((F.col("c.level") >= level) & (F.trim("c.name") != ""))
    counted = flat.groupBy(group, F.col("c.name").alias("name")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "name"))
    return counted.withColumn("place", rank).where(F.col("place") <= n)


def labels(groups: DataFrame, group: str, sources: list[DataFrame]) -> DataFrame:
    """group and label: of the first source (group, place, name) that has names for it, the first two; else Cluster_ and its number."""
    out = groups.select(group).distinct()
    for i, s in enumerate(sources):
        names = s.where("place <= 2").groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " & ").alias(f"l{i}"))
        out = out.join(names, group, "left")
    return out.select(group, F.coalesce(*[f"l{i}" for i in range(len(sources))], F.concat(F.lit("Cluster_"), F.col(group).cast("string"))).alias("label"))


def catalog(papers: DataFrame, assigned: DataFrame, centralities: DataFrame, key: str = "paperId") -> DataFrame:
    """The final catalog: papers with their topic (-1 for none), of those that have centralities."""
    return topic_column(papers, assigned, key).join(centralities.select(F.col("id").alias(key), "centrality_in", "centrality_out"), key)


def of_type(centralities: DataFrame, nodes: DataFrame, ntype: str) -> DataFrame:
    """(id, centrality_in, centrality_out) of the nodes of a type."""
    return centralities.join(nodes.where(F.col("ntype") == ntype).select("id"), "id", "left_semi")


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, low, middle, high) of each column's values."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.percentile("v", 0.5).alias("middle"), F.max("v").alias("high"))


def default_sort(columns: list[str]) -> str:
    return next((c for c in ("centrality_out", "centrality_in", "year") if c in columns), "paperId")
