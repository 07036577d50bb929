"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import archives, chat, collocations, common, decontaminate, jaccard, langid, licenses, maxent, neardup, oracles, quality, resampling, sentencepieces, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(oracles.SQL)


def query(f):
    QUERIES[f.__name__] = f
    return f


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return sentencepieces.encode(docs, piece_model(), keep=["doc_id"], ids=False, digests=True)


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    test = common.held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~test)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", test.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("found")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(odd).alias("text")) for i, role in enumerate(("user", "assistant"))])))
    own = own.select(*[F.col(c).cast(t) for c, t in rows.dtypes])
    made = chat.format_conversations(rows.unionByName(own))
    said = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length(said).cast("bigint").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return archives.round_trip(pages, least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    test = common.held_out(F.col("doc_id"), 5, 0)
    index, keys = toxicity.fit(docs, labels, ~test)
    return toxicity.score(docs.select("doc_id", test.alias("held_out"), "text"), index, keys)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items).select("doc_id", "item_id", "meetings", "item_windows", "altered")


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(common.table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    test = common.held_out(F.col("doc_id"), 7, 2)
    model, words = maxent.fit(docs, ~test)
    return maxent.score(docs.select("doc_id", test.alias("held_out"), "text"), model, words, train=~test)


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(docs, target).drop("n_words")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op12_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(common.table(spark, sf_dir, "embeddings"), cosine=0.93)
