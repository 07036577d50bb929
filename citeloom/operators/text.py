"""Text cleaning, TF-IDF, venues, similarity and a recommender."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.names import nearest
from citeloom.operators.scratch import cut_lineage

# Patterns in the order in which they apply.
CLEAN = ["<jats:[^>]+>", "(?U)[^\\w\\s]"]
VENUE = [
    ("^(springer|elsevier|acm|mdpi|ieee)\\s*[:\\-]\\s*", ""),
    ("^\\d{4}\\s+", ""),
    ("\\s+\\d{4}$", ""),
    ("^(in:|proceedings of|proc\\.?)\\s+", ""),
    ("\\(?\\d+\\s*\\(\\d+\\)\\)?", " "),
    ("(pp\\.?|pages)\\s*\\d+(\\s*[-–]\\s*\\d+)?", " "),
    ("\\(.*?\\)", " "),
    ("[^a-z0-9\\s]", " "),
    ("\\s+", " "),
]


def clean(c: Column, patterns: list[str] | None = None) -> Column:
    for p in CLEAN if patterns is None else patterns:
        c = F.regexp_replace(c, p, "")
    return c


def valid(c: Column, least: int = 120, word: str = "none") -> Column:
    """Not null, long enough after cleaning, and without the word anywhere."""
    return F.coalesce(~F.contains(F.lower(c), F.lit(word)) & (F.length(clean(c)) >= least), F.lit(False))


def terms(df: DataFrame, text: str, key: str, stop: list[str] = (), ngrams: int = 1) -> DataFrame:
    """(key, term, n): counts of words of two characters or more, and of pairs of them."""
    words = F.regexp_extract_all(F.lower(text), F.lit("(?U)\\b\\w\\w+\\b"), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(list(stop)))
    df = df.select(key, words.alias("w"))
    grams = F.col("w")
    if ngrams > 1:
        pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
        grams = F.concat("w", pairs)
    return df.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


#: Terms up to so many have their frequencies broadcast.
HELD = 1 << 16


def tf_idf(counts: DataFrame, key: str, documents: int) -> DataFrame:
    """Smoothed IDF (ln((1+n)/(1+df))+1), rows of unit length."""
    told = Observation()
    df = cut_lineage(counts.groupBy("term").agg(F.count("*").alias("df")).observe(told, F.count("*").alias("n")), "frequencies")
    w = counts.join(F.broadcast(df) if told.get["n"] <= HELD else df, "term").withColumn("w", F.col("n") * (F.log((1.0 + documents) / (1 + F.col("df"))) + 1))
    # One number for each row of terms: looked up, so that terms aren't sorted.
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).hint("shuffle_hash")
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def clean_venue(c: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for pattern, by in VENUE:
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def normalise_venue(df: DataFrame, venue: str, aliases: DataFrame, names: list[str] = ()) -> DataFrame:
    """df with venue_normal: an alias, else one of the names that is nearly alike, else the cleaned name with capitals, else the name as it is."""
    done = df.withColumn("__c", clean_venue(F.col(venue))).join(aliases.withColumnsRenamed({"alias": "__c"}), "__c", "left")
    return done.withColumn("venue_normal", F.when(F.col("__c") == "", F.trim(venue)).otherwise(F.coalesce("canonical", nearest(F.col("__c"), list(names)), F.initcap("__c")))).drop("__c", "canonical")


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "(?U)[^\\w\\s]", " "), "\\s+", " "))


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two normalised titles; 0 where one is empty."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def cosine_top(df: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.lit([float(x) for x in query])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    score = dot(F.col(vector), q) / F.sqrt(dot(F.col(vector), F.col(vector)) * dot(q, q))
    return df.select(key, score.alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def linucb(df: DataFrame, feedback: DataFrame, alpha: float = 1.0, ridge: float = 1.0, key: str = "vec_id", vector: str = "embedding", reward: str = "reward") -> DataFrame:
    """(key, score): upper confidence of a linear bandit; rows with feedback are left out."""
    import numpy as np

    dim = len(df.select(vector).first()[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((dim, dim)), np.zeros(dim)
        for p in batches:
            x = np.stack(p[vector]).astype(float)
            a, b = a + x.T @ x, b + p[reward].to_numpy(float) @ x
        yield pd.DataFrame({"i": range(dim), "a": list(a), "b": b})

    # Each partition gives dim rows, which are added up in the cluster: dim rows come back whatever the input.
    parts = df.join(feedback, key).select(vector, reward).mapInPandas(sums, "i int, a array<double>, b double")
    added = parts.select("i", "b", F.posexplode("a").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("b").alias("b")).collect()
    a, b = ridge * np.eye(dim), np.zeros(dim)
    for r in added:
        a[r["i"], r["j"]] += r["v"]
        b[r["i"]] = r["b"]
    inv, theta = np.linalg.inv(a), np.linalg.solve(a, b)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v).astype(float)
        return pd.Series(x @ theta + alpha * np.sqrt(np.einsum("ij,jk,ik->i", x, inv, x)))

    return df.join(feedback.select(key), key, "left_anti").select(key, score(vector).alias("score"))
