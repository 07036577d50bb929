"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte trigrams (A-Z lower-cased), weighted by TF-IDF and normalised.
Each language has a few centroids, found by spherical k-means; a text gets the language of the
centroid with the largest cosine. A text that is farther from its centroid than nearly all of that
centroid's own members is rejected.

Defined results: a null text, or one without a letter, gets ``und`` with score 0 and is rejected;
ties go to the first language in alphabetical order; with nothing to learn from, all texts get
``und``. Repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm import common

#: Hashed trigrams.
DIMS = 1 << 13
#: Labelled texts for each language, about, that the centroids are fitted on.
SAMPLE = 800
#: Centroids for each language.
CLUSTERS = 3
#: A text is rejected if its cosine is under this share of the lowest of its centroid's members (the 0.1 % quantile).
REJECT_SHARE = 0.5


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    floor: np.ndarray


def _grams(raw: np.ndarray) -> np.ndarray:
    """Counts of a text's hashed trigrams."""
    x = _LOWER[raw]
    if len(x) < 3:
        x = np.concatenate([x, np.zeros(3 - len(x), np.uint32)])
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(19), minlength=DIMS)


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in common.small_batches(batches, column):
        raw, off = common.text_bytes(batch.column(batch.schema.get_field_index(column)))
        yield batch, [raw[a:b] for a, b in zip(off, off[1:])]


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for _, texts in _texts(batches):
        for raw in texts:
            total += _grams(raw) > 0
            n += 1
    yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(-1, DIMS), pa.int32()), "df": pa.array(np.concatenate([[n], total]), pa.int64())})


def _vector(raw: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = _grams(raw)
    at = np.flatnonzero(count)
    v = (np.log1p(count[at]) * idf[at]).astype(np.float32)
    norm = float(np.sqrt((v * v).sum()))
    return at, v / norm if norm else v


def _cluster(idf: np.ndarray, k: int):
    """Spherical k-means over the bounded sample of one language."""

    def run(batch: pa.Table) -> pa.Table:
        rows = batch.sort_by([("key", "ascending"), ("text", "ascending")])
        raw, off = common.text_bytes(rows.column("text"))
        x = np.zeros((rows.num_rows, DIMS), np.float32)
        for i, (a, b) in enumerate(zip(off, off[1:])):
            at, v = _vector(raw[a:b], idf)
            x[i, at] = v
        c = x[[0]]
        while len(c) < min(k, len(x)):  # the farthest text from those so far
            c = np.concatenate([c, x[[int(np.argmin((x @ c.T).max(1)))]]])
        for _ in range(8):
            who = np.argmax(x @ c.T, 1)
            c = np.stack([x[who == j].sum(0) if (who == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = x @ c.T
        who = np.argmax(near, 1)
        floor = [float(np.quantile(near[who == j, j], 0.001)) if (who == j).any() else 0.0 for j in range(len(c))]
        return pa.table({"lang": [rows.column("lang")[0].as_py()] * len(c), "vector": pa.array(list(c), pa.list_(pa.float32())), "floor": floor})

    return run


def fit(docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """IDF over all texts that train holds for; centroids on about sample of them per language."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    found = rows.select("text").mapInArrow(_df, "dim int, df bigint").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMS + 1, np.int64)
    for r in found:
        df[r["dim"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    counts = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(sample) / F.col("count")).alias("share"))
    chosen = rows.join(F.broadcast(counts), "lang").where(common.rate_filter(F.struct("key", "text"), F.col("share"))).drop("share")
    chosen = chosen.dropDuplicates(["lang", "key", "text"])  # a row that repeats is drawn with all of its copies; one of them is enough
    got = chosen.groupBy("lang").applyInArrow(_cluster(idf, clusters), "lang string, vector array<float>, floor double").collect()
    got.sort(key=lambda r: r["lang"])
    return Model(idf, [r["lang"] for r in got], np.array([r["vector"] for r in got], np.float32).reshape(len(got), DIMS), np.array([r["floor"] for r in got]))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine) and rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.idf, model.langs, np.ascontiguousarray(model.centroids.T), model.floor))
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    source = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names) if c != text], F.col(f"`{text}`").alias("__text"), F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False)).alias("__letter"))
    sent = ["__text" if c == text else f"__{i}" for i, c in enumerate(names)]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in names], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, matrix, floor = shared.value
        for batch, texts in _texts(batches, "__text"):
            pred, score, rejected = [], [], []
            for raw, letter in zip(texts, batch.column("__letter").to_pylist()):
                if not letter or not langs:
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                at, v = _vector(raw, idf)
                near = v @ matrix[at]
                j = int(np.argmax(near))
                pred.append(langs[j]), score.append(float(min(1.0, max(0.0, near[j])))), rejected.append(bool(near[j] < REJECT_SHARE * floor[j]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in sent], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)
