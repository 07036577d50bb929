"""Readers of files, and what a provider of works answers, as joins over works tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.functions import ids
from citeloom.operators.batches import small


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a text file with one in each line."""
    return spark.read.text(path).select(F.trim("value").alias("paperId")).where("paperId <> ''").distinct()


def frame(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table of a checkpoint; one without rows where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def retraction_csv(spark: SparkSession, path: str) -> DataFrame:
    """RetractionDOI, OriginalPaperDOI (both bare and lower-case) and Reason of rows with a DOI."""
    raw = spark.read.csv(path, header=True)
    return clean_retractions(raw)


def clean_retractions(raw: DataFrame) -> DataFrame:
    bare = lambda c: F.nullif(ids.match_doi(F.col(c)), F.lit("")).alias(c)
    return raw.select(bare("RetractionDOI"), bare("OriginalPaperDOI"), "Reason").where(F.coalesce("RetractionDOI", "OriginalPaperDOI").isNotNull())


def marks(json: DataFrame, column: str = "value") -> DataFrame:
    """paperId and mark of JSON objects that map one to the other."""
    return json.select(F.explode(F.from_json(column, "map<string,string>")).alias("paperId", "mark"))


def references_of(papers: DataFrame, references: DataFrame, wanted: DataFrame) -> DataFrame:
    """The works that wanted papers refer to, with their metadata."""
    of = references.join(wanted.select("paperId"), "paperId", "left_semi").select(F.col("referencePaperId").alias("paperId"))
    return papers.join(of, "paperId", "left_semi")


def citing_works(papers: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The works that refer to wanted papers, with their metadata."""
    of = edges.join(wanted.select(F.col("paperId").alias("referencePaperId")), "referencePaperId", "left_semi")
    return papers.join(of, "paperId", "left_semi")


def works_page(papers: DataFrame, owners: DataFrame, page: int, size: int = 200) -> DataFrame:
    """A page (from 1) of at most 200 works of the owners' (author or venue) papers, newest first."""
    size = min(size, 200)
    return papers.join(owners, "paperId", "left_semi").orderBy(F.desc_nulls_last("year"), "paperId").offset((page - 1) * size).limit(size)


def best_match(authors: DataFrame, name: str, measure: str) -> DataFrame:
    """Of the authors whose name has the words, that with the largest measure (then the smallest id)."""
    found = authors.where(F.lower("authorName").contains(name.lower()))
    return found.orderBy(F.desc_nulls_last(measure), "authorId").limit(1)


def latex(text: str = "text"):
    """title, authors, abstract and year of a LaTeX source."""
    c = F.col(text)
    inner = lambda name: F.nullif(F.trim(F.regexp_extract(c, f"(?s)\\\\{name}\\{{(.*?)\\}}", 1)), F.lit(""))
    year = F.regexp_extract(c, "\\\\date\\{[^}]*?((?:19|20)\\d\\d)", 1)
    names = F.transform(F.split(F.coalesce(inner("author"), F.lit("")), "\\\\and|,"), lambda x: F.trim(x))
    return F.struct(inner("title").alias("title"), F.filter(names, lambda x: x != "").alias("authors"), F.nullif(F.trim(F.regexp_extract(c, "(?s)\\\\begin\\{abstract\\}(.*?)\\\\end\\{abstract\\}", 1)), F.lit("")).alias("abstract"), F.nullif(year, F.lit("")).cast("int").alias("year"))


def inverted_index(docs: DataFrame, key: str, text: str, gaps: bool) -> DataFrame:
    """key and index (a map from word to positions) of each text that isn't null, row by row; gaps: empty words, between two spaces, have no entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            lists = pc.split_pattern(batch.column(text), " ")
            n = pc.list_value_length(lists).to_numpy()
            of, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            words = pc.dictionary_encode(lists.flatten())
            code = words.indices.to_numpy()
            if gaps:
                full = pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
                of, at, code = of[full], at[full], code[full]
            by = of * len(words.dictionary) + code
            order = np.argsort(by, kind="stable")
            new = np.flatnonzero(np.diff(by[order], prepend=-1))
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(by)), pa.int32()), pa.array(at[order], pa.int32()))
            held = np.append(0, np.cumsum(np.bincount(of[order][new], minlength=len(n))))
            index = pa.MapArray.from_arrays(pa.array(held, pa.int32()), words.dictionary.take(pa.array(code[order][new])), places)
            yield pa.RecordBatch.from_arrays([batch.column(key), index], names=[key, "index"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, index map<string, array<int>>")
