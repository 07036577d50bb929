"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master gets one made for it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='citeloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with gapless numbers from 0 in an order of columns: sorted by ranges, whose sizes say where each begins to count."""
    place = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "sorted")
    part, first, at = F.shiftright("__place", 33), [], 0
    for p, n in sorted((r.p, r["count"]) for r in place.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        first.append((p, at))
        at += n
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "__part bigint, __first bigint"))
    return place.join(starts, part == F.col("__part")).withColumn(name, F.col("__first") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__place", "__part", "__first")


class Tables:
    """Bucketed tables in the shared folder, known to the session by names that nobody else uses. They go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def bucketed(self, df: DataFrame, column: str, dealt: bool = True, apart: Sequence[str] = ()) -> DataFrame:
        """df as a written table with as many buckets by a column as shuffles have partitions: joins and sums by that column need no shuffle of it.
        dealt: df has a partition for each bucket already; if not, rows are dealt so, as else every task writes a file for each bucket.
        apart: columns of few values, each in files of its own: who asks for one value reads no other."""
        name, path = f"citeloom_{uuid.uuid4().hex}", new_path(self.spark, "bucketed")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df = df if dealt else df.repartition(buckets, column)
        writer = df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd")
        (writer.partitionBy(*apart) if apart else writer).saveAsTable(name)
        self.made.append((name, path))
        return self.spark.table(name)

    def kept(self, df: DataFrame) -> DataFrame:
        """Columns of one of these tables, whose files stay when the block ends; it isn't known by name any more."""
        first = next(iter(df.inputFiles()), "")
        for name, path in self.made:
            if path.rpartition("/")[2] in first:
                self.made.remove((name, path))
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                return self.spark.read.schema(df.schema).parquet(path)
        return cut_lineage(df, "kept")

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *failure) -> None:
        for name, path in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(self.spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of cut_lineage that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
