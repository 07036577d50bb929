"""Non-negative matrix factors of a sparse table of weights, by distributed products.

The table (doc, term, x) is bucketed by doc. The factor of the commonest ``HELD`` terms is broadcast, so that docs get their
sums without any shuffle; entries of rarer terms, which are few, are bucketed by term and shuffle a partial sum each. A product the other way
shuffles a partial sum for each term and task. Entries of docs with very many of them lie apart and are joined by broadcast.
A factor has one row of k numbers for each doc or term. The start comes from the largest singular vectors
(found by subspace iteration; only small square matrices reach the driver), split into
their positive and negative parts. Every round then takes each row of one factor through coordinate descent against
the other, and ends when the projected gradients have shrunk to ``tol`` of their first sum.

Defined results: a doc or term without weights has no row; an empty table gives empty factors; k larger than
the table's rank leaves the rest of the components near the mean they are filled with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from citeloom.operators import scratch
from citeloom.operators.scratch import cut_lineage

#: Docs with a larger share of all entries than one in so many are joined by broadcast.
HUBS = 1000
#: Terms whose rows of a factor are broadcast, the commonest: some 20 MB at 30 numbers each.
HELD = 1 << 16
#: Subspace iterations, and vectors beyond k that these carry along.
POWERS, MORE = 5, 10
#: Widths of factors whose products are observed.
OBSERVED = 8


class Sparse:
    """A long table of entries that is multiplied by factors from either side."""

    def __init__(self, tables: scratch.Tables, x: DataFrame):
        self.tables, spark = tables, x.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Dealt by doc before entries are added up, so that they move once, or not at all where they lie so already. Counts and sums are observed while tables are written.
        told, docs, terms = Observation(), Observation(), Observation()
        added = x.repartition(buckets, "doc").groupBy("doc", "term").agg(F.sum("x").alias("x")).where("x <> 0")
        every = tables.bucketed(added.observe(told, F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("squares")), "doc")
        self.entries, self.sum, self.squares = told.get["n"], told.get["sum"] or 0.0, told.get["squares"] or 0.0
        self.tasks = min(buckets, 2 * spark.sparkContext.defaultParallelism)
        many = F.col("count") * HUBS > self.entries
        self.hubs = cut_lineage(every.groupBy("doc").count().observe(docs, F.count("*").alias("n"), F.count_if(many).alias("hubs")).where(many).select("doc"), "hubs")
        self.hot = cut_lineage(every.join(F.broadcast(self.hubs), "doc"), "hub-entries") if docs.get["hubs"] else None
        self.x = every if self.hot is None else tables.bucketed(every.join(F.broadcast(self.hubs), "doc", "left_anti"), "doc")
        self.terms = cut_lineage(every.groupBy("term").count().observe(terms, F.count("*").alias("n")), "terms")
        #: How many ids each side has.
        self.size = {"doc": docs.get["n"], "term": terms.get["n"]}
        self.common = self.rare = None
        if self.size["term"] > HELD:
            self.common = cut_lineage(self.terms.orderBy(F.desc("count"), "term").limit(HELD).select("term"), "common")
            self.rare = tables.bucketed(every.join(F.broadcast(self.common), "term", "left_anti"), "term", dealt=False)

    def ids(self, side: str) -> DataFrame:
        if side == "term":
            return self.terms.select(F.col("term").alias("id"))
        own = self.x.select(F.col("doc").alias("id"))
        return (own if self.hot is None else own.unionByName(self.hot.select(F.col("doc").alias("id")))).distinct()

    def times(self, factor: DataFrame, side: str, width: int) -> DataFrame:
        """id of the other side and top: the sums of entries by the factor (id of side, v)."""
        there = "term" if side == "doc" else "doc"
        own = factor.select(F.col("id").alias(side), "v")
        parts = lambda met: met.select(F.col(there).alias("id"), *[(F.col("x") * F.col("v")[j]).alias(f"p{j}") for j in range(width)])
        added = lambda part: part.groupBy("id").agg(*[F.sum(f"p{j}").alias(f"s{j}") for j in range(width)])
        if side == "doc":
            # A task sends a row for each term, so few tasks take all docs.
            part = parts(self.x.join(own.hint("shuffle_hash"), "doc")).coalesce(self.tasks)
            if self.hot is not None:
                part = part.unionByName(parts(self.hot.join(F.broadcast(own.join(F.broadcast(self.hubs), "doc", "left_semi")), "doc")))
            out = added(part)
        else:
            sent = F.broadcast(own if self.common is None else own.join(F.broadcast(self.common), "term", "left_semi"))
            out = added(parts(self.x.join(sent, "term")))
            rest = [parts(self.hot.join(sent, "term"))] if self.hot is not None else []
            rest += [parts(self.rare.join(own.hint("shuffle_hash"), "term"))] if self.rare is not None else []
            if rest:
                more = added(rest[0] if len(rest) == 1 else rest[0].unionByName(rest[1]))
                both = out.join(more.withColumnsRenamed({f"s{j}": f"m{j}" for j in range(width)}).hint("shuffle_hash"), "id", "full")
                out = both.select("id", *[(F.coalesce(f"s{j}", F.lit(0.0)) + F.coalesce(f"m{j}", F.lit(0.0))).alias(f"s{j}") for j in range(width)])
        return out.select("id", F.array(*[f"s{j}" for j in range(width)]).alias("top"))


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _id(df: DataFrame) -> str:
    return dict(df.dtypes)["id"]


def _turned(df: DataFrame, matrix: np.ndarray, column: str) -> DataFrame:
    """id and v: each row's numbers by a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_rows(batch.column(1), batch.num_rows) @ matrix)], names=["id", "v"])

    return df.select("id", column).mapInArrow(run, f"id {_id(df)}, v array<double>")


def _kept(tables: scratch.Tables, factor: DataFrame, width: int) -> tuple[DataFrame, np.ndarray, dict[str, float]]:
    """The factor as a table, the products of its columns, and the sums of what else its rows have. A few products are observed while it is written;
    many would make a wide plan, so they are made in a pass of their own, and width x width numbers of each task are added up."""
    more = [c for c in factor.columns if c not in ("id", "v")]
    if width <= OBSERVED:
        seen = Observation()
        sums = [F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)]
        out = tables.bucketed(factor.observe(seen, *sums, *[F.sum(c).alias(c) for c in more]), "id")
        gram = np.array([[seen.get[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(width)] for i in range(width)])
        return out.select("id", "v"), gram, {c: float(seen.get[c] or 0.0) for c in more}
    out = tables.bucketed(factor, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((width, width)), np.zeros(len(more))
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch.column("v"), batch.num_rows)
                total += v.T @ v
                sums += [np.sum(batch.column(c).to_numpy()) for c in more]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width + len(more))), pa.array(np.append(total.ravel(), sums))], names=["at", "x"])

    found = np.zeros(width * width + len(more))
    for r in out.mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        found[r["at"]] = r.x
    return out.select("id", "v"), found[: width * width].reshape(width, width), dict(zip(more, found[width * width :].tolist()))


def _whitened(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes a factor's columns orthonormal; directions without length go to zero."""
    values, axes = np.linalg.eigh(gram)
    good = values > max(values.max(), 0) * 1e-12
    return axes * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)


def _noise(key: Column, width: int) -> Column:
    """Numbers around zero that depend on the key alone."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(j)), F.lit(1 << 20)) / float(1 << 20) - 0.5 for j in range(width)])


def singular(x: Sparse, k: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The first k left (docs) and right (terms) singular vectors, as factors, and the singular values."""
    width = k + MORE
    q, gram, _ = _kept(x.tables, x.ids("term").select("id", _noise(F.col("id"), width).alias("v")), width)
    for _ in range(POWERS):
        docs = x.tables.bucketed(x.times(_turned(q, _whitened(gram), "v"), "term", width).withColumnRenamed("top", "v"), "id")
        q, gram, _ = _kept(x.tables, x.times(docs, "doc", width).withColumnRenamed("top", "v"), width)
    right = x.tables.bucketed(_turned(q, _whitened(gram), "v"), "id")
    left, own, _ = _kept(x.tables, x.times(right, "term", width).withColumnRenamed("top", "v"), width)
    values, axes = np.linalg.eigh(own)
    values, axes = np.maximum(values[::-1][:k], 0), axes[:, ::-1][:, :k]
    sizes = np.sqrt(values)
    return _turned(left, axes * np.where(sizes > 0, 1 / np.where(sizes > 0, sizes, 1), 0), "v"), _turned(right, axes, "v"), sizes


def _split_start(x: Sparse, k: int) -> tuple[DataFrame, DataFrame]:
    """Factors from the singular vectors: of each pair of vectors the positive or the negative parts, whichever weigh more; zeros become the table's mean."""
    left, right, sizes = singular(x, k)
    left, right = x.tables.bucketed(left, "id"), x.tables.bucketed(right, "id")
    parts = []
    for factor in (left, right):
        norms = [F.sqrt(F.sum(F.greatest(F.col("v")[j] * sign, F.lit(0.0)) ** 2)).alias(f"c{sign}_{j}") for sign in (1, -1) for j in range(k)]
        r = factor.agg(*norms).first()
        parts.append(np.array([[r[f"c{sign}_{j}"] or 0.0 for j in range(k)] for sign in (1, -1)]))
    weight = parts[0] * parts[1]
    sign = np.where(weight[0] >= weight[1], 1.0, -1.0)
    which = (sign < 0).astype(int)
    mean = x.sum / max(x.size["doc"] * x.size["term"], 1)
    out = []
    for side, factor in enumerate((left, right)):
        own = parts[side][which, np.arange(k)]
        share = np.where(own > 0, np.sqrt(sizes * weight[which, np.arange(k)]) / np.where(own > 0, own, 1), 0.0)
        scaled = [F.greatest(F.col("v")[j] * float(sign[j] * share[j]), F.lit(0.0)) for j in range(k)]
        out.append(factor.select("id", F.array(*[F.when(c < 1e-6, mean).otherwise(c) for c in scaled]).alias("v")))
    return out[0], out[1]


def _hashed_start(x: Sparse, k: int) -> tuple[DataFrame, DataFrame]:
    """Entries that depend on the key and the topic, between 0.1 and 1.1 times what gives products as large as the table's mean."""
    scale = float(np.sqrt(x.sum / max(x.size["doc"] * x.size["term"], 1) / k))
    entry = lambda j: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(j)))), 1, 8), 16, 10).cast("double") / float(16**8) * scale + 0.1 * scale
    return tuple(x.ids(side).select("id", F.array(*[entry(j) for j in range(k)]).alias("v")) for side in ("doc", "term"))


def _descended(x: Sparse, own: DataFrame, other: DataFrame, gram: np.ndarray, side: str, k: int) -> DataFrame:
    """id, v, moved and met: each row of a factor after one turn of coordinate descent, the sum of its projected gradients, and its product with the sums of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, top = _rows(batch.column("v"), batch.num_rows).copy(), _rows(batch.column("top"), batch.num_rows)
            moved = np.zeros(len(w))
            for t in range(k):
                slope = w @ gram[t] - top[:, t]
                moved += np.abs(np.where(w[:, t] == 0, np.minimum(slope, 0), slope))
                if gram[t, t] != 0:
                    w[:, t] = np.maximum(w[:, t] - slope / gram[t, t], 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(w), pa.array(moved), pa.array((w * top).sum(1))], names=["id", "v", "moved", "met"])

    # Both sides lie by id already; ids look small enough to be broadcast when they aren't.
    rows = own.hint("merge").join(x.times(other, "term" if side == "doc" else "doc", k), "id").select("id", "v", "top")
    return rows.mapInArrow(run, f"id {_id(own)}, v array<double>, moved double, met double")


def nmf(weights: DataFrame, k: int, *, rounds: int = 1000, tol: float = 1e-4, start: str = "svd", key: str = "doc", term: str = "term", weight: str = "weight") -> tuple[DataFrame, DataFrame, dict]:
    """Factors (doc, w: k numbers) and (term, h), and what is known of the fit: rounds, error (the root of the squared differences) and settled."""
    spark = weights.sparkSession
    entries = weights.select(F.col(key).alias("doc"), F.col(term).alias("term"), F.col(weight).cast("double").alias("x"))
    with scratch.Tables(spark) as tables:
        x = Sparse(tables, entries)
        w, h = _split_start(x, k) if start == "svd" else _hashed_start(x, k)
        h, gram, _ = _kept(tables, h, k)  # w's start is read once, by the first turn
        first, done, settled = None, 0, False
        for done in range(1, rounds + 1):
            w, gram_w, one = _kept(tables, _descended(x, w, h, gram, "doc", k), k)
            h, gram, two = _kept(tables, _descended(x, h, w, gram_w, "term", k), k)
            moved = one["moved"] + two["moved"]
            first = moved if first is None else first
            if first == 0 or moved / first <= tol:
                settled = True
                break
        # The last turn of h met the sums of entries by the last w.
        error = float(np.sqrt(max(0.0, x.squares - 2 * two["met"] + float((gram_w * gram).sum())))) if x.entries else 0.0
        w, h = (tables.kept(f).select(F.col("id").alias(a), F.col("v").alias(b)) for f, a, b in ((w, "doc", "w"), (h, "term", "h")))
    return w, h, {"rounds": done, "error": error, "settled": settled}


def largest(factor: DataFrame, key: str = "doc", column: str = "w") -> DataFrame:
    """(key, topic): the place of the largest number, the first of equals."""
    return factor.select(key, (F.array_position(F.col(column), F.array_max(column)) - 1).cast("int").alias("topic"))


def top_terms(h: DataFrame, n: int) -> DataFrame:
    """(topic, place, term, weight): the n heaviest terms over 0 of each topic."""
    long = h.select("term", F.posexplode("h").alias("topic", "weight")).where("weight > 0")
    return long.withColumn("place", F.expr("row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term)")).where(F.col("place") <= n).select("topic", "place", "term", "weight")
