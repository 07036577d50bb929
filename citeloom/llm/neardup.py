"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label and length are a space. Unit vectors with cosine >= c are at most
eps = sqrt(2 - 2c) apart, and so are their projections on the leading principal dimensions. All
vectors are sorted by the lexicographic order of their grid cells (edge eps) on these dimensions;
intervals of this sequence with up to ``LEAF`` vectors are the leaves, and each ``FAN`` neighbours
have a parent. Pairs of intervals are joined from the roots down: a pair whose boxes or balls are
provably more than eps apart is skipped, one whose balls lie provably within eps is linked as a
whole, any other goes on to its children. Pairs of leaves that are left are compared by matrix
products in double precision.

No pair of vectors is ever a row: a pair of leaves gives each vector's number of links and edges
that span its connected parts; wholly linked pairs give numbers and edges of intervals. Equal
vectors of a space are one node.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link
with nothing and are their own component; vectors of different lengths link with nothing; null
ids are never a component's id unless it has no other; repeated rows count each; an empty table
gives no rows. A component's id is its smallest vec_id, and exactly the rows with that id are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common, jaccard

#: Leading principal dimensions, vectors in a leaf, and children of an interval.
DIMENSIONS, LEAF, FAN = 12, 256, 4
#: What bounds of distances leave for rounding.
MARGIN = 1e-9
#: Nodes that hold a larger share of all rows than one in so many are joined by broadcast.
HOT = 1000

def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(vectors: DataFrame, d: int) -> np.ndarray:
    """The leading principal dimensions (columns) of the vectors of length d: sums of products of d x d entries, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d + 1, d)), 0
        for batch in batches:
            u = _unit(np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, d))
            total[:d] += u.T @ u
            total[d] += u.sum(0)
            n += len(u)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange((d + 1) * d + 1)), "x": pa.array(np.append(total.ravel(), n))})

    rows = vectors.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # as many as a matrix has entries
    if not rows:
        return np.eye(d)[:, :DIMENSIONS]
    x = np.zeros((d + 1) * d + 1)
    for r in rows:
        x[r.i] = r.x
    mean = x[d * d : -1] / x[-1]
    _, axes = np.linalg.eigh(x[: d * d].reshape(d, d) / x[-1] - np.outer(mean, mean))
    return axes[:, ::-1][:, :DIMENSIONS]


def _rows(vectors: pa.Array, n: int) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _ordered(nodes: DataFrame, axes: np.ndarray, d: int, eps: float) -> DataFrame:
    """nodes with their place in epsilon grid order: the cells as bytes that sort as the cells do, then the projections more finely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            key = np.empty(batch.num_rows, object)
            for k in np.unique(lengths):
                on = np.flatnonzero(lengths == k)
                p = _projected(_unit(_rows(batch.column("v").take(pa.array(on)), len(on))), axes, d) + 1.0  # within 0 and 2
                cell = np.floor(p / eps).clip(0, 65535).astype(">u2")
                fine = np.floor(p * (1 << 14)).clip(0, 65535).astype(">u2")
                key[on] = [x.tobytes() + y.tobytes() for x, y in zip(cell, fine)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], names=[*batch.schema.names, "ego"])

    return nodes.mapInArrow(run, "space string, v array<double>, m bigint, d1 bigint, d2 bigint, ego binary")


def _projected(u: np.ndarray, axes: np.ndarray, d: int) -> np.ndarray:
    return u @ axes if u.shape[1] == d else u[:, :DIMENSIONS]


def _balls(u: np.ndarray, axes: np.ndarray, d: int) -> dict:
    """Bounds of some unit vectors: box of projections, centre and radius."""
    p, c = _projected(u, axes, d), u.mean(0)
    return {"lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "centre": c.tolist(), "radius": float(np.sqrt(((u - c) ** 2).sum(1).max()))}


_BOUNDS = "lo array<double>, hi array<double>, centre array<double>, radius double, m bigint, rep bigint"


def _leaves(ordered: DataFrame, axes: np.ndarray, d: int) -> DataFrame:
    """One row for each interval of the sorted sequence with up to LEAF nodes of one space; place numbers the intervals within
    a partition, rep is the interval's first node."""
    reals, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
    schema = pa.schema([("space", pa.string()), ("place", pa.int64()), ("nodes", longs), ("ms", longs), ("d1", longs), ("d2", longs), ("vs", pa.binary()), ("lo", reals), ("hi", reals), ("centre", reals), ("radius", pa.float64()), ("m", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, rest = 0, None

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, rest
            space = rest.column("space").to_numpy()
            edges = np.append(np.flatnonzero(space[1:] != space[:-1]) + 1, len(space))
            a = 0
            while a < len(space):
                b = min(a + LEAF, int(edges[np.searchsorted(edges, a, "right")]))
                if b == len(space) and not final:
                    break
                part = rest.slice(a, b - a).combine_chunks()
                x = _rows(part.column("v").combine_chunks(), b - a)
                own = {c: [part.column(c).to_pylist()] for c in ("d1", "d2")} | {"nodes": [part.column("place").to_pylist()], "ms": [part.column("m").to_pylist()]}
                place = (own["nodes"][0][0] >> 33 << 33) + made
                row = own | {"space": [space[a]], "place": [place], "vs": [x.tobytes()], "m": [sum(own["ms"][0])], "rep": [own["nodes"][0][0]]} | {k: [v] for k, v in _balls(_unit(x), axes, d).items()}
                yield pa.RecordBatch.from_pydict(row, schema=schema)
                made, a = made + 1, b
            rest = rest.slice(a)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, t]) if rest is not None else t
            yield from cut(False)
        if rest is not None and rest.num_rows:
            yield from cut(True)

    return ordered.mapInArrow(run, "space string, place bigint, nodes array<bigint>, ms array<bigint>, d1 array<bigint>, d2 array<bigint>, vs binary, " + _BOUNDS)


def _parents(level: DataFrame) -> DataFrame:
    """The intervals that hold FAN neighbours each, with bounds around their children's."""

    def run(key, rows):
        import pandas as pd

        lo, hi, c = (np.stack(rows[x]) for x in ("lo", "hi", "centre"))
        m = rows["m"].to_numpy()
        middle = (c * m[:, None]).sum(0) / m.sum()
        radius = float((np.sqrt(((c - middle) ** 2).sum(1)) + rows["radius"].to_numpy()).max())
        return pd.DataFrame({"space": [key[0]], "at": [key[1]], "lo": [lo.min(0)], "hi": [hi.max(0)], "centre": [middle], "radius": [radius], "m": [int(m.sum())], "rep": [int(rows["rep"].min())]})

    return level.select("space", (F.floor(F.col("at") / FAN)).alias("up"), "lo", "hi", "centre", "radius", "m", "rep").groupBy("space", "up").applyInPandas(run, "space string, at bigint, " + _BOUNDS)


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """space, a, b and whole of the pairs of intervals that aren't provably more than eps apart; whole where they are provably within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_pylist() for c in ("lo", "hi", "centre", "lo2", "hi2", "centre2")}
            r = batch.column("radius").to_numpy() + batch.column("radius2").to_numpy()
            apart, between = np.zeros(len(r)), np.zeros(len(r))
            for i in range(len(r)):
                gap = np.maximum(0, np.maximum(np.subtract(x["lo"][i], x["hi2"][i]), np.subtract(x["lo2"][i], x["hi"][i])))
                apart[i], between[i] = np.sqrt((gap * gap).sum()), np.sqrt((np.subtract(x["centre"][i], x["centre2"][i]) ** 2).sum())
            near = (apart <= eps + MARGIN) & (between - r <= eps + MARGIN)
            whole = between + r <= eps - MARGIN
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(pa.array(near)) for c in ("space", "a", "b")], pa.array(whole[near])], names=["space", "a", "b", "whole"])

    return pairs.mapInArrow(run, "space string, a bigint, b bigint, whole boolean")


def _sides(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = level.select("space", F.col("at").alias("a"), "lo", "hi", "centre", "radius", F.floor(F.col("at") / FAN).alias("ua"))
    two = level.select("space", F.col("at").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2"), F.floor(F.col("at") / FAN).alias("ub"))
    return one, two


def _compared(pairs: DataFrame, leaves: DataFrame, cosine: float) -> DataFrame:
    """Of each pair of leaves: for every vector with links its node, number of links (add) and a node it is connected with (b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                na, nb, ma, mb = (np.array(r[c], np.int64) for c in ("nodes", "nodes2", "ms", "ms2"))
                u, w = (_unit(np.frombuffer(r[c], np.float64).reshape(k, -1)) for c, k in (("vs", len(na)), ("vs2", len(nb))))
                link = u @ w.T >= cosine
                same = r["a"] == r["b"]
                if same:
                    np.fill_diagonal(link, False)
                ids, add = (na, link @ mb) if same else (np.concatenate([na, nb]), np.concatenate([link @ mb, link.T @ ma]))
                if not add.any():
                    continue
                one, two = np.nonzero(link)
                head = _spanned(len(ids), one, two if same else two + len(na))
                on = np.flatnonzero(add)
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(add[on]), pa.array(ids[head[on]])], names=["a", "add", "b"])

    left = leaves.select("space", F.col("at").alias("a"), "nodes", "ms", "vs")
    right = leaves.select("space", F.col("at").alias("b"), F.col("nodes").alias("nodes2"), F.col("ms").alias("ms2"), F.col("vs").alias("vs2"))
    return pairs.join(left, ["space", "a"]).join(right, ["space", "b"]).select("a", "b", "nodes", "ms", "vs", "nodes2", "ms2", "vs2").mapInArrow(run, "a bigint, add bigint, b bigint")


def _spanned(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest place that each place is connected with."""
    head = np.arange(n)
    while True:
        low = np.minimum(head[one], head[two])
        new = head.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _whole(pairs: DataFrame, leaves: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(node and add, edges) of the pairs (level, space, a, b) of intervals that are linked as wholes."""
    every = None
    for k, level in enumerate(levels):
        one = level.select(F.lit(k).alias("level"), "space", "at", "m", "rep")
        every = one if every is None else every.unionByName(one)
    one, two = every.toDF("level", "space", "a", "ma", "ra"), every.toDF("level", "space", "b", "mb", "rb")
    met = pairs.join(one, ["level", "space", "a"]).join(two, ["level", "space", "b"])
    same = F.col("a") == F.col("b")
    gives = F.when(same, F.array(F.struct(F.col("a").alias("at"), F.col("ma").alias("add"), F.lit(1).alias("own"), F.col("ra").alias("rep")))).otherwise(F.array(F.struct(F.col("a").alias("at"), F.col("mb").alias("add"), F.lit(0).alias("own"), F.col("ra").alias("rep")), F.struct(F.col("b").alias("at"), F.col("ma").alias("add"), F.lit(0).alias("own"), F.col("rb").alias("rep"))))
    sums = met.select("level", "space", F.inline(gives)).groupBy("level", "space", "at").agg(F.sum("add").alias("add"), F.sum("own").alias("own"), F.min("rep").alias("top"))
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("at") / FAN**k).alias("at")) for k in range(len(levels))])).alias("up")
    below = leaves.select("space", F.col("at").alias("leaf"), above).select("space", "leaf", "up.level", "up.at").join(sums, ["level", "space", "at"])
    of_leaf = below.groupBy("space", "leaf").agg(F.sum("add").alias("add"), F.sum("own").alias("own"), F.collect_set("top").alias("tops"))
    hit = leaves.select("space", F.col("at").alias("leaf"), "nodes", "ms", "rep").join(of_leaf, ["space", "leaf"])
    each = hit.select("add", "own", F.explode(F.arrays_zip("nodes", "ms")).alias("x")).select(F.col("x.nodes").alias("a"), (F.col("add") - F.col("own") * F.col("x.ms")).alias("add"))
    edges = hit.select(F.explode("nodes").alias("a"), F.col("rep").alias("b")).union(hit.select("rep", F.explode("tops"))).union(met.select("ra", "rb"))
    return each, edges


def link(docs: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """key, n_links, component_id and kept of each row; links are between vectors of one label with at least this cosine."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").alias("label"))
    usable = _usable(F.col("v"), F.col("label"))
    rows = given.where(usable).withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.withColumn("space", F.concat_ws(":", F.size("v").cast("string"), F.col("label").cast("string")))
    # Two hashes of 64 bits stand for a space and a vector.
    rows = rows.withColumns({f"d{i}": F.xxhash64(F.lit(i), "space", "v") for i in (1, 2)})
    nodes = common.materialise(rows.groupBy("d1", "d2").agg(F.first(F.struct("space", "v")).alias("x"), F.count("*").alias("m"), F.min("key").alias("least")).select("x.space", "x.v", "m", "d1", "d2", "least"), "nodes")
    alone = given.where(~usable).select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    commonest = nodes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if commonest is None:
        return _named(alone, key)
    d = commonest.d
    axes = principal(nodes.where(F.size("v") == d).select("v"), d)
    order = ["space", "ego", "d1", "d2"]
    ordered = _ordered(nodes.select("space", "v", "m", "d1", "d2"), axes, d, eps)
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    leaves = common.materialise(_leaves(ordered, axes, d), "leaves")
    leaves = common.numbered(leaves, "place", "at")
    levels = [common.materialise(leaves.select("space", "at", "lo", "hi", "centre", "radius", "m", "rep"), "level")]
    widest = leaves.groupBy("space").count().agg(F.max("count")).first()[0]
    while widest > FAN:
        levels.append(common.materialise(_parents(levels[-1]), "level"))
        widest = widest // FAN + 2 if widest > 2 * FAN else 1

    one, two = _sides(levels[-1])
    met, whole = one.drop("ua").join(two.drop("ub"), "space").where("a <= b"), None
    for k in reversed(range(len(levels))):
        judged = common.materialise(_judged(met, eps), "pairs")
        linked = judged.where("whole").select(F.lit(k).alias("level"), "space", "a", "b")
        whole = linked if whole is None else whole.unionByName(linked)
        rest = judged.where("not whole").select("space", "a", "b")
        if k:
            one, two = _sides(levels[k - 1])
            met = rest.toDF("space", "ua", "ub").join(one, ["space", "ua"]).join(two, ["space", "ub"]).where("a <= b")
    found = common.materialise(_compared(rest, leaves, cosine), "found")
    more, tied = _whole(whole, leaves, levels)
    links = found.select("a", "add").unionByName(more).groupBy("a").agg(F.sum("add").alias("add"))
    edges = found.select("a", "b").union(tied).where("a <> b").distinct()
    comp = jaccard.components(edges)

    places = leaves.select(F.explode(F.arrays_zip("nodes", "ms", "d1", "d2")).alias("x")).select(F.col("x.nodes").alias("a"), F.col("x.ms").alias("m"), "x.d1", "x.d2")
    known = nodes.select("d1", "d2", "least").join(places, ["d1", "d2"]).join(links, "a", "left").join(comp.select(F.col("node").alias("a"), "comp"), "a", "left")
    known = common.materialise(known.select("d1", "d2", "m", "least", F.coalesce("add", F.lit(0)).alias("add"), F.coalesce("comp", "a").alias("comp")), "known")
    total = known.count()
    named = common.join_by_share(known, known.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), ["comp"], "members", total, HOT)
    of_node = named.select("d1", "d2", "m", (F.col("add") + F.col("m") - 1).alias("n_links"), "component_id")
    all_rows = nodes.agg(F.sum("m")).first()[0]
    out = common.join_by_share(rows.select("key", "d1", "d2"), of_node, ["d1", "d2"], "m", all_rows, HOT).select("key", "n_links", F.coalesce("component_id", "key").alias("component_id"))
    return _named(out.unionByName(alone), key)


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
