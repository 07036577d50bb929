"""N-gram Jaccard join by grouped prefixes, and its connected components.

A text's set holds its distinct word n-grams. All sets are ordered by one global order: how often an
n-gram was counted (in a table of counters of fixed size), then its hash. Sets that are alike to
``percent`` share an n-gram among their first few (the prefix). Equal sets are one node; nodes with
the same prefix and size are one group; groups meet in the buckets of their prefix n-grams, where
length and position filters hold. Pairs that pass are held against sketches of fixed size, which rule out most
that aren't alike and none that are; what is left is verified on whole sets.

Only components are asked for, so pairs need no listing: first every group of a bucket is verified
against a few pivots of that bucket and members of a group against its first, then only nodes that
are still in different components are. No link between different sets is lost: each pair that
passes the filters is verified or already connected.

Defined results: texts without words (or null) have an empty set, link with nothing and are their own
component; texts with fewer words than n have their whole sequence as one n-gram; repeated rows and
ties fall into one node; null ids are never a component's id unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from citeloom.llm import common
from citeloom.llm.common import materialise

#: Counters of the table that orders n-grams, and counters in a chunk of it.
COUNTERS, CHUNK = 1 << 21, 1 << 14
#: Bytes of a set's sketch: how many of its n-grams fall to each, up to 255.
SKETCH = 128


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, ptr = common.tokens(column)
    return common.distinct_per_text(*common.windows(h, ptr, n), len(ptr) - 1)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)) & np.uint64(COUNTERS - 1)


def _digest(h: np.ndarray, size: int) -> int:
    """A 64-bit hash of a set of hashes and a number."""
    return int(common._mix(common._mix(h).sum(dtype=np.uint64, keepdims=True) + np.uint64(size)).view(np.int64)[0])


def _sketch(h: np.ndarray) -> bytes:
    return np.minimum(np.bincount(((h >> np.uint64(13)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def counters(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How many sets have an n-gram that falls to each counter, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(COUNTERS, np.int32), False
        for batch in common.small_batches(batches):
            np.add.at(total, _bucket(_sets(batch.column(0), n)[0]), 1)
            some = True
        if some:
            parts = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.arange(len(parts)), pa.int32()), "data": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(CHUNK, np.int64), None
        for part in parts:
            for x in part.column("data"):
                total += np.frombuffer(x.as_py(), np.int32)
            chunk = part.column("chunk")[0].as_py()
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "data": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "chunk int, data binary").groupBy("chunk").applyInArrow(add, "chunk int, data binary").collect()
    out = np.zeros(COUNTERS, np.int32)
    for r in rows:  # a fixed number of chunks
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], np.int32)
    return out


def signatures(docs: DataFrame, order, *, key: str, text: str, n: int, percent: int) -> DataFrame:
    """key, print, n (set size), node (a hash of the set; null for empty sets), grp (a hash of size and prefix),
    prefix, central (the count of the prefix's rarest n-gram) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in common.small_batches(batches):
            s, ptr = _sets(batch.column("text"), n)
            c = counts[_bucket(s)]
            prefix, node, grp, central, sketch = [], [], [], [], []
            for a, b in zip(ptr, ptr[1:]):
                size = b - a
                if not size:
                    prefix.append(None), node.append(None), grp.append(None), central.append(None), sketch.append(None)
                    continue
                keep = size - -(-percent * size // 100) + 1
                first = np.lexsort((s[a:b], c[a:b]))[:keep]
                prefix.append(s[a:b][first].view(np.int64))
                central.append(int(c[a:b][first[0]]))
                sketch.append(_sketch(s[a:b]))
                node.append(_digest(s[a:b], size)), grp.append(_digest(s[a:b][first], size))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("print"), pa.array(np.diff(ptr), pa.int64()), pa.array(node, pa.int64()), pa.array(grp, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(central, pa.int32()), pa.array(sketch, pa.binary())], names=["key", "print", "n", "node", "grp", "prefix", "central", "sketch"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, print bigint, n bigint, node bigint, grp bigint, prefix array<bigint>, central int, sketch binary")


def _whole_sets(docs: DataFrame, bitmap, *, key: str, text: str, n: int) -> DataFrame:
    """node and set of the texts whose key's hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in common.small_batches(batches):
            batch = batch.filter(pa.array(common.in_filter(bits, batch.column("k").to_numpy(zero_copy_only=False).view(np.uint64))))
            if not batch.num_rows:
                continue
            s, ptr = _sets(batch.column("text"), n)
            node = [_digest(s[a:b], b - a) if b > a else None for a, b in zip(ptr, ptr[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s[a:b].view(np.int64) for a, b in zip(ptr, ptr[1:])], pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select(F.xxhash64(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, "node bigint, set array<bigint>")


#: Labels that more than one in so many nodes have are joined by broadcast; there are fewer than that.
HOT = 1000


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of the nodes of edges (a, b): labels spread along edges and jump to their
    label's label until no edge moves one. A label that very many nodes have meets none of them in one task: how
    many have it is counted first, and the few that are so common are broadcast."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    nodes = labels.count()
    while True:
        seen = Observation()
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("comp", "near").alias("next"), (F.col("near") < F.col("comp")).alias("moved"))
        step = materialise(step.observe(seen, F.count_if("moved").alias("moved")).drop("moved"), "steps")
        if not seen.get["moved"]:
            common.discard(both)
            return labels
        held = step.groupBy("next").agg(F.count("*").alias("held"))
        jump = held.join(step.select(F.col("node").alias("next"), F.col("next").alias("comp")), "next")
        after = materialise(common.join_by_share(step, jump, ["next"], "held", nodes, HOT).select("node", "comp"), "labels")
        common.discard(labels)
        common.discard(step)
        labels = after


def _fits(n: str, pos: str, m: str, at: str, percent: int):
    """Length and position filters of two groups that meet in a bucket."""
    a, b = F.col(n), F.col(m)
    most = F.least(a - F.col(pos), b - F.col(at))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * most >= percent * (a + b))


def _pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out: sets that are alike differ in few n-grams, and the sketches'
    counts differ by no more than the sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("s", "t"))
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            apart = np.abs(one - two).sum(1, dtype=np.int64)
            yield batch.filter(pa.array((100 + percent) * apart <= (100 - percent) * n)).select(["a", "b"])

    own = nodes.select("node", "n", "sketch")
    both = pairs.join(own.toDF("a", "n", "s"), "a").join(own.toDF("b", "m", "t"), "b").select("a", "b", "n", "m", "s", "t")
    return both.mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, **names) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike, as a table. Only the sets of pairs that may be are made."""
    pairs = materialise(_pruned(pairs, nodes, percent), "near")
    wanted = materialise(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", F.xxhash64("key").alias("k")), "wanted")
    bitmap = docs.sparkSession.sparkContext.broadcast(common.make_filter(wanted, "k"))
    sets = _whole_sets(docs, bitmap, **names).where("node is not null").join(wanted.select("node"), "node", "left_semi")
    sets = materialise(sets.dropDuplicates(["node"]), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(left, "a").join(right, "b").where((100 + percent) * both >= percent * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()
    found = materialise(found, "links")
    for done in (pairs, wanted, sets):
        common.discard(done)
    return found


def _shared_only(rows: DataFrame, bitmap) -> DataFrame:
    """rows (distinct nodes aside) with those n-grams of the prefix that are in the bitmap, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            lists = batch.column("prefix")
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))]).astype(np.int64)
            on = np.flatnonzero(common.in_filter(bits, flat.view(np.uint64)))
            row = np.searchsorted(off, on, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ("node", "grp", "n", "central")], pa.array(on - off[row], pa.int32()), pa.array(flat[on])], names=["node", "grp", "n", "central", "pos", "token"])

    return rows.select("node", "grp", "n", "central", "prefix").mapInArrow(run, "node bigint, grp bigint, n bigint, central int, pos int, token bigint")


def _linked(docs: DataFrame, *, key: str, text: str, n: int, percent: int) -> DataFrame:
    """key, print (a hash of the text), n and first: the key and print of the component's first row (null for empty sets)."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    order = spark.sparkContext.broadcast(counters(docs, text, n))
    rows = materialise(signatures(docs, order, key=key, text=text, n=n, percent=percent), "signatures")
    full = rows.where("node is not null")
    # The row with the smallest key, if any has one, stands for its node.
    own = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "print"))
    nodes = materialise(full.groupBy("node").agg(own.alias("first"), F.min("grp").alias("grp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("node", "grp", "n", "sketch", "first", F.col("first.key").alias("key")), "nodes")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("head"), F.count("*").alias("members"))
    # N-grams in the prefixes of two nodes at least.
    shared = full.select("node", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    bitmap = spark.sparkContext.broadcast(common.make_filter(materialise(shared.select("token"), "shared"), "token"))
    places = _shared_only(full, bitmap).select("token", "grp", "n", "pos", "central").distinct()
    postings = materialise(places.join(groups, "grp"), "postings")

    # Pivots of a bucket: the group with the commonest rarest n-gram, the largest, the smallest, and one at random.
    who = F.struct("grp", "n", "pos", "head")
    pivots = postings.groupBy("token").agg(*[F.max_by(who, F.struct(*by)).alias(f"p{i}") for i, by in enumerate([("central", "grp"), ("n", "grp"), (-F.col("n"), "grp"), (F.xxhash64("grp"), "grp")])])
    pivots = pivots.select("token", F.explode(F.array_distinct(F.array("p0", "p1", "p2", "p3"))).alias("p")).select("token", F.col("p.n").alias("m"), F.col("p.pos").alias("at"), F.col("p.head").alias("b"))
    near = postings.join(pivots, "token").where((F.col("head") != F.col("b")) & _fits("n", "pos", "m", "at", percent)).select(F.least("head", "b").alias("a"), F.greatest("head", "b").alias("b"))
    crowd = nodes.join(groups.where("members > 1").select("grp", "head"), "grp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    first = materialise(near.union(crowd).distinct(), "pairs")

    names = {"key": key, "text": text, "n": n}
    links = _verify(first, nodes, docs, percent, **names)
    comp = components(links)
    # What is left: nodes that meet in a bucket and are in different components. A class is what a group has in one component.
    met_once = nodes.join(postings.select("grp").distinct(), "grp", "left_semi")
    classes = materialise(met_once.join(comp, "node", "left").select("node", "grp", F.coalesce("comp", "node").alias("comp")), "classes")
    places = postings.select("token", "grp", "n", "pos").join(classes.select("grp", "comp").distinct(), "grp")
    mixed = places.groupBy("token", "comp").count().groupBy("token").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("count", "comp")).alias("main")).where("comps > 1").select("token", "main")
    places = materialise(places.join(mixed, "token"), "places")
    rest = places.where("comp <> main").select("token", F.col("grp").alias("grp2"), F.col("comp").alias("comp2"), F.col("n").alias("m"), F.col("pos").alias("at"))
    met = places.join(rest, "token").where((F.col("comp") != F.col("comp2")) & ((F.col("comp") == F.col("main")) | (F.col("comp") < F.col("comp2"))) & _fits("n", "pos", "m", "at", percent)).select("grp", "comp", "grp2", "comp2").distinct()
    one, two = classes.select("grp", "comp", F.col("node").alias("a")), classes.select(F.col("grp").alias("grp2"), F.col("comp").alias("comp2"), F.col("node").alias("b"))
    second = materialise(met.join(one, ["grp", "comp"]).join(two, ["grp2", "comp2"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    more = _verify(second, nodes, docs, percent, **names)
    of = classes.select("node", "comp")
    joined = materialise(more.join(of.withColumnsRenamed({"node": "a", "comp": "ca"}), "a").join(of.withColumnsRenamed({"node": "b", "comp": "cb"}), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "bridges")
    top = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    final = classes.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    whole = nodes.select("node", "first").join(final, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    least = whole.groupBy("comp").agg(F.min("first").alias("first"))
    named = whole.select("node", "comp").join(least, "comp").select("node", "first")
    return rows.select("key", "print", "n", "node").join(named, "node", "left").select("key", "print", "n", "first")


def link(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles and component_id (the smallest key of the component) of each row of docs."""
    found = _linked(docs, key=key, text=text, n=n, percent=percent)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("first").isNull(), F.col("key")).otherwise(F.col("first.key")).alias("component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that with the smallest key (then the smallest hash of its
    text). Rows without words are components of their own and stay."""
    found = materialise(_linked(docs, key=key, text=text, n=n, percent=percent), "found")
    stays = F.col("first").isNull() | (F.col("key").eqNullSafe(F.col("first.key")) & F.col("print").eqNullSafe(F.col("first.print")))
    kept = common.matching(docs, found.where(~stays).select("key", "print"), "left_anti", key=key, text=text)
    twice = found.where(stays & F.col("first").isNotNull()).groupBy("key", "print").count().where("count > 1").select("key", "print")
    if not twice.limit(1).count():
        return kept
    return common.matching(kept, twice, "left_anti", key=key, text=text).unionByName(common.matching(kept, twice, "left_semi", key=key, text=text).dropDuplicates([key, text]))
