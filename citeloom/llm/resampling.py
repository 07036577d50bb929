"""Target-distribution importance resampling over partition-local word tries.

Features are runs of 1 to ``n`` words. Every task keeps a trie of the runs it has met: a node holds
how often its run was counted and the CRC-32 state of its UTF-8 bytes, so that a run one word longer
only feeds that word to its parent's state. Node counts fall to hashed buckets, whose totals are
merged over all tasks for the corpus and for the target; each bucket's gain follows from both. The
scoring pass walks the same paths with the gains attached to the nodes. A document's weight is the
floored mean of its features' gains; the draw is by Gumbel noise from its key's digest.

Tries are bounded: beyond ``NODES`` nodes a trie hands its counts to the buckets and starts anew.
Sent to the driver: bucket totals and a histogram of scores (fixed sizes), and one number for each
partition of the sorted draw.

Defined results: null and empty texts have no features, weight 0, and are drawn only if ``least`` is 0;
a null key counts as empty text in the noise and comes last among ties; repeated rows are drawn each for
itself, their order among themselves being open; empty tables give an empty result or, as target, no counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common

#: Nodes of a trie before its counts go to the buckets.
NODES = 1 << 20
#: Scores in a bin of the histogram that finds where the draw ends.
BIN = 64


class Trie:
    """Runs of words from the root; node 0 is the root. A child is known by (parent, word)."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.spelt: list[bytes] = []
        self.children: dict[tuple[int, int], int] = {}
        self.state = [0]
        self.count = np.zeros(1, np.int64)

    def spell(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of words, new ones included."""
        out = np.empty(len(distinct), np.int64)
        for i, w in enumerate(distinct):
            k = self.words.get(w)
            if k is None:
                k = self.words[w] = len(self.spelt)
                self.spelt.append(w)
            out[i] = k
        return out

    def step(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The nodes that the words lead to from the nodes ``at``, made where they are missing."""
        if not len(at):
            return at
        pair, back = np.unique(at * len(self.spelt) + word, return_inverse=True)
        found = np.empty(len(pair), np.int64)
        for i, (p, w) in enumerate(zip(*(x.tolist() for x in divmod(pair, len(self.spelt))))):
            node = self.children.get((p, w))
            if node is None:
                node = self.children[p, w] = len(self.state)
                self.state.append(zlib.crc32(b" " + self.spelt[w] if p else self.spelt[w], self.state[p]))
            found[i] = node
        return found[back]

    def add(self, nodes: np.ndarray) -> None:
        new = np.bincount(nodes, minlength=len(self.state))
        new[: len(self.count)] += self.count
        self.count = new

    def flush(self) -> None:
        np.add.at(self.totals, np.array(self.state[: len(self.count)], np.int64) % self.buckets, self.count)
        self.clear()


def _paths(trie: Trie, column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, text of each, number of words of every text), one part for each length of a run."""
    raw, off = common.text_bytes(column)
    raw = common.LOWER[raw]
    _, ptr, start, end = common.spans(raw, off, common.NOT_ALNUM)
    count = np.diff(ptr)
    text = np.repeat(np.arange(len(count)), count)
    encoded = common.cut_out(raw, start, end).dictionary_encode()
    spelt = trie.spell(encoded.dictionary.cast(pa.large_binary()).to_pylist())
    word = spelt[encoded.indices.to_numpy(zero_copy_only=False)] if len(spelt) else np.zeros(0, np.int64)
    node = np.zeros(len(word), np.int64)
    for k in range(n):  # node: of the run of k words at each place that has k + 1, else -1
        m = max(0, len(word) - k)
        fits = (node[:m] >= 0) & (text[:m] == text[k : k + m])
        node = np.where(fits, node[:m], -1)
        node[fits] = trie.step(node[fits], word[k : k + m][fits])
        yield node[fits], text[:m][fits], count


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts (a column) fall to each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets)
        for batch in common.small_batches(batches):
            for nodes, _, _ in _paths(trie, batch.column(0), n):
                trie.add(nodes)
            if len(trie.state) > NODES:
                trie.flush()
        trie.flush()
        on = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(trie.totals[on])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.toDF("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most as many rows as buckets
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets = len(source)
    more = (target + 1.0) * (source.sum() + float(buckets)) / ((source + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000 * np.log(more)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, *, key: str, text: str, n: int) -> DataFrame:
    """key, n_words, n_features and weight of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(sent.value))
        for batch in common.small_batches(batches):
            total, features = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for nodes, where, count in _paths(trie, batch.column("text"), n):
                attached = sent.value[np.array(trie.state, np.int64) % trie.buckets]
                np.add.at(total, where, attached[nodes])
                features += np.bincount(where, minlength=batch.num_rows)
            mean = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(count), pa.array(features), pa.array(mean)], names=["key", "n_words", "n_features", "weight"])
            if len(trie.state) > NODES:
                trie.clear()

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, floored, from the first 8 hex digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (key, score) with rank, highest score first, smaller keys first among ties: sorted over all partitions, whose
    sizes give each its first rank."""
    order = [F.desc("score"), F.asc_nulls_last("key")]
    place = common.materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    return common.numbered(place, "place", "rank").withColumn("rank", F.col("rank") + 1).drop("place")


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """key, n_words, n_features, weight, score and rank (null: not drawn) of each row of docs: percent % of those with
    at least ``least`` words, the likelier the nearer to the target's distribution."""
    corpus, aim = docs.select(F.col(f"`{text}`")), target.select(F.col(f"`{target_text}`"))
    gains = bucket_gains(bucket_counts(corpus, n, buckets), bucket_counts(aim, n, buckets))
    weighed = weigh(docs, gains, key=key, text=text, n=n)
    scored = common.materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "scored")
    fit = F.col("n_words") >= least
    bins = sorted(((r.bin, r["count"]) for r in scored.where(fit).groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect()), reverse=True)  # gains and noise are bounded, and so the bins
    wanted, cut, seen = percent * sum(c for _, c in bins) // 100, None, 0
    for b, c in bins:
        if seen >= wanted:
            break
        cut, seen = b * BIN, seen + c
    none = F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return scored.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", none)
    high = fit & (F.col("score") >= cut)
    ranked = _ranked(scored.where(high)).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    out = scored.where(~high).withColumn("rank", none).unionByName(ranked)
    return out.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")
