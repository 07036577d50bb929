"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Examples are a bounded sample of labelled texts, each with all of its words; document frequencies for
IDF are counted over all texts. A word's entry is (1 + ln tf) * idf, and rows have unit length: labels have no part in
cosines. Some examples are near to everything, so nearness is the cosine in standard deviations
above the example's mean cosine with all other examples. The examples lie in an inverted index in blocks; a block whose
largest possible nearness is under the k-th best so far is not opened, so the k nearest are exact. Words that many
examples hold are multiplied as one dense matrix for a batch of texts before the blocks' bounds are taken. Votes
weighted by nearness are calibrated by isotonic regression over the examples themselves, each left
out of its own vote. Means and votes of examples are Spark jobs.

Defined results: a null or empty text, or one without a word of any example, gets the calibrated
share of toxic examples without such words; ties between examples go to the smaller position; with
no labelled example all scores are 0. A label or key that is null is no example; of rows that repeat
a key the smallest text is its example. Repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citeloom.llm import common

#: Examples of each label, about; nearest examples; texts in a block of the index; blocks opened first.
SAMPLE, NEAREST, BLOCK, FIRST = 3000, 100, 128, 4
#: A word is common if this share of the examples holds it; texts whose common words are multiplied at once.
COMMON, TOGETHER = 1 / 32, 128
#: Weight of the prior in a vote.
PRIOR = 0.5


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (n of them) of each range, one after the other."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


@dataclass
class Index:
    words: np.ndarray  # sorted hashes
    scale: np.ndarray  # of each word
    label: np.ndarray
    weight: np.ndarray  # of a label's example: rows it stands for
    rows: list[tuple[np.ndarray, np.ndarray]]
    prior: float = 0.0
    #: Examples and entries by word; (word, block) runs of them: first run of a word, block, largest entry, first entry.
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    #: Each example's mean cosine with the others and its deviation; entries are divided by the latter.
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    deviation: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def build(self) -> Index:
        size = [len(at) for at, _ in self.rows]
        word = np.concatenate([*[at for at, _ in self.rows], np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        word, self.example = word[order], np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        self.entry = np.concatenate([*[v for _, v in self.rows], np.zeros(0)])[order]
        block = self.example // BLOCK
        fresh = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])])) if len(word) else np.zeros(0, np.int64)
        self.start = np.append(fresh, len(word)).astype(np.int32)
        self.block, self.most = block[fresh].astype(np.int16), np.maximum.reduceat(self.entry, fresh) if len(fresh) else np.zeros(0)
        self.first = np.searchsorted(word[fresh], np.arange(len(self.words) + 1)).astype(np.int32)
        self.mean, self.deviation = np.zeros(len(size)), np.ones(len(size))
        return self

    def cosines(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of a text and all examples, before these are standardised."""
        a = self.start[self.first[at]].astype(np.int64)
        n = self.start[self.first[at + 1]] - a
        e = _ranges(a, n)
        return np.bincount(self.example[e], self.entry[e] * np.repeat(v, n), len(self.label))

    def around(self, i: int, at: np.ndarray, v: np.ndarray) -> tuple[float, float]:
        """The mean and deviation of example i's cosines with the others."""
        others = np.delete(self.cosines(at, v), i)
        return (float(others.mean()), float(others.std())) if len(others) else (0.0, 1.0)

    def standardise(self, mean: np.ndarray, deviation: np.ndarray) -> Index:
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.entry = self.entry / self.deviation[self.example]
        self.most = np.maximum.reduceat(self.entry, self.start[:-1]) if len(self.entry) else self.most
        return self

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each common word or -1, their entries by example); made once in each worker."""
        if (made := self.__dict__.get("_dense")) is None:
            n = self.start[self.first[1:]] - self.start[self.first[:-1]]
            common_words = np.flatnonzero(n > COMMON * len(self.label))
            row = np.full(len(self.words), -1)
            row[common_words] = np.arange(len(common_words))
            d = np.zeros((len(common_words), len(self.label)))
            e = _ranges(self.start[self.first[common_words]].astype(np.int64), n[common_words])
            d[np.repeat(np.arange(len(common_words)), n[common_words]), self.example[e]] = self.entry[e]
            made = self.__dict__["_dense"] = row, d
        return made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    def partly(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common words give to the nearness of each text and example."""
        row, d = self.dense()
        q = np.zeros((len(vectors), len(d)))
        for i, (at, v) in enumerate(vectors):
            r = row[at]
            q[i, r[r >= 0]] = v[r >= 0]
        return q @ d

    def vector(self, h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and normalised entries of the examples' words among hashes h (n: how often each)."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0)
        if n is None:
            h, n = np.unique(h, return_counts=True)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        on = self.words[at] == h
        at = at[on]
        v = (1 + np.log(n[on])) * self.scale[at]
        norm = np.sqrt((v * v).sum())
        return at, v / norm if norm else v

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int, part: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k nearest examples, of those nearer than their mean, exactly: (nearness, example). part: what partly gives for the text."""
        cos = (self.partly([(at, v)])[0] if part is None else part) - self.mean / self.deviation
        rare = self.dense()[0][at] < 0
        at, v = at[rare], v[rare]
        n = self.first[at + 1] - self.first[at]
        runs, w = _ranges(self.first[at], n), np.repeat(v, n)
        block = self.block[runs]
        bound = np.bincount(block, self.most[runs] * w, -(-len(self.label) // BLOCK)) + np.maximum.reduceat(cos, np.arange(0, len(cos), BLOCK))
        order, kth = np.argsort(-bound, kind="stable"), 0.0
        for part in (order[:FIRST], order[FIRST:]):  # then all others that the k-th best so far does not rule out
            chosen = np.zeros(len(bound), bool)
            chosen[part] = bound[part] > max(kth - 1e-9, 0.0)
            if not chosen.any():
                break
            on = chosen[block]
            a = self.start[runs[on]]
            m = self.start[runs[on] + 1] - a
            e = _ranges(a, m)
            cos += np.bincount(self.example[e], self.entry[e] * np.repeat(w[on], m), len(cos))
            kth = float(np.partition(cos, len(cos) - k)[len(cos) - k]) if len(cos) > k else 0.0
        i = np.flatnonzero((cos > 0) & (cos >= kth))
        i = i[np.lexsort((i, -cos[i]))[:k]]
        return list(zip(cos[i].tolist(), i.tolist()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        total, yes = PRIOR, PRIOR * self.prior
        for c, i in near:
            total += c * self.weight[i]
            yes += c * self.weight[i] * self.label[i]
        return yes / total

    def own_vote(self, i: int, at: np.ndarray, v: np.ndarray, part: np.ndarray | None = None) -> float:
        """The vote on example i by the others; -1 where it has no word."""
        return self.vote([x for x in self.nearest(at, v, NEAREST + 1, part) if x[1] != i][:NEAREST]) if len(at) else -1.0

    def calibrate(self, raw: np.ndarray) -> Index:
        """Isotonic steps (pooled adjacent violators) from the examples' own votes to their labels."""
        values, where = np.unique(raw, return_inverse=True)
        n, yes = np.bincount(where, self.weight), np.bincount(where, self.weight * self.label)
        blocks: list[list[float]] = []  # [first value, yes, n]
        for x, y, m in zip(values, yes, n):
            blocks.append([x, y, m])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1][1] += last[1]
                blocks[-1][2] += last[2]
        self.steps = np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
        return self

    def score(self, at: np.ndarray, v: np.ndarray, part: np.ndarray | None = None) -> tuple[float, list[int], list[float]]:
        near = self.nearest(at, v, NEAREST, part) if len(at) else []
        raw = self.vote(near) if len(at) else -1.0
        k = max(0, int(np.searchsorted(self.steps[0], raw, "right")) - 1)
        return float(self.steps[1][k]), [i for _, i in near[:3]], [round(c * self.deviation[i] + self.mean[i], 6) for c, i in near[:3]]


def _hashes(column: pa.Array) -> list[np.ndarray]:
    h, ptr = common.tokens(column, common.NOT_ALNUM)
    return [h[a:b] for a, b in zip(ptr, ptr[1:])]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, "__text"):
        found = [np.unique(h, return_counts=True) for h in _hashes(batch.column("__text"))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))], names=["key", "y", "h", "n"])


def _of_examples(examples: DataFrame, index: Index, place: dict, of) -> list[tuple[int, float, float]]:
    """What a function of the index and an example's place and entries gives for each example: its place and two numbers."""
    spark = examples.sparkSession
    shared = spark.sparkContext.broadcast((replace(index, rows=[]), place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, places = shared.value
        for batch in batches:
            at = [places[k] for k in batch.column("key").to_pylist()]
            found = [of(own, i, *own.vector(h.values.to_numpy().view(np.uint64), n.values.to_numpy())) for i, h, n in zip(at, batch.column("h"), batch.column("n"))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array([f[j] for f in found], pa.float64()) for j in range(2)]], names=["id", "one", "two"])

    out = [tuple(r) for r in examples.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "id bigint, one double, two double").collect()]
    shared.destroy()
    return out


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[Index, list]:
    """The index over about sample examples per label, among labelled texts that train holds for, and their keys."""
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    known = docs.where(train).select(key).distinct().join(marks, key)
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    share = F.coalesce(*[F.when(F.col("__y") == y, F.lit(min(1.0, sample / n))) for y, n in counts.items()], F.lit(0.0))
    # About sample keys per label: few enough to broadcast, so that no other text is moved. One text stands for a key that repeats.
    chosen = F.broadcast(known.where(common.rate_filter(F.col(key), share)))
    rows = docs.where(train).select(key, F.coalesce(text, F.lit("")).alias("__text")).join(chosen, key).groupBy(F.col(key).alias("key")).agg(F.min("__text").alias("__text"), F.first("__y").alias("y"))
    kind = dict(docs.dtypes)[key]
    examples = common.materialise(rows.mapInArrow(_counted, f"key {kind}, y {dict(marks.dtypes)['__y']}, h array<bigint>, n array<bigint>"), "examples")
    got = examples.toArrow()  # about 2 * sample rows of word hashes
    flat = {c: got[c].combine_chunks() for c in ("h", "n")}
    off = flat["h"].offsets.to_numpy() if got.num_rows else np.zeros(1, np.int32)
    hashes, times = (flat[c].values.to_numpy() if got.num_rows else np.zeros(0, np.int64) for c in ("h", "n"))
    sets = {k: (hashes[a:b].view(np.uint64), times[a:b]) for k, a, b in zip(got["key"].to_pylist(), off, off[1:])}
    marked = got["y"].to_pylist()
    y_of = dict(zip(sets, (float(y > 0) for y in marked)))
    words = np.unique(hashes.view(np.uint64))
    weight_of = dict(zip(sets, (max(1.0, counts[y] / sample) for y in marked)))

    shared_words = spark.sparkContext.broadcast(words)

    def df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared_words.value
        count, texts = np.zeros(len(every), np.int64), 0
        for batch in common.small_batches(batches):
            for h in _hashes(batch.column(0)):
                texts += 1
                if len(every):
                    at = np.minimum(np.searchsorted(every, h), len(every) - 1)
                    count[np.unique(at[every[at] == h])] += 1
        on = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"w": pa.array(np.concatenate([[-1], on]), pa.int32()), "n": pa.array(np.concatenate([[texts], count[on]]), pa.int64())})

    found = docs.select(F.col(text).alias("text")).mapInArrow(df, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["w"].to_numpy(), found["n"].to_numpy()
    seen = np.zeros(len(words), np.int64)
    seen[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / (1 + seen))
    keys = sorted(sets)
    places = {k: np.searchsorted(words, sets[k][0]) for k in keys}
    scale = idf
    # Examples with the same heaviest word lie side by side, which makes a block's bounds tight.
    heaviest = {k: int(places[k][np.argmax((1 + np.log(sets[k][1])) * scale[places[k]])]) if len(places[k]) else -1 for k in keys}
    keys.sort(key=lambda k: (heaviest[k], k))
    y, weight = np.array([y_of[k] for k in keys]), np.array([weight_of[k] for k in keys])
    index = Index(words, scale, y, weight, [], float((weight * y).sum() / weight.sum()) if len(y) else 0.0)
    index.rows = [index.vector(*sets[k]) for k in keys]
    index.build()
    if keys:
        place = {k: i for i, k in enumerate(keys)}
        for i, mean, deviation in _of_examples(examples, index, place, lambda own, i, at, v: own.around(i, at, v)):
            index.mean[i], index.deviation[i] = mean, deviation
        index.standardise(index.mean, index.deviation)
        raw = np.zeros(len(keys))
        for i, vote, _ in _of_examples(examples, index, place, lambda own, i, at, v: (own.own_vote(i, at, v), 0.0)):
            raw[i] = vote
        index.calibrate(raw)
        index.rows = []
    return index, keys


def score(docs: DataFrame, index: Index, keys: list, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with score, predicted and evidence (the nearest examples' keys and cosines)."""
    made = ("score", "predicted", "evidence", "cosines")
    names = [c for c in docs.columns if c != text and c not in made]
    kind = docs.schema[key].dataType if key in docs.columns else T.LongType()
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in names], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(kind)), T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_type(kind)
    shared = docs.sparkSession.sparkContext.broadcast((replace(index, rows=[]), keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = shared.value
        for batch in common.small_batches(batches, "__text"):
            scores, who, cos = [], [], []
            vectors = [own.vector(h) for h in _hashes(batch.column("__text"))]
            cuts = [vectors[a : a + TOGETHER] for a in range(0, len(vectors), TOGETHER)]
            for at, v, part in ((*x, p) for some in cuts for x, p in zip(some, own.partly(some))):
                got = own.score(at, v, part)
                scores.append(got[0]), who.append([ids[i] for i in got[1]]), cos.append(got[2])
            yield pa.RecordBatch.from_arrays([*[batch.column(f"__{i}") for i in range(len(names))], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(who, pa.list_(arrow)), pa.array(cos, pa.list_(pa.float64()))], names=[*names, *made])

    source = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(run, schema)
