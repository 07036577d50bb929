"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

Every word belongs to a leaf: the commonest words have one each, the others share one with words of
the same ending. Leaves are grouped into classes by what follows them. The model gives
P(class | history) and P(leaf | class, history), each a softmax over hashed features of the
history: the last leaf, the last two, and the leaves two and three back (skips). Within a leaf a
word has its smoothed share of the counts; words never seen have as much as those seen once.

Within a leaf that words share, features of whole words follow: each pair of neighbouring words of shared leaves that
stands in the training texts twice or more has a weight of its own, in a softmax over the leaf's known pairs and
one branch for the rest, in which every word of the leaf has its share. A word of a known pair gets what both give it, so that
the probabilities of all words, and of those never seen, add up to one after any history. Their number grows with the corpus; they are
kept and updated in the tasks that their hashes are dealt to, and never meet in one place.

Training: each task runs minibatch gradient updates (AdaGrad) over all of its texts, and the
tasks' weights are averaged, each feature by how often a task has seen it; the next round starts from the
average. Counts cover all training texts. The commonest words' counts travel with the model (a fixed number);
the others' are joined.

Defined results: a null text counts as empty: it has the end token alone; with nothing to train on,
all words are unknown. Repeated rows are scored each; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common
from citeloom.llm.common import materialise

#: Leaves of single words and of endings; classes and leaves in each; words whose counts travel; rows of hashed features.
SINGLES, ENDINGS, CLASSES, KNOWN, ROWS = 192, 64, 16, 1 << 17, 1 << 13
LEAVES = SINGLES + ENDINGS
EACH = LEAVES // CLASSES
START = LEAVES
#: Tokens of a minibatch, step size, rows of weights in a chunk.
BATCH, STEP, CHUNK = 1 << 15, 0.5, 256
#: Rounds of averaging.
ROUNDS = 2
#: Times that a pair must stand in the training texts, training tokens to a part of the pairs, tokens that a task gathers before it
#: hands them out, and works through at a time, updates of the pairs' weights and the precision of their prior.
PAIRS, PART, GATHER, SLICE, UPDATES, PRIOR = 2, 1 << 23, 1 << 20, 1 << 18, 4, 0.1
END = common._mix(np.array([0x5EED], np.uint64))[0]


def _ending(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    low = _LOWER[raw]
    return (low[e - 1] * 31 + np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0) * 7) % ENDINGS


_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, pointers) of the tokens of each text, its end token included."""
    raw, off = common.text_bytes(column)
    h, ptr, s, e = common.spans(raw, off, common.SPACES)
    return np.insert(h, ptr[1:], END), np.insert(_ending(raw, s, e), ptr[1:], 0), ptr + np.arange(len(ptr))


@dataclass
class Model:
    total: int
    distinct: int
    known: np.ndarray  # sorted hashes of the commonest words
    count: np.ndarray
    leaf: np.ndarray  # of each of known
    mass: np.ndarray  # of an ending's leaf: what its words share
    unseen: np.ndarray
    place: np.ndarray  # leaf to class * EACH + member
    bias: tuple[np.ndarray, np.ndarray] | None = None
    weights: np.ndarray | None = None  # [2 * ROWS, CLASSES]

    def look(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in known or -1, leaf)"""
        if not len(self.known):
            return np.full(len(h), -1), SINGLES + ending
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        at = np.where(self.known[at] == h, at, -1)
        leaf = np.where(at >= 0, self.leaf[at], -1)
        return at, np.where(leaf >= 0, leaf, SINGLES + ending)


def _history(leaf: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    out, now = [], leaf
    for _ in range(3):
        now = np.concatenate([[START], now[:-1]])[: len(leaf)]
        now[first] = START
        out.append(now)
    return out


def _features(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> list[np.ndarray]:
    """Hashed rows of the history's n-grams and skips."""
    mod = lambda x, k: ((x * np.int64(0x9E3779B1) + k * 0x51ED27) >> 7) & (ROWS - 1)
    return [mod(h1, 1), mod(h1 * 263 + h2, 2), mod(h2, 3), mod(h3, 4)]


def _member_rows(features: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
    return [ROWS + ((f * np.int64(0x85EBCA6B) + (cls + 1) * 0xC2B2AE35 >> 5) & (ROWS - 1)) for f in features]


def _softmax(w: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Probabilities, a column for each token; bias: one column for all or one for each."""
    z = w.take(rows[0], 0)
    for r in rows[1:]:
        z += w.take(r, 0)
    z = np.ascontiguousarray(z.T)  # sums and maxima along the long side
    z += bias.reshape(len(z), -1)
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _leaves(model):
    """Packs the leaves of each few texts and how many each text has: texts are tokenised and looked up once for all
    passes over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            h, ending, ptr = _stream(batch.column(0))
            leaf = model.value.look(h, ending)[1]
            yield pa.RecordBatch.from_pydict({"leaf": pa.array([leaf.astype(np.uint8).tobytes()], pa.binary()), "n": pa.array([np.diff(ptr).astype(np.uint32).tobytes()], pa.binary())})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leaves, where each text begins) of what _leaves has packed."""
    for batch in batches:
        for leaf, n in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(leaf.as_py(), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(n.as_py(), np.uint32).astype(np.int64))[:-1]])


def _train(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        w = np.zeros((2 * ROWS, CLASSES), np.float32) if m.weights is None else m.weights.copy()
        acc, seen = np.full((2 * ROWS, CLASSES), 1e-2, np.float32), np.zeros(2 * ROWS, np.float32)
        b1, b2 = m.bias
        held: list[list[np.ndarray]] = []

        def update(part: list[np.ndarray]) -> None:
            h1, h2, h3, leaf = part
            place = m.place[leaf]
            cls, member = place // EACH, place % EACH
            features = _features(h1, h2, h3)
            for rows, bias, target in ((features, b1, cls), (_member_rows(features, cls), b2.T.take(cls, 1), member)):
                by_class = _softmax(w, rows, bias).astype(np.float64)
                by_class[target, np.arange(len(target))] -= 1
                lo = int(rows[0].min()) // ROWS * ROWS
                sums = np.zeros((CLASSES, ROWS))
                for r in rows:
                    r = r - lo
                    seen[lo : lo + ROWS] += np.bincount(r, minlength=ROWS)
                    for k in range(CLASSES):
                        sums[k] += np.bincount(r, by_class[k], ROWS)
                total = np.ascontiguousarray(sums.T, np.float32)
                acc[lo : lo + ROWS] += total * total
                w[lo : lo + ROWS] -= STEP * total / np.sqrt(acc[lo : lo + ROWS])

        for leaf, first in _unpacked(batches):
            held.append([*_history(leaf, first), leaf])
            while sum(len(x[0]) for x in held) >= BATCH:
                joined = [np.concatenate([x[i] for x in held]) for i in range(4)]
                update([x[:BATCH] for x in joined])
                held = [[x[BATCH:] for x in joined]]
        if held and len(held[0][0]):
            update([np.concatenate([x[i] for x in held]) for i in range(4)])
        if seen.any():
            parts, n = (w * seen[:, None]).reshape(-1, CHUNK * CLASSES), seen.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.arange(len(n)), pa.int32()), "w": pa.array([x.tobytes() for x in parts], pa.binary()), "n": pa.array([x.tobytes() for x in n], pa.binary())})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, chunk = np.zeros(CHUNK * CLASSES), np.zeros(CHUNK), None
        for part in parts:
            for a, b in zip(part.column("w"), part.column("n")):
                w += np.frombuffer(a.as_py(), np.float32)
                n += np.frombuffer(b.as_py(), np.float32)
            chunk = part.column("chunk")[0].as_py()
        w = (w.reshape(CHUNK, CLASSES) / np.maximum(n, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    return run, add


def _cluster(pairs: np.ndarray) -> np.ndarray:
    """place of each leaf: classes of EACH leaves with alike neighbours, around the commonest leaves."""
    n = pairs.sum(0) + 1e-9
    both = np.concatenate([pairs, pairs.T], 1) + 1e-3
    p = both / both.sum(1, keepdims=True)
    v = np.sqrt(p)
    v -= np.sqrt(both.sum(0) / both.sum())
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
    seeds = [int(np.argmax(n))]
    while len(seeds) < CLASSES:
        seeds.append(int(np.argmin((v @ v[seeds].T).max(1) - 1e-3 * np.log(n))))
    c = v[seeds]
    who = np.zeros(LEAVES, int)
    for _ in range(6):
        near = v @ c.T
        room, who = np.full(CLASSES, EACH), np.full(LEAVES, -1)
        for i in np.argsort(-n, kind="stable"):
            j = next(j for j in np.argsort(-near[i], kind="stable") if room[j])
            who[i], room[j] = j, room[j] - 1
        c = np.stack([(v[who == j] * n[who == j, None]).sum(0) for j in range(CLASSES)])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
    place, used = np.zeros(LEAVES, np.int64), np.zeros(CLASSES, int)
    for i in range(LEAVES):
        place[i] = who[i] * EACH + used[who[i]]
        used[who[i]] += 1
    return place


def fit(docs: DataFrame, train: Column, *, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table of all training tokens' counts (h, c)."""
    spark = docs.sparkSession
    rows = docs.where(train).select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            h, ending, _ = _stream(batch.column(0))
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(u.view(np.int64)), "c": pa.array(c.astype(np.int64)), "e": pa.array(ending[first].astype(np.int32))})

    words = materialise(rows.mapInArrow(count, "h bigint, c bigint, e int").groupBy("h").agg(F.sum("c").alias("c"), F.min("e").alias("e")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # A histogram of counts in fixed steps tells which words are few enough to travel; no task sorts or sends more.
    step = F.floor(32 * F.log2("c")).cast("int")
    bins = sorted(((r["bin"], r["count"]) for r in words.groupBy(step.alias("bin")).count().collect()), reverse=True)  # 32 for each doubling
    held, cut = 0, None
    for at, n in bins:
        if held + n > KNOWN:
            break
        held, cut = held + n, at
    top = words.where(step >= (1 << 30 if cut is None else cut)).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)  # KNOWN rows at the most
    single = np.full(len(top), -1)
    single[: SINGLES - 1] = np.arange(min(len(top), SINGLES - 1))
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    single[h == END] = np.where(single[h == END] >= 0, single[h == END], SINGLES - 1)
    alone = [int(x) for x in top["h"][single >= 0]]
    share = {r["e"]: r for r in words.where(~F.col("h").isin(alone or [0])).groupBy("e").agg(F.sum(F.col("c") + 1).alias("mass"), F.count_if(F.col("c") == 1).alias("once")).collect()}
    unseen = np.array([max(1, share[k]["once"]) if k in share else 1 for k in range(ENDINGS)], float)
    mass = np.array([share[k]["mass"] if k in share else 0 for k in range(ENDINGS)], float) + unseen
    order = np.argsort(h)
    model = Model(int(total), int(distinct), h[order], top["c"].to_numpy(np.int64)[order], single[order], mass, unseen, np.arange(LEAVES))

    leaves = materialise(rows.mapInArrow(_leaves(spark.sparkContext.broadcast(model)), "leaf binary, n binary"), "leaves")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((LEAVES + 1) * LEAVES, np.int64)
        for leaf, first in _unpacked(batches):
            n += np.bincount(_history(leaf, first)[0] * LEAVES + leaf, minlength=len(n))
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(on, pa.int32()), "n": pa.array(n[on], pa.int64())})

    cells = leaves.mapInArrow(neighbours, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most (LEAVES + 1) * LEAVES rows
    pairs = np.zeros((LEAVES + 1) * LEAVES)
    pairs[cells["cell"].to_numpy(np.int64)] = cells["n"]
    pairs = pairs.reshape(LEAVES + 1, LEAVES)
    model.place = _cluster(pairs[:LEAVES])
    leaf_n = pairs.sum(0) + 0.5
    by_class = np.zeros((CLASSES, EACH))
    by_class[model.place // EACH, model.place % EACH] = leaf_n
    model.bias = np.log(by_class.sum(1) / by_class.sum()).astype(np.float32), np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    for _ in range(ROUNDS):
        run, add = _train(spark.sparkContext.broadcast(model))
        got = leaves.mapInArrow(run, "chunk int, w binary, n binary").groupBy("chunk").applyInArrow(add, "chunk int, w binary").collect()  # 2 * ROWS / CHUNK rows
        weights = np.zeros((2 * ROWS, CLASSES), np.float32)
        for r in got:
            weights[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["w"], np.float32).reshape(CHUNK, CLASSES)
        model.weights = weights
    return model, words.select("h", "c")


# --- features of pairs of words ------------------------------------------------------------------

_PAIR_FIELDS = "part int, d1 array<bigint>, d2 array<bigint>, train array<boolean>, doc binary, prev binary, w binary, e binary"


def _hand_out(model, parts: int):
    """Rows of tokens of shared leaves that follow another such, dealt by the preceding word and the leaf (so that no
    part is large, as none of these words is common): each part has the texts' ids and, packed, each
    token's text, preceding word, own hash and leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        texts: list[list[np.ndarray]] = []
        tokens = docs = 0

        def flush() -> pa.RecordBatch:
            doc, prev, w, e = (np.concatenate([x[i] for x in held]) for i in range(4))
            d1, d2, train = (np.concatenate([x[i] for x in texts]) for i in range(3))
            part = (common._mix(prev.astype(np.uint64) * np.uint64(ENDINGS) + e) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            doc, prev, w, e, part = doc[order], prev[order], w[order], e[order], part[order]
            cut = np.concatenate([np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [len(part)]])
            rows = []
            for a, b in zip(cut, cut[1:]):
                own, at = np.unique(doc[a:b], return_inverse=True)
                rows.append((int(part[a]), d1[own], d2[own], train[own], at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes(), prev[a:b].tobytes(), w[a:b].tobytes(), e[a:b].tobytes()))
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "d1", "d2", "train", "doc", "prev", "w", "e"])

        for batch in common.small_batches(batches, "__text"):
            h, ending, ptr = _stream(batch.column("__text"))
            _, leaf = model.value.look(h, ending)
            before = np.concatenate([[END], h[:-1]])[: len(h)]
            shared = leaf >= SINGLES
            follows = np.concatenate([[False], shared[:-1]])[: len(h)]
            follows[ptr[:-1]] = False
            on = np.flatnonzero(shared & follows)
            text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            held.append([(text[on] + docs).astype(np.uint32), (before[on] >> np.uint64(32)).astype(np.uint32), h[on], (leaf[on] - SINGLES).astype(np.uint8)])
            texts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2", "train")])
            tokens, docs = tokens + len(on), docs + batch.num_rows
            if tokens >= GATHER or docs >= 50_000:
                yield flush()
                held, texts, tokens, docs = [], [], 0, 0
        if tokens:
            yield flush()

    return run


def pair_weights(group: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each pair, normaliser of each group) of pairs' groups and counts and the groups' tokens: gradient updates
    (by their own curvature) of a softmax over a group's pairs and the rest, which counts as one more than what is left and
    half a token for each pair."""
    groups = len(total)
    rest = total - np.bincount(group, n, groups) + 0.5 * np.bincount(group, minlength=groups) + 1
    whole = rest + np.bincount(group, n, groups)
    theta = np.log(n / rest[group])
    for _ in range(UPDATES):
        p = np.exp(theta) / (1 + np.bincount(group, np.exp(theta), groups))[group]
        theta = theta + (n - whole[group] * p - PRIOR * theta) / (whole[group] * p * (1 - p) + PRIOR)
    return theta, 1 + np.bincount(group, np.exp(theta), groups)


def _weigh(model):
    """Learns a part's pair weights from its training tokens and gives, for each text, what they add to its score; h: the words
    whose shares they replace, as far as their counts don't travel with the model."""

    def learn(key: np.ndarray, w: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
        """What each token adds to its text's score; and the tokens of known pairs whose words' counts are joined later, with
        the pair's own probability and what the rest gives to the word for each of its count and one more."""
        m = model.value
        order = np.lexsort((w, key))
        key, w, train = key[order], w[order], train[order]
        new_group = np.concatenate([[True], key[1:] != key[:-1]])
        new_pair = new_group | np.concatenate([[True], w[1:] != w[:-1]])
        group, pair = np.cumsum(new_group) - 1, np.cumsum(new_pair) - 1
        first = np.flatnonzero(new_pair)
        n, total = np.bincount(pair, train), np.bincount(group, train)
        known = np.flatnonzero(n >= PAIRS)
        theta, z = pair_weights(group[first[known]], n[known], total)
        at = np.full(len(first), -1)
        at[known] = np.arange(len(known))
        at = at[pair]
        add = -np.log10(z)[group]
        has = np.flatnonzero(at >= 0)
        mass = m.mass[key[has] % ENDINGS]
        pair_share, rest_share = np.exp(theta[at[has]]) / z[group[has]], 1 / (z[group[has]] * mass)
        place = np.minimum(np.searchsorted(m.known, w[has]), max(len(m.known) - 1, 0))
        travels = m.known[place] == w[has] if len(m.known) else np.zeros(len(has), bool)
        c = m.count[place] + 1.0 if len(m.known) else np.ones(len(has))
        # In place of the word's share of its leaf: the pair's probability and the rest's times that share.
        add[has] = np.log10(mass) + np.where(travels, np.log10(pair_share + rest_share * c) - np.log10(c), 0.0)
        out = np.empty(len(add))
        out[order] = add
        later = ~travels
        return out, order[has[later]], pair_share[later], rest_share[later]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cols, docs = [], [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                d1, d2, train = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("d1", "d2", "train"))
                kind = np.uint16 if len(d1) <= 1 << 16 else np.uint32
                doc, prev, w, e = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("doc", kind), ("prev", np.uint32), ("w", np.uint64), ("e", np.uint8)))
                ids.append((d1, d2))
                cols.append((doc.astype(np.uint32) + np.uint32(docs), prev, w, e, train[doc]))
                docs += len(d1)
        doc, prev, w, e, train = (np.concatenate(x) for x in zip(*cols))
        cols.clear()
        sums, others = np.zeros(docs), []
        # Groups don't depend on each other, so a part is worked through in slices of them that need little memory.
        slices = -(-len(w) // SLICE)
        turn = (common._mix(prev.astype(np.uint64) * np.uint64(ENDINGS) + e + np.uint64(1)) % np.uint64(slices)).astype(np.uint16)
        for k in range(slices):
            on = np.flatnonzero(turn == k)
            if len(on):
                add, words, pair_share, rest_share = learn(prev[on].astype(np.int64) * ENDINGS + e[on], w[on], train[on])
                sums += np.bincount(doc[on], add, docs)
                others.append((doc[on[words]], w[on[words]].view(np.int64), pair_share, rest_share))
        other_doc, *other = (np.concatenate(x) for x in zip(*others))
        order = np.argsort(other_doc, kind="stable")
        other = [x[order] for x in other]
        cut = np.concatenate([[0], np.cumsum(np.bincount(other_doc, minlength=docs))])
        lo, hi, some = 0, 0, []
        for x in [*ids, None]:  # rows go out in batches, as a part may hold millions of texts
            if x is not None:
                hi, some = hi + len(x[0]), [*some, x]
            if some and (x is None or hi - lo >= 50_000):
                lists = [pa.ListArray.from_arrays(pa.array(cut[lo : hi + 1] - cut[lo], pa.int32()), pa.array(x[cut[lo] : cut[hi]])) for x in other]
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([y[0] for y in some])), pa.array(np.concatenate([y[1] for y in some])), pa.array(sums[lo:hi]), *lists], names=["d1", "d2", "add", "h", "a", "b"])
                yield out.filter(pa.array((sums[lo:hi] != 0) | (np.diff(cut[lo : hi + 1]) > 0)))
                lo, some = hi, []

    return run


def score(docs: DataFrame, model: Model, words: DataFrame, *, train: Column | None = None, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score (log10). train: the rows that pairs of
    words are learned from (those that the model was fitted on); none without it."""
    names = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    fields = [docs.schema[c] for c in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        b1, b2 = m.bias
        log_c, log_mass = np.log10(m.count + 1.0), np.log10(m.mass)
        for batch in common.small_batches(batches, "__text"):
            h, ending, ptr = _stream(batch.column("__text"))
            at, leaf = m.look(h, ending)
            h1, h2, h3 = _history(leaf, ptr[:-1])
            own = np.empty(len(h))
            for k in range(0, len(h), BATCH):
                cut = slice(k, k + BATCH)
                place = m.place[leaf[cut]]
                cls, member = place // EACH, place % EACH
                features = _features(h1[cut], h2[cut], h3[cut])
                row = np.arange(len(place))
                own[cut] = np.log10(_softmax(m.weights, features, b1)[cls, row].astype(float) + 1e-30) + np.log10(_softmax(m.weights, _member_rows(features, cls), b2.T.take(cls, 1))[member, row].astype(float) + 1e-30)
            base = np.where(at >= 0, log_c[at] if len(log_c) else 0.0, 0.0)
            shares = leaf >= SINGLES
            own[shares] += base[shares] - log_mass[leaf[shares] - SINGLES]
            add = lambda x: np.add.reduceat(x, ptr[:-1])  # noqa: E731  every text has its end token
            other = np.flatnonzero(at < 0)  # words whose counts are joined
            cut = np.searchsorted(other, ptr)
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([*[batch.column(f"__{i}") for i in range(len(names))], batch.column("d1"), batch.column("d2"), pa.array(np.diff(ptr), pa.int64()), pa.array(add((at >= 0).astype(np.int64)), pa.int64()), pa.array(add(base)), pa.array(add(own)), lists(h[other].view(np.int64), pa.int64()), lists(leaf[other] - SINGLES, pa.int16())], names=[*[f"c{i}" for i in range(len(names))], "d1", "d2", "n_tokens", "n_known", "base", "own", "h", "e"])

    # Rows that repeat all of their columns have one pair of ids; what is added to it is shared out again.
    every = [F.col(f"`{c}`") for c in [*names, text]]
    learned = F.coalesce(train, F.lit(False)) if train is not None else F.lit(False)
    source = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("__text"), F.xxhash64(F.lit(1), *every).alias("d1"), F.xxhash64(F.lit(2), *every).alias("d2"), learned.alias("train"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["d1 bigint, d2 bigint, n_tokens bigint, n_known bigint, base double, own double, h array<bigint>, e array<smallint>"])
    rows = materialise(source.drop("train").mapInArrow(run, schema), "scored")
    zero = F.lit(0.0)
    rare = rows.select("d1", "d2", F.explode(F.arrays_zip("h", "e")).alias("x")).select("d1", "d2", "x.h", "x.e", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    if train is not None:
        parts = max(8, -(-model.total // PART))
        pairs = source.select("__text", "d1", "d2", "train").mapInArrow(_hand_out(shared, parts), _PAIR_FIELDS)
        pairs = materialise(pairs.groupBy("part").applyInArrow(_weigh(shared), "d1 bigint, d2 bigint, add double, h array<bigint>, a array<double>, b array<double>"), "pairs")
        rare = rare.unionByName(pairs.select("d1", "d2", F.explode(F.arrays_zip("h", "a", "b")).alias("x")).select("d1", "d2", "x.h", F.lit(0).cast("smallint").alias("e"), "x.a", "x.b"))
    unseen = F.lit([float(x) for x in np.log10(model.unseen)])
    # A token's own count; where it follows a word in a known pair, the pair's and the rest's probabilities instead of that.
    own, one_more = F.col("a").isNull(), F.col("c") + 1.0
    more = rare.join(words, "h", "left").select("d1", "d2", F.when(own & F.col("c").isNotNull(), 1).otherwise(0).alias("n"), F.when(own, F.coalesce(F.log10(F.col("c") + 1.0), zero)).otherwise(zero).alias("base_more"),
                                               F.when(own, F.coalesce(F.log10(one_more), F.get(unseen, F.col("e").cast("int")))).otherwise(F.log10(F.col("a") + F.col("b") * one_more) - F.log10(one_more)).alias("own_more"), F.lit(0).alias("copies"))
    more = more.unionByName(rows.select("d1", "d2", F.lit(0).alias("n"), zero.alias("base_more"), zero.alias("own_more"), F.lit(1).alias("copies")))
    if train is not None:
        more = more.unionByName(pairs.select("d1", "d2", F.lit(0).alias("n"), zero.alias("base_more"), F.col("add").alias("own_more"), F.lit(0).alias("copies")))
    joined = more.groupBy("d1", "d2").agg(F.sum("n").alias("n"), F.sum("base_more").alias("base_more"), F.sum("own_more").alias("own_more"), F.sum("copies").alias("copies"))
    out = rows.drop("h", "e").join(joined, ["d1", "d2"])
    share = lambda c: F.col(c) / F.col("copies")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_tokens", (F.col("n_known") + share("n").cast("bigint")).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
                      (F.col("base") + share("base_more") - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1.0)))).alias("base_score"), (F.col("own") + share("own_more")).alias("score"))
