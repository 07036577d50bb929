"""Titles of one table against all of another: an exact join for the ratio of matching characters.

The ratio is 2 M / (a + b) of two titles of a and b characters with M characters in matching blocks.
A ratio of t or more bounds everything that is cheap to look at:

- M >= ceil(t (a + b) / 2), so lengths differ little and that many characters are shared, copies counted;
- u = a + b - 2 M characters don't match, so there are at most u + 1 blocks, and at least M - u - 1 pairs of
  neighbouring characters are shared, copies counted.

No pair of characters is rare enough in titles to lead from one to those that are alike: as much as 0.85 leaves every third pair
open, so titles that meet by their rarest ones do so several times each. All pairs in the same or a neighbouring band of lengths are
held against both bounds instead, by signatures of fixed size and many at a time in numpy. What is left is held against the
longest common subsequence (M characters in matching blocks are one), with a bit for each character; only then is the ratio itself computed.
This work grows with the square of the distinct titles, but at some tens of nanoseconds a pair; nothing caps it.

Each side's titles are joined once, however many rows have them. The titles of a band are dealt to chunks of bounded size by their
hashes; a group is a chunk of each side, so memory is bounded and no frequent element or length gathers rows in one task.

Defined results: titles are compared as title_key leaves them; empty and null ones are alike to nothing;
equal titles have ratio 1; an empty table gives no rows.
"""

from __future__ import annotations

import difflib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import ids
from citeloom.operators.scratch import cut_lineage
from citeloom.operators.text import title_key

#: Titles of a chunk at the least (where there are so many) and at the most, and its characters.
FEWEST, MOST, CHARACTERS = 1 << 10, 1 << 14, 1 << 20
#: Titles of one side that are held against all of a chunk at once, and pairs whose subsequences are measured at once.
ROWS, PAIRS = 32, 1 << 12


def element_size(t: float) -> int:
    """2 if titles of any length that are alike, but not equal, share a pair of characters at least."""
    return 2 if 3 * t > 2 and all(least_shared(a, t, 2) != 0 for a in range(1, math.ceil(4 / (3 * t - 2)) + 4)) else 1


def _elements(title: str, q: int) -> list[str]:
    """Runs of q characters, each with the number of its copy."""
    seen: Counter = Counter()
    out = []
    for i in range(len(title) - q + 1):
        g = title[i : i + q]
        seen[g] += 1
        out.append(f"{g}{seen[g]}")
    return out


def _up(x: float) -> int:
    return math.ceil(x - 1e-9)


def matching(a: int, b: int, t: float) -> int:
    """How many characters of titles of these lengths match at least."""
    return _up(t * (a + b) / 2)


def shared(a: int, b: int, t: float, q: int) -> int:
    """How many elements of titles of these lengths are shared at least."""
    m = matching(a, b, t)
    return m if q == 1 else m - (a + b - 2 * m) - 1


def shortest(a: int, t: float) -> int:
    return _up(a * t / (2 - t))


def least_shared(a: int, t: float, q: int) -> int | None:
    """How many elements a title of this length shares at least with any that is alike but not equal; None if there is no such."""
    low, high = shortest(a, t), math.floor(a * (2 - t) / t + 1e-9)
    bounds = [shared(a, b, t, q) for b in range(low, high + 1) if matching(a, b, t) <= min(a, b) and (a != b or matching(a, b, t) < a)]
    return max(0, min(bounds)) if bounds else None


def band(length: int, t: float) -> int:
    """Titles that are alike are in the same band or in neighbours."""
    return int(math.log(max(length, 1)) / math.log((2 - t) / t) + 1e-9) if t < 1 else length


#: Longs of a signature of a title's elements, and of its characters.
LONGS = 16


def _signature(elements: Iterable[str]) -> list[int]:
    """A bit for each element. Bits that one title has and another lacks are no more than the elements that it has and the other lacks."""
    bits = [0] * LONGS
    for x in elements:
        h = zlib.crc32(x.encode()) % (64 * LONGS)
        bits[h >> 6] |= 1 << (h & 63)
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def _signed(titles: DataFrame, t: float, q: int) -> DataFrame:
    """title, its length and band, and the signatures of its elements and of its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column(0).to_pylist()
            signs = [np.array([*_signature(_elements(x, q)), *_signature(_elements(x, 1))], "<i8").tobytes() for x in xs]
            columns = [pa.array(xs, pa.string()), pa.array([len(x) for x in xs], pa.int64()), pa.array([band(len(x), t) for x in xs], pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["title", "len", "band", "sign"])

    return titles.select("title").mapInArrow(run, "title string, len bigint, band bigint, sign binary")


class _Chunk:
    """Titles in order of length: lengths, and signatures of elements in short, of elements and of characters, with the number of bits in each."""

    def __init__(self, rows: pa.Table) -> None:
        self.titles = rows.column("title")
        self.order = np.argsort(rows.column("len").to_numpy(), kind="stable")
        self.len = rows.column("len").to_numpy()[self.order]
        signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), "<u8").reshape(-1, 2 * LONGS)[self.order]
        half = LONGS // 2
        self.signs = [signs[:, :half] | signs[:, half:LONGS], signs[:, :LONGS], signs[:, LONGS:]]
        self.bits = [np.bitwise_count(x).sum(1, dtype=np.int32) for x in self.signs]


def _survivors(a: _Chunk, b: _Chunk, t: float, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two chunks that can be alike by their lengths and signatures."""
    for n in np.unique(a.len).tolist():
        m = np.ceil(t * (n + b.len) / 2 - 1e-9).astype(np.int32)
        on = np.flatnonzero(m <= np.minimum(n, b.len))
        m, length = m[on], b.len[on].astype(np.int32)
        need = m if q == 1 else 3 * m - n - length - 1
        # What a title has and the other lacks is no more than all of its elements without those that must be shared.
        shared_of = [(need - (n - q + 1), need - (length - q + 1))] * 2 + [(m - n, m - length)]
        columns = np.ascontiguousarray(b.signs[0][on].T)
        first, last = np.searchsorted(a.len, [n, n + 1])
        for i in range(first, last if len(on) else first, ROWS):
            rows = slice(i, min(i + ROWS, last))
            same = np.zeros((rows.stop - i, len(on)), np.int32)
            for mine, column in zip(a.signs[0][rows].T, columns):
                same += np.bitwise_count(mine[:, None] & column)
            own, at = np.nonzero((same >= a.bits[0][rows][:, None] + shared_of[0][0]) & (same >= b.bits[0][on] + shared_of[0][1]))
            for k in (1, 2):
                x, y = own + i, on[at]
                same = np.bitwise_count(a.signs[k][x] & b.signs[k][y]).sum(1, dtype=np.int32)
                kept = (same >= a.bits[k][x] + shared_of[k][0][at]) & (same >= b.bits[k][y] + shared_of[k][1][at])
                own, at = own[kept], at[kept]
            yield a.order[own + i], b.order[on[at]]


def _pairs(group: DataFrame, t: float, q: int) -> DataFrame:
    """a and b: the titles of two chunks that can be alike, and are not equal. A group has both chunks; its pairs go on a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        left, right = (rows.filter(pc.equal(rows["right"], side)).combine_chunks() for side in (False, True))
        if left.num_rows and right.num_rows:
            a, b = _Chunk(left), _Chunk(right)
            for x, y in _survivors(a, b, t, q):
                if len(x):
                    met = pa.table({"a": a.titles.take(pa.array(x)), "b": b.titles.take(pa.array(y))})
                    yield from met.filter(pc.not_equal(met["a"], met["b"])).combine_chunks().to_batches()

    return group.applyInArrow(run, "a string, b string")


def _codes(titles: list[str], known: np.ndarray) -> np.ndarray:
    """The characters of titles, one in each row, by their numbers from 1; 0 for others and behind a title."""
    width = max(map(len, titles))
    wide = np.frombuffer("".join(x.ljust(width, "\0") for x in titles).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(titles), width)
    at = np.minimum(np.searchsorted(known, wide), len(known) - 1)
    inside = np.arange(width) < np.array([len(x) for x in titles])[:, None]
    return np.where((known[at] == wide) & inside, at + 1, 0)


def common(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair of titles, with a bit for each character of the first."""
    once = list(dict.fromkeys(a))
    place = {x: i for i, x in enumerate(once)}
    known = np.unique(np.frombuffer("".join(once).encode("utf-32-le", "surrogatepass"), "<u4"))
    codes, words = _codes(once, known), -(-max(map(len, once)) // 64)
    masks = np.zeros((words, len(once), len(known) + 1), np.uint64)
    for p, column in enumerate(codes.T):
        masks[p >> 6, np.arange(len(once)), column] |= np.uint64(1 << (p & 63))
    masks[:, :, 0] = 0
    masks = masks.reshape(words, -1)
    own = np.array([place[x] for x in a]) * (len(known) + 1)
    state = np.full((words, len(a)), ~np.uint64(0))
    for column in np.ascontiguousarray(_codes(b, known).T):
        here, carry = own + column, np.uint64(0)
        for w in range(words):
            s = state[w]
            u = s & masks[w][here]
            added = s + u
            more = added + carry
            carry = ((added < u) | (more < carry)).astype(np.uint64) if w + 1 < words else carry
            state[w] = more | (s ^ u)
    return 64 * words - np.bitwise_count(state).sum(0, dtype=np.int64)


def _verified(pairs: DataFrame, t: float, q: int) -> DataFrame:
    """a, b and ratio of the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, found = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            step = max(1, PAIRS // -(-max(map(len, [*left, *right, " "])) // 64))
            for i in range(0, len(left), step):
                one, two = left[i : i + step], right[i : i + step]
                for a, b, n in zip(one, two, common(one, two).tolist()):
                    if n >= matching(len(a), len(b), t) and (r := difflib.SequenceMatcher(None, a, b).ratio()) >= t:
                        found.append((a, b, r))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["a", "b", "ratio"])

    return pairs.mapInArrow(run, "a string, b string, ratio double")


def _meetings(one: DataFrame, two: DataFrame, t: float, parts: int) -> list[tuple[int, int, int, int]]:
    """Bands of both sides whose titles can be alike, and the numbers of chunks of these."""
    n, m = ({r.band: (r.n, r.c) for r in side.groupBy("band").agg(F.count("*").alias("n"), F.sum("len").alias("c")).collect()} for side in (one, two))
    total = math.sqrt(sum(x for x, _ in n.values()) * sum(x for x, _ in m.values()))
    size = min(MOST, max(FEWEST, math.ceil(total / math.sqrt(8 * parts))))
    chunks = lambda x, c: max(-(-x // size), -(-c // CHARACTERS))
    return [(i, j, chunks(*n[i]), chunks(*m[j])) for i in n for j in (i - 1, i, i + 1) if j in m]


def alike(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b and ratio of all pairs of distinct titles (columns title, already title_keys) whose ratio is at least least."""
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    q, spark = element_size(least), left.sparkSession
    distinct = lambda df: df.select("title").where("title <> ''").distinct()
    if least == 1:
        one, two = distinct(left), distinct(right)
    else:
        one, two = cut_lineage(_signed(distinct(left), least, q), "titles"), cut_lineage(_signed(distinct(right), least, q), "titles")
    equal = one.select(F.col("title").alias("a")).join(two.select(F.col("title").alias("b")), F.col("a") == F.col("b")).withColumn("ratio", F.lit(1.0))
    if least == 1:
        return equal
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meetings = F.broadcast(spark.createDataFrame(_meetings(one, two, least, parts), "b bigint, c bigint, n bigint, m bigint"))
    group = ["b", "c", "i", "j"]
    chunk = lambda of: F.pmod(F.xxhash64("title"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    x = one.join(meetings, F.col("band") == F.col("b")).select("b", "c", chunk("n").alias("i"), every("m").alias("j"), F.lit(False).alias("right"), "title", "len", "sign")
    y = two.join(meetings, F.col("band") == F.col("c")).select("b", "c", every("n").alias("i"), chunk("m").alias("j"), F.lit(True).alias("right"), "title", "len", "sign")
    met = _pairs(x.unionByName(y).repartition(parts, *group).groupBy(*group), least, q)
    return _verified(met, least, q).unionByName(equal)


def match(items: DataFrame, papers: DataFrame, least: float = 0.85, key: str = "item", paper: str = "paperId") -> DataFrame:
    """key, match, confidence and how ('doi', 'title' or 'none') of each item: the paper with its DOI, else that
    with the most similar title, if alike enough; the smallest paper id decides between equals. Both tables have title and doi."""
    # Both are read several times; what they come from (parsed pages, say) is made once.
    own = cut_lineage(items.select(F.col(key).alias("k"), title_key(F.coalesce("title", F.lit(""))).alias("t"), ids.match_doi(F.col("doi")).alias("d")), "items")
    known = cut_lineage(papers.select(F.col(paper).alias("p"), title_key(F.coalesce("title", F.lit(""))).alias("u"), ids.match_doi(F.col("doi")).alias("e")), "papers")
    by_doi = known.where("e is not null").groupBy("e").agg(F.min("p").alias("match"))
    # Rows without a DOI have no key to be joined by; they stay out of the join.
    with_doi = own.where("d is not null").join(by_doi, F.col("d") == F.col("e"), "left").drop("e")
    rest = with_doi.where("match is null").drop("match").unionByName(own.where("d is null"))
    pairs = cut_lineage(alike(rest.select(F.col("t").alias("title")), known.select(F.col("u").alias("title")), least), "alike")
    owners = known.where("u <> ''").groupBy("u").agg(F.min("p").alias("match"))
    best = pairs.join(owners, F.col("b") == F.col("u")).groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "match")).alias("m"))
    return _named(with_doi.where("match is not null"), rest, best, key)


def _named(by_doi: DataFrame, rest: DataFrame, best: DataFrame, key: str) -> DataFrame:
    titled = rest.where("t <> ''").join(best, F.col("t") == F.col("a"), "left").select("k", "m.match", (-F.col("m.r")).alias("ratio")).unionByName(rest.where("t = ''").select("k", F.lit(None).alias("match"), F.lit(None).cast("double").alias("ratio")))
    out = by_doi.select("k", "match", F.lit(1.0).alias("confidence"), F.lit("doi").alias("how")).unionByName(titled.select("k", "match", F.col("ratio").alias("confidence"), F.when(F.col("match").isNotNull(), "title").otherwise("none").alias("how")))
    return out.select(F.col("k").alias(key), "match", "confidence", "how")
