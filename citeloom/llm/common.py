"""What several operators share: tables, shared scratch tables and byte-level tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.scratch import cut_lineage as materialise  # noqa: F401
from citeloom.operators.scratch import discard, shared_dir  # noqa: F401

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text that are tokenised in one numpy pass.
SEGMENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matching(docs: DataFrame, found: DataFrame, how: str, *, key: str, text: str) -> DataFrame:
    """docs' rows (left_semi) with a row in found, or without (left_anti): the same first column (the
    key) and second (a hash of the text). Columns of docs may have any names."""
    k, p = (f"__{uuid.uuid4().hex}" for _ in range(2))
    return docs.join(found.toDF(k, p).distinct(), F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(p)), how)


def numbered(df: DataFrame, place: str, name: str) -> DataFrame:
    """A written df with gapless numbers from 0 in the order of place, a number that monotonically_increasing_id made
    (or one that numbers from 0 within each partition in its lower 33 bits)."""
    of = F.shiftright(place, 33)
    first, at = [], 0
    for p, n in sorted((r.p, r["count"]) for r in df.groupBy(of.alias("p")).count().collect()):  # a row for each partition
        first.append((p, at))
        at += n
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "__p bigint, __first bigint"))
    return df.join(starts, of == F.col("__p")).withColumn(name, F.col("__first") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__first")


def join_by_share(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, share: int) -> DataFrame:
    """Inner join with distinct keys of right. Its rows whose weight is more than 1/share of the total, at most share of them,
    are broadcast, so that no key with very many rows of left meets in one task."""
    hot = F.col(weight) * share > total
    few = right.where(hot)
    met = left.join(F.broadcast(few.withColumn("__hot", F.lit(True))), on, "left")
    cold = met.where("__hot is null").select(*left.columns).join(right.where(~hot), on)
    return met.where("__hot").drop("__hot").unionByName(cold)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def rate_filter(key: Column, share: Column) -> Column:
    """True for a share of the rows, chosen by a hash of the key and so the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)


# --- byte-level tokens ---------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, _SIZE = 0x9E3779B97F4A7C15, 0
_POW = _INV = np.ones(1, np.uint64)
#: A random 64-bit number for each byte; A-Z share those of a-z.
_RANDOM = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_RANDOM[65:91] = _RANDOM[97:123]

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Each byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is neither a digit, a letter nor beyond ASCII.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, SEGMENT)
        inverse = pow(_BASE, -1, 1 << 64)
        _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        _INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
    return _POW, _INV


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _pieces(raw: np.ndarray, off: np.ndarray, delimiter: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end where a text or a token ends."""
    cuts, at, end = [0], 0, int(off[-1]) if len(off) else 0
    while at < end:
        k = int(np.searchsorted(off, at + SEGMENT, "right")) - 1
        nxt = int(off[k])
        if nxt <= at:  # one long text: cut at a delimiter
            nxt = min(at + SEGMENT, end)
            while nxt < end:
                gap = np.flatnonzero(delimiter[raw[nxt : nxt + SEGMENT]])
                stop = int(off[np.searchsorted(off, nxt, "left")])
                nxt = min(stop, nxt + int(gap[0])) if len(gap) else min(stop, nxt + SEGMENT)
                if len(gap) or nxt == stop:
                    break
        cuts.append(nxt)
        at = nxt
    return list(zip(cuts, cuts[1:]))


def tokens(column: pa.Array, delimiter: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pointers): the 64-bit hash of each lower-cased token (runs of bytes that aren't
    delimiters) of all texts, and where each text's tokens begin."""
    return spans(*text_bytes(column), delimiter)[:2]


def spans(raw: np.ndarray, off: np.ndarray, delimiter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As tokens, of bytes and offsets, with the first byte of each token and the byte after its last."""
    hashes, starts, ends = [], [], []
    for a, b in _pieces(raw, off, delimiter):
        part = raw[a:b]
        word = ~delimiter[part]
        fresh = np.zeros(b - a + 1, bool)  # a token can't run on across a text's start
        inner = off[np.searchsorted(off, a, "left") : np.searchsorted(off, b, "right")] - a
        fresh[inner] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | fresh[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | fresh[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(b - a + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_RANDOM[part] * power[: b - a], dtype=np.uint64)])
        hashes.append(_mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else s
    return h, np.searchsorted(s, off, "left"), s, e


def cut_out(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """The strings raw[start:end], whose ranges are in order and don't overlap."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    data = raw[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(data))


def windows(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) of each n tokens in a row of each text, in order. A text with fewer tokens,
    but some, gives one window of all of them."""
    count = np.diff(ptr)
    full = np.maximum(count - n + 1, 0)
    w = np.zeros(0, np.uint64)
    if len(h) >= n:
        m = len(h) - n + 1
        w = np.zeros(m, np.uint64)
        for k in range(n):
            w = _mix(w * np.uint64(0x9FB21C651E98DF25) + h[k : k + m])
    text = np.repeat(np.arange(len(count)), full)
    at = np.arange(len(text)) + np.repeat(ptr[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full)
    w = w[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([_chain(h[ptr[i] : ptr[i + 1]]) for i in short], np.uint64)
        w, text = np.concatenate([w, extra]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        w, text = w[order], text[order]
    return w, text


def _chain(h: np.ndarray) -> np.uint64:
    x = np.full(1, len(h) + 1, np.uint64)
    for k in range(len(h)):
        x = _mix(x * np.uint64(0x9FB21C651E98DF25) + h[k : k + 1])
    return x[0]


def distinct_per_text(w: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pointers): the distinct windows of each text, sorted within it."""
    ptr = np.searchsorted(text, np.arange(n + 1))
    parts, size = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        part = np.sort(w[ptr[i] : ptr[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        parts.append(part)
        size[i + 1] = len(part)
    return np.concatenate(parts) if parts else w[:0], np.cumsum(size)


def small_batches(batches, column: str = "text", limit: int = 4 << 20):
    """Arrow batches cut so that each has few bytes of text; a single long text stays whole."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        _, off = text_bytes(batch.column(k))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, min(b, n) - a)
            a = min(b, n)


# --- a filter of fixed size ----------------------------------------------------------------------

FILTER_BITS = 1 << 26


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(h)
    return h & np.uint64(FILTER_BITS - 1), h >> np.uint64(32) & np.uint64(FILTER_BITS - 1)


def make_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap that holds all of a long column's values, and some others; its size is fixed."""

    piece = 1 << 13  # bytes of the bitmap in a row

    def mark(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for b in _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                bits[b] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, piece)
        on = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_pydict({"piece": pa.array(on, pa.int32()), "bits": pa.array([packed[i].tobytes() for i in on], pa.binary())})

    def unite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = np.zeros(piece, np.uint8), None
        for part in parts:
            for x in part.column("bits"):
                out |= np.frombuffer(x.as_py(), np.uint8)
            at = part.column("piece")[0].as_py()
        yield pa.RecordBatch.from_pydict({"piece": pa.array([at], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    source = df.select(F.col(column).cast("bigint").alias("x")).where("x is not null")
    bitmap = np.zeros((FILTER_BITS // 8 // piece, piece), np.uint8)
    for r in source.mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInArrow(unite, "piece int, bits binary").collect():  # a fixed number of rows
        bitmap[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return bitmap.ravel()


def in_filter(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bits(h)
    return ((bitmap[a >> np.uint64(3)] >> (a & np.uint64(7))) & (bitmap[b >> np.uint64(3)] >> (b & np.uint64(7))) & 1).astype(bool)
