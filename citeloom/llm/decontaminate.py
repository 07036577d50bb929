"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: numbers, names (capitalised words inside a sentence) and
units (after a number) turn into typed placeholders; a run of names, or of number words, is
also tried as one. Windows of template tokens are joined by hash, and so are windows of the plain lower-cased tokens.
What meets along one diagonal of a text and an item is a placement; it counts if enough windows
meet and its slots are consistent: one value of the item always stands for one value of the text, and the other way round. So
a question asked again with other numbers and names is caught, and chance meetings are not.

Items with fewer than ``SHORTEST`` tokens have no windows: they are found where a whole line of a text has just their tokens.

Defined results: null and empty texts and items meet nothing, nor do items without a token; items
shorter than a window are one window of their own length; rows that repeat key and text are found once,
repeated items under each id; null ids are kept as they are. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common

#: Template tokens of a window, tokens in it that aren't placeholders, windows that must meet, the shortest item.
WINDOW, LITERALS, MEETINGS, SHORTEST = 8, 5, 3, 4
#: Benchmark windows up to which the benchmark's side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Fixed values.
UNITS = "mm cm m km mg g kg lb lbs oz ml l s sec seconds min minutes h hour hours day days week weeks month months year years mph kmh usd eur dollars euros cents percent degrees meters metres miles feet inches grams kilograms litres liters".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

NUM, UNIT, NAME = np.uint64(11), np.uint64(13), np.uint64(17)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n:"]] = True


def _set(words: list[str]) -> np.ndarray:
    return np.sort(common.tokens(pa.array(words, pa.string()), common.NOT_ALNUM)[0])


def _in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h


def literals(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As templates, without placeholders; the hashes meet no template's."""
    h, ptr = common.tokens(column, common.NOT_ALNUM)
    return common._mix(h + np.uint64(19)), np.zeros(len(h), np.uint64), ptr


def templates(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, slot values, pointers): a token's own hash, or its placeholder's; a slot's
    value is the token's hash, and 0 where there is no slot."""
    raw, off = common.text_bytes(column)
    h, ptr, s, e = common.spans(raw, off, common.NOT_ALNUM)
    if not len(h):
        return h, h, ptr
    first = raw[s]
    head = np.zeros(len(h) + 1, bool)
    head[ptr[:-1]] = True
    head = head[:-1]
    gap = np.concatenate([[0], e[:-1]])
    ender = np.concatenate([[0], np.cumsum(_ENDS[raw])])
    begins = head | (ender[s] > ender[np.minimum(gap, s)])
    digit = (first >= 48) & (first < 58)
    number = digit | _in(h, _set(NUMBERS))
    second = raw[np.minimum(s + 1, len(raw) - 1)]
    name = ~begins & ~number & ((first >= 65) & (first < 91) | (first == 0xC3) & (second >= 0x80) & (second < 0x9F))
    after = np.concatenate([[False], number[:-1]]) & ~head
    unit = ~number & ~name & after & _in(h, _set(UNITS))
    # "1.5" and "1,000" are one number.
    joint = digit & np.concatenate([[False], digit[:-1]]) & ~head & (s - gap == 1) & np.isin(raw[np.maximum(s - 1, 0)], [44, 46])
    # So are "twenty five" and "twenty-five", and "John Smith" is one name.
    word = number & ~digit
    close = ~head & (s - gap == 1) & np.isin(raw[np.maximum(s - 1, 0)], [32, 45])
    joint |= fold & close & (word & np.concatenate([[False], word[:-1]]) | name & np.concatenate([[False], name[:-1]]))
    value = np.where(number | name | unit, h, np.uint64(0))
    for k in np.flatnonzero(joint):  # a part's value joins the value before it
        value[k] = common._mix(value[k - 1 : k] * np.uint64(31) + h[k : k + 1])[0]
    t = np.where(number, NUM, np.where(name, NAME, np.where(unit, UNIT, h)))
    keep = np.ones(len(h), bool)
    keep[:-1] = ~joint[1:]  # the last part has the whole number's value
    kept = np.concatenate([[0], np.cumsum(keep)])
    return t[keep], value[keep], kept[ptr]


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As templates, with a run of names or number words as one slot; the hashes meet no other's."""
    t, value, ptr = templates(column, True)
    return common._mix(t + np.uint64(23)), value, ptr


def _windows(t: np.ndarray, v: np.ndarray, ptr: np.ndarray, n: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(window hash at each token, positions of windows that lie in one text and have enough literals)."""
    m = len(t) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.full(m, n, np.uint64)
    for k in range(n):
        w = common._mix(w * np.uint64(0x9FB21C651E98DF25) + t[k : k + m])
    lit = np.concatenate([[0], np.cumsum(v == 0)])
    end = np.repeat(ptr[1:], np.diff(ptr))[:m]
    return w, np.flatnonzero((np.arange(m) + n <= end) & (lit[n : n + m] - lit[:m] >= literals))


def _emit(column: pa.Array, sizes: list[int], first: int, bitmap: np.ndarray | None):
    """Rows (text, size, position, hash, slots, windows of the text) of windows that pass the filter."""
    for kind, (make, least) in enumerate(((templates, LITERALS), (folded, LITERALS), (literals, 0))):
        t, v, ptr = make(column)
        for n in sizes:
            w, at = _windows(t, v, ptr, n, min(least, n - 1))
            if first:  # items: each has windows of one size
                length = np.repeat(np.diff(ptr), np.diff(ptr))
                at = at[(length[at] >= WINDOW) if n == WINDOW else (length[at] == n)]
            if bitmap is not None and len(at):
                at = at[common.in_filter(bitmap, w[at])]
            if len(at):
                text = np.searchsorted(ptr, at, "right") - 1
                yield n, text, at - ptr[text], w[at], [v[k : k + n] for k in at], kind


def _mapper(sizes: list[int], items: bool, names: list[str], bitmap=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in common.small_batches(batches, "__text"):
            for n, text, at, w, slots, kind in _emit(batch.column("__text"), sizes, items, bits):
                rows = [batch.column(c).take(pa.array(text)) for c in names]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(at) + 1, n), pa.int32()), pa.array(np.concatenate(slots).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*rows, pa.array(at, pa.int64()), pa.array(w.view(np.int64)), flat, pa.array(np.full(len(at), kind, np.int32))], names=[*names, "at", "w", "slots", "kind"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Placements that count: key, print (a hash of the text), item, kind (0 templates, 1 with runs as one slot, 2 lower-cased tokens, 3 a line), at (first token), meetings, item_windows, altered (other
    values in its slots)."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes) | {f"item {c}": t for c, t in benchmark.dtypes}
    sizes = [WINDOW, *range(SHORTEST, WINDOW)]
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("__text"))
    items = items.mapInArrow(_mapper(sizes, True, ["item"]), f"item {kinds[f'item {item}']}, at bigint, w bigint, slots array<bigint>, kind int")
    items = common.materialise(items, "windows")
    sizes_used = [r[0] for r in items.select(F.size("slots")).distinct().collect()]  # five values at most
    total = items.groupBy("item", "kind").agg(F.count("*").alias("item_windows"))
    items = items.withColumnsRenamed({"at": "item_at", "slots": "item_slots"}).join(total.withColumnsRenamed({"item": "of", "kind": "of_kind"}), F.col("item").eqNullSafe(F.col("of")) & (F.col("kind") == F.col("of_kind"))).drop("of", "of_kind")

    bitmap = common.make_filter(items, "w")
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("__text"))
    found = source.mapInArrow(_mapper(sizes_used, False, ["key", "print"], spark.sparkContext.broadcast(bitmap)), f"key {kinds[key]}, print bigint, at bigint, w bigint, slots array<bigint>, kind int")
    other = F.broadcast(items) if items.count() <= BROADCAST_ROWS else items
    met = found.join(other, ["w", "kind"]).where(F.size("slots") == F.size("item_slots"))
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"] != 0)
    placed = met.groupBy("key", "print", "item", "kind", (F.col("at") - F.col("item_at")).alias("at")).agg(F.countDistinct("item_at").alias("meetings"), F.first("item_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    one_way = lambda k: F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x[k])))
    consistent = one_way("i") & one_way("d")
    good = placed.where((F.col("meetings") >= F.least(F.lit(MEETINGS), "item_windows")) & consistent)
    good = good.select(F.col("key").alias(key), "print", F.col("item").alias(item), "kind", "at", "meetings", "item_windows", F.exists("pairs", lambda x: x["i"] != x["d"]).alias("altered"))
    return good.unionByName(_short_lines(docs, benchmark, key=key, text=text, item=item, item_text=item_text))


def _short_lines(docs: DataFrame, benchmark: DataFrame, *, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """Placements (kind 3) of items that are too short for windows: a line with the same tokens and no others."""
    apart = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    flat = lambda c: F.trim(F.regexp_replace(F.translate(c, UPPER, UPPER.lower()), apart, " "))
    few = lambda c: (F.col(c) != "") & (F.regexp_count(c, F.lit(" ")) < SHORTEST - 1)
    items = benchmark.select(F.col(item).alias("item"), flat(F.col(item_text)).alias("line")).where(few("line"))
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    lines = lines.select("key", "print", "at", flat(F.col("raw")).alias("line")).where(few("line"))
    other = F.broadcast(items) if items.count() <= BROADCAST_ROWS else items
    one = F.lit(1).cast("bigint")
    return lines.join(other, "line").select(F.col("key").alias(key), "print", F.col("item").alias(item), F.lit(3).alias("kind"), F.col("at").cast("bigint").alias("at"), one.alias("meetings"), one.alias("item_windows"), F.lit(False).alias("altered"))


def leaks(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per text (key and print) and item: meetings (the most of a placement) and its item_windows, and altered (in all
    placements; a part word for word shows no slots, so it has no say beside a template's placement)."""
    key, item = names.get("key", "doc_id"), names.get("item", "item_id")
    most = F.max(F.struct("meetings", "item_windows"))
    sees = F.when((F.col("kind") < 2) | (F.col("meetings") == F.col("item_windows")), F.col("altered"))
    made = find(docs, benchmark, **names).groupBy(key, "print", item).agg(most.alias("__most"), F.coalesce(F.min(sees), F.lit(False)).alias("altered"))
    return made.select(key, "print", item, "__most.meetings", "__most.item_windows", "altered")


def remove(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """docs without those that hold a benchmark item."""
    key, text = names.get("key", "doc_id"), names.get("text", "text")
    return common.matching(docs, leaks(docs, benchmark, **names).select(key, "print"), "left_anti", key=key, text=text)
