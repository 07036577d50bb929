"""Phrase collocation mining with merged count-min sketches and an exact second pass.

First pass: every task counts the n-grams it meets in a count-min sketch; the tasks' sketches are
added up. Counters stop at ``least`` or above, so a byte is enough for usual thresholds. A sketch
never underestimates, so every n-gram with ``least`` occurrences passes it. Second pass: only
n-grams that pass (and whose parts pass) are counted exactly, as strings, summed by Spark, and
those below ``least`` go. A phrase's parts are at least as frequent as the phrase, so they are among
the survivors. Scores compare the phrase with the parts of its weakest cut; a phrase that a longer
candidate mostly accounts for is dropped.

The sketch has a fixed size; which of its counters reach ``least`` is gathered by the driver and sent out, a bit for each. Where a corpus overfills it,
more n-grams pass to the exact count, which stays right and gets more rows to shuffle.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count
each; texts of any length are worked through piece by piece (a piece itself is held whole); an empty table gives no rows;
ties are broken by count and then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common

#: Rows of the sketch, counters in a row, and counters that are sent and added up together.
ROWS, WIDTH, CHUNK = 2, 1 << 25, 1 << 17
#: Bytes that end a piece, and those that end a word.
ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
GAPS = ENDS | np.isin(np.arange(256), list(b" \t"))
#: Exact counts that a task holds before it hands them over.
HELD = 1 << 18
#: Partitions of the input that a task takes on, where there are enough: n-grams repeat, so larger parts hand over less.
MERGED = 4
#: Parts that hold more than one in so many of all words are joined by broadcast: there are at most that many of each size.
HOT = 50_000
#: Salts of the second of three rounds that find each language's first phrases.
SALTS = 16


def _grams(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Part by part of all texts: (language of each word, languages, distinct words, word at each place, and for each size of n-gram
    (where it begins, a hash of language and words))."""
    for batch in common.small_batches(batches):
        raw, off = common.text_bytes(batch.column("text"))
        raw = common.LOWER[raw]
        langs = batch.column("lang").fill_null("und").dictionary_encode()
        of_text = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang_hash = _hashes(langs.dictionary)
        for a, b in common._pieces(raw, off, ENDS):
            part = raw[a:b]
            word = ~GAPS[part]
            fresh = np.zeros(b - a + 1, bool)
            fresh[off[np.searchsorted(off, a, "left") : np.searchsorted(off, b, "right")] - a] = True
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1] | fresh[1:-1]
            last[:-1] &= ~word[1:] | fresh[1:-1]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            if not len(start):
                continue
            piece = (np.cumsum(ENDS[part]) + np.cumsum(fresh[:-1]))[start]
            lang = of_text[np.searchsorted(off, start + a, "right") - 1]
            words = common.cut_out(part, start, end).dictionary_encode()
            at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            h = _hashes(words.dictionary)[at]
            begins, sizes, g = np.arange(len(at)), [], lang_hash[lang]
            for k in range(most):
                m = len(at) - k
                if m <= 0:
                    break
                inside = begins[(begins < m)]
                inside = inside[piece[inside] == piece[inside + k]]
                g, begins = common._mix(g[np.searchsorted(begins, inside)] * np.uint64(0x9FB21C651E98DF25) + h[inside + k]), inside
                sizes.append((begins, g))
            yield lang, langs.dictionary, words.dictionary, at, sizes


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    raw, off = common.text_bytes(strings)
    power, inverse = common._powers(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(common._RANDOM[raw] * power[: len(raw)], dtype=np.uint64)])
    return common._mix((total[off[1:]] - total[off[:-1]]) * inverse[off[:-1]] + np.diff(off).astype(np.uint64))


def _cells(g: np.ndarray) -> list[np.ndarray]:
    """The counter of each hash in each row."""
    return [((common._mix(g + np.uint64(r)) if r else g) & np.uint64(WIDTH - 1)).astype(np.int64) + r * WIDTH for r in range(ROWS)]


def _sums(least: int) -> np.dtype:
    """Counters hold least at any rate."""
    return np.dtype(np.uint8 if least < 256 else np.uint16 if least < 1 << 16 else np.uint32)


def _put(sketch: np.ndarray, cells: np.ndarray) -> None:
    """Counts the cells, up to what a counter holds."""
    order = np.sort(cells)
    first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    on, n = order[first], np.diff(np.append(first, len(order)))
    sketch[on] = np.minimum(sketch[on] + n, np.iinfo(sketch.dtype).max).astype(sketch.dtype)


def sketch(texts: DataFrame, most: int, least: int) -> np.ndarray:
    """Of the merged sketch of n-grams of 1 to most words of texts (lang, text), which counters reach least: a bit for each."""
    import zstandard

    kind = _sums(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = np.zeros(ROWS * WIDTH, kind), False
        for *_, sizes in _grams(batches, most):
            cells = _cells(np.concatenate([g for _, g in sizes]))
            for x in cells:
                _put(own, x)
            some = True
        if some:
            pack = zstandard.ZstdCompressor(level=1)
            for k, x in enumerate(own.reshape(-1, CHUNK)):
                if x.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "data": pa.array([pack.compress(x.tobytes())], pa.binary())})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(CHUNK, np.int64), None
        unpack = zstandard.ZstdDecompressor()
        for part in parts:
            for x in part.column("data"):
                total += np.frombuffer(unpack.decompress(x.as_py()), kind)
            chunk = part.column("chunk")[0].as_py()
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "data": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((ROWS * WIDTH // CHUNK, CHUNK // 8), np.uint8)
    for r in texts.mapInArrow(count, "chunk int, data binary").groupBy("chunk").applyInArrow(add, "chunk int, data binary").toLocalIterator():  # a fixed number of chunks
        out[r["chunk"]] = np.frombuffer(bytes(r["data"]), np.uint8)
    return out.ravel()


def frequent(texts: DataFrame, most: int, least: int) -> DataFrame:
    """lang, phrase, f and size of the n-grams with f >= least, exactly; size 0 has each language's number of words."""
    sent = texts.sparkSession.sparkContext.broadcast(sketch(texts, most, least))
    names = ["lang", "phrase", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        reached = sent.value

        def hand_over() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(held).group_by(names[:2]).aggregate([("f", "sum")]).rename_columns(names)
            held.clear()
            yield from whole.to_batches(max_chunksize=1 << 16)

        for lang, langs, words, at, sizes in _grams(batches, most):
            counts = np.bincount(lang, minlength=len(langs))
            on = np.flatnonzero(counts)
            held.append(pa.table([langs.take(pa.array(on)).cast(pa.large_string()), pa.array([""] * len(on), pa.large_string()), pa.array(counts[on])], names=names))
            passed = np.ones(len(at) + 1, bool)
            for k, (begins, g) in enumerate(sizes):
                keep = passed[begins] & (passed[begins + 1] if k else True)  # both of its parts of one word less
                for x in _cells(g):
                    on = x[keep]
                    keep[keep] = (reached[on >> 3] >> (on & 7).astype(np.uint8)) & 1 > 0
                passed = np.zeros(len(at) + 1, bool)
                begins = begins[keep]
                passed[begins] = True
                if not len(begins):
                    break
                # Exact numbers of distinct n-grams: of language and first word, then of that and the next word.
                number = lang[begins] * len(words) + at[begins]
                for j in range(1, k + 1):
                    number = np.unique(number, return_inverse=True)[1] * len(words) + at[begins + j]
                _, one, n = np.unique(number, return_index=True, return_counts=True)
                one = begins[one]
                spelt = [words.take(pa.array(at[one + j])) for j in range(k + 1)]
                phrase = pc.binary_join_element_wise(*spelt, pa.scalar(" ", pa.large_string())) if k else spelt[0]
                held.append(pa.table([langs.take(pa.array(lang[one])).cast(pa.large_string()), phrase.cast(pa.large_string()), pa.array(n)], names=names))
            if sum(map(len, held)) > HELD:
                yield from hand_over()
        if held:
            yield from hand_over()

    rows = texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return rows.where((F.col("f") >= least) | (F.col("phrase") == "")).withColumn("size", F.when(F.col("phrase") != "", F.size(F.split("phrase", " "))).otherwise(0))


def _part(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first top rows with their rank: first of each task, then of each salt, then of all."""
    names = ["lang", "score", "a", "phrase"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut() -> pa.Table:
            t = pa.Table.from_batches(held)
            # bytes of UTF-8 sort as binary
            t = t.append_column("__bytes", t.column("phrase").cast(pa.binary()))
            t = t.take(pc.sort_indices(t, [("lang", "ascending"), ("score", "descending"), ("a", "descending"), ("__bytes", "ascending")])).drop_columns(["__bytes"]).combine_chunks()
            lang = t.column("lang").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, int)
            start = np.searchsorted(lang, lang, "left") if len(lang) else lang
            return t.filter(pa.array(np.arange(len(lang)) - start < top))

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > max(1 << 17, 16 * top):
                held[:] = cut().to_batches()
        if held:
            yield from cut().to_batches()

    few = rows.select(*names, "l", "r").mapInArrow(best, "lang string, score bigint, a bigint, phrase string, l bigint, r bigint")
    few = few.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.expr("row_number() OVER (PARTITION BY lang, salt ORDER BY score DESC, a DESC, phrase)")).where(F.col("place") <= top).drop("place", "salt")
    return few.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)").cast("bigint")).where(F.col("rank") <= top)


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", most: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases of 2 to most words."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    texts = texts.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // MERGED))
    counts = common.materialise(frequent(texts, most, least), "frequent")
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    grams = counts.where("size > 0")
    phrases = grams.where("size > 1")
    # Each cut of each phrase: the part before it (side 0) and after it (side 1).
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), k)
    sides = cuts.select("lang", "phrase", "a", "cut", F.posexplode(F.array(_part(F.col("phrase"), F.lit(1), F.col("cut")), _part(F.col("phrase"), F.col("cut") + 1, F.col("size") - F.col("cut")))).alias("side", "part"))
    both = common.join_by_share(sides, grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n")), ["lang", "part"], "n", total, HOT).groupBy("lang", "phrase", "a", "cut").agg(F.max(F.expr("if(side = 0, n, null)")).alias("l"), F.max(F.expr("if(side = 1, n, null)")).alias("r"))
    wide = "cast(a AS decimal(19, 0))"
    scored = both.withColumn("score", F.expr(f"(cast(1000000 AS decimal(7, 0)) * ({wide} * {wide})) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.score", "w.l", "w.r")
    # Parts of two words and more of longer phrases, with the count of the most frequent of these.
    inner = phrases.where("size > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    return _first(kept, top).join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
