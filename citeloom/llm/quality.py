"""Quality rules and robust multivariate outliers.

Each text has counts of words, symbols, repeated lines and repeated word windows. Texts that pass
the fixed rules give a vector of transformed statistics. For each language and source a
minimum-covariance-determinant estimate is fitted by concentration steps over all of its vectors from
two starts (medians with quartiles, and moments): two steps each, then the one with the smaller determinant goes on until that
falls no more. A vector beyond a Mahalanobis distance from it is rejected. Small groups share their
language's estimate, and small languages that of all texts.

Vectors are whole numbers (thousandths), so that sums do not depend on how rows are dealt, and
quantiles are exact over a bounded number of values.

Defined results: a null text counts as empty and fails the rules; null languages and sources are
groups of their own; ties at the edge of the half set stay in; repeated rows are judged alike;
other columns are passed through. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from citeloom.llm.common import materialise

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
#: A group with fewer vectors shares the next larger group's estimate.
LEAST = 200
#: Share of a group's vectors that the estimate is made from and its consistency factor for five dimensions.
HALF, CONSISTENT = 0.75, 1.41
#: Steps from each start, and the most steps from the better one, which ends once half the logarithm of its determinant falls by no more than FALL.
FIRST, STEPS, FALL = 2, 50, 0.0005
#: Distances fall into steps of half a hundredth, so that a group has few distinct values.
BINS = 200
#: Groups up to which their estimates are broadcast (some 20 MB).
BROADCAST_ROWS = 100_000
#: Squared distance beyond which a vector is rejected: the chi-square quantile of five dimensions that one in a million exceeds.
CUT = 35.89
#: The vector's entries and the least standard deviation that an entry is given, in thousandths: the grain of
#: rounding. Most texts repeat nothing, so v3 and v4 have the grain of their counts (a window or line in some 260 words).
ENTRIES = {"v0": 1, "v1": 1, "v2": 1, "v3": 20, "v4": 4}
CELLS = [f"m{i}" for i in range(len(ENTRIES))] + [f"l{i}{j}" for i in range(len(ENTRIES)) for j in range(i + 1)]


def measure(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.trim(t, F.lit(SPACE))
    df = docs.select(*cols, t.alias("t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(*cols, F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
                   F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"), F.regexp_count("t", F.lit("[A-Z]")).cast("bigint").alias("n_upper"), lines.alias("lines"),
                   F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    size = F.size("h")
    pick = lambda i: [F.get("h", i + k) for k in range(WINDOW)]
    df = df.select(*cols, "n_words", "word_chars", "n_symbols", "n_upper", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                   F.when(size >= WINDOW, F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*pick(i)))).otherwise(F.array().cast("array<bigint>")).alias("h"))
    # Most texts repeat no window; for the others, equal windows become neighbours.
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.arrays_zip(F.col("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("i")))))
    h = lambda k: F.get("s", k)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False)))
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(again, lambda k: F.get("s", k)["i"]))))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(*cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("p").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"), "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    share = lambda a, b: F.round(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("bigint")
    return {"v0": F.round(1000 * F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))).cast("bigint"), "v1": share("n_symbols", "word_chars"), "v2": share("n_upper", "word_chars"),
            "v3": share("n_repeat_words", "n_words"), "v4": share("n_dup_lines", "n_words")}


def _factor(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m0.. (location), l00.. (Cholesky factor of the scatter) and size (half the logarithm of its
    determinant) of counts n, sums s0.. and products q00.. of vectors."""
    p, floor = len(ENTRIES), list(ENTRIES.values())
    mean = [F.col(f"s{i}") / F.col("n") for i in range(p)]
    df = sums.select(*keys, *[mean[i].alias(f"m{i}") for i in range(p)], *[(CONSISTENT * (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j])).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])
    for j in range(p):
        less = lambda i: reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.greatest(F.col(f"c{i}{j}"), F.lit(float(floor[i] ** 2))) if i == j else F.col(f"c{i}{j}"))  # noqa: E731, B023
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(less(j), F.lit(1.0))))
        if j + 1 < p:
            df = df.withColumns({f"l{i}{j}": less(i) / F.col(f"l{j}{j}") for i in range(j + 1, p)})
    size = reduce(lambda a, x: a + x, [F.log(F.col(f"l{i}{i}")) for i in range(p)])
    return df.select(*keys, *CELLS, size.alias("size"))


def _sums() -> list[Column]:
    """n, s0.. and q00.. of a group's vectors, each of which stands ``times`` times."""
    names, n = list(ENTRIES), F.col("times")
    return [F.sum(n).alias("n"), *[F.sum(n * F.col(v)).alias(f"s{i}") for i, v in enumerate(names)], *[F.sum(n * F.col(names[i]) * F.col(names[j])).alias(f"q{i}{j}") for i in range(len(names)) for j in range(i + 1)]]


def _distance(p: int) -> Column:
    """The squared Mahalanobis distance, by forward substitution (bound names keep it short)."""
    z: list[Column] = []
    for i in range(p):
        z.append(reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * z[k] for k in range(i)], F.col(f"v{i}") - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast where it has few rows; beyond, joins shuffle and AQE splits hot keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _concentrate(rows: DataFrame, model: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """One step: the estimate from the share HALF of each group's vectors that are nearest to the model.

    Sums are made for each step of distance before anything of a group meets, so a group of any size
    sends some thousand rows at most from each task."""
    far = rows.join(_few(model.select(*keys, *CELLS), groups), keys[0]).select(*keys, *ENTRIES, "times", F.round(BINS * F.log1p(_distance(len(ENTRIES)))).cast("bigint").alias("bin"))
    parts = far.groupBy(*keys, "bin").agg(*_sums())
    by = Window.partitionBy(*keys)
    # The edge is the step that holds the HALF quantile; ties with it stay in.
    parts = parts.withColumns({"before": F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(by)})
    inner = parts.where(F.col("before") <= F.floor(HALF * (F.col("all") - 1)))
    return _factor(inner.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (*keys, "bin", "before", "all")]), keys)


def estimate(rows: DataFrame, group: str) -> DataFrame:
    """group, m0.. (location) and l00.. (Cholesky factor of the scatter) of each group's vectors.

    Each group starts from its medians and quartiles and from its moments. After FIRST steps the
    start with the smaller determinant goes on, until its determinant falls no more."""
    names, p = list(ENTRIES), len(ENTRIES)
    floor = list(ENTRIES.values())
    # Vectors are whole numbers, and many texts have the same: each distinct one is a row with how often it stands.
    rows = materialise(rows.groupBy(group, *names).agg(F.count("*").alias("times")), "vectors")
    every = materialise(rows.groupBy(group).agg(*[F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.col("times")).alias(f"p{i}") for i, v in enumerate(names)], *_sums()), "moments")
    groups = every.count()
    spread = lambda i: F.greatest((F.get(f"p{i}", 2) - F.get(f"p{i}", 0)) / 1.349, F.lit(float(floor[i])))
    middle = every.select(group, F.lit(0).alias("start"), *[F.get(f"p{i}", 1).alias(f"m{i}") for i in range(p)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)])
    model = middle.unionByName(_factor(every, [group]).withColumn("start", F.lit(1)).drop("size"))
    for _ in range(FIRST):
        model = materialise(_concentrate(rows, model, [group, "start"], groups), "scatter")
    # Sums are of whole numbers, so rounding hides only the order of additions of logarithms.
    best = model.groupBy(group).agg(F.min_by(F.struct(*CELLS, "size"), F.struct(F.round("size", 9), "start")).alias("b"))
    model = materialise(best.select(group, "b.*", F.lit(True).alias("moved")), "scatter")
    for _ in range(STEPS):
        after = _concentrate(rows, model.where("moved"), [group], groups)
        after = after.select(group, F.struct(*CELLS, "size").alias("a"))
        falls = F.coalesce(F.col("a.size") < F.col("size") - FALL, F.lit(False))
        model = model.join(_few(after, groups), group, "left").select(group, *[F.when(falls, F.col(f"a.{c}")).otherwise(F.col(c)).alias(c) for c in (*CELLS, "size")], falls.alias("moved"))
        seen = Observation()
        model = materialise(model.observe(seen, F.count_if("moved").alias("moved")), "scatter")
        if not seen.get["moved"]:
            break
    return model.select(group, *CELLS)


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with the counts, base_failed, distance (squared; null where the rules fail) and kept."""
    own = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "distance", "kept")]
    none = F.lit("\x00")
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), none)
    own = [c for c in own if c != text]
    # In a struct, columns of any names can't clash with those made here.
    packed = docs.select(F.struct(F.lit(0).alias("__zero"), *[F.col(f"`{c}`") for c in own]).alias("__own"), name(lang).alias("__l"), F.concat_ws("\x01", name(lang), name(source)).alias("__ls"), F.col(f"`{text}`").alias("__text"))
    rows = measure(packed, text="__text", keep=["__own", "__l", "__ls"]).withColumns({"base_failed": base_failed(), **_vector()})
    rows = materialise(rows, "quality")
    good = rows.where(~F.col("base_failed"))
    wide = good.groupBy("__ls", "__l").count()
    by_lang = wide.groupBy("__l").agg(F.sum("count").alias("of_lang"))
    groups = wide.join(by_lang, "__l").select("__ls", F.when(F.col("count") >= LEAST, F.col("__ls")).when(F.col("of_lang") >= LEAST, F.concat(F.lit("\x02"), "__l")).otherwise(F.lit("\x03")).alias("__g"))
    groups = materialise(groups, "groups")
    pairs = groups.count()
    vectors = good.select("__ls", "__l", *ENTRIES)
    direct = vectors.join(_few(groups, pairs), "__ls")
    # A shared estimate is made from all vectors of the language, or of all texts.
    shared = vectors.join(_few(groups.where(F.col("__g").startswith("\x02")).select("__g").distinct(), pairs), F.concat(F.lit("\x02"), "__l") == F.col("__g"))
    all_rows = vectors.crossJoin(groups.where(F.col("__g") == "\x03").select("__g").distinct())  # one row or none beside each
    vectors = direct.where(~F.col("__g").rlike("^[\\x02\\x03]")).select("__g", *ENTRIES).unionByName(shared.select("__g", *ENTRIES)).unionByName(all_rows.select("__g", *ENTRIES))
    model = estimate(vectors, "__g")
    placed = rows.join(_few(groups.join(model, "__g"), pairs), "__ls", "left")
    distance = F.when(~F.col("base_failed"), _distance(len(ENTRIES)))
    return placed.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)).select(*[F.col(f"__own.`{c}`") for c in own], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
