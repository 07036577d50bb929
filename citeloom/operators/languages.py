"""Language detection by profiles of letter trigrams, and Porter's stemmer.

A profile has the probabilities of the ``GRAMS`` commonest trigrams of all labelled texts in each language, with one
added to every count; what lies beyond them shares one entry. A text is in the language that gives
its trigrams the highest probability; it is in none if its mean log-probability there lies further below that
language's own texts than ``WIDE`` standard deviations.

Defined results: null texts and those without letters have language ''; of languages that are as likely the first by
name is taken; texts of any length are read whole; an empty table of labelled texts knows no language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.batches import cuts, small
from citeloom.operators.scratch import cut_lineage

#: Trigrams of a profile; standard deviations below the mean that are still the language.
GRAMS, WIDE = 10_000, 6.0
#: Code points need 21 bits.
_BITS = 21


def letters(text: Column) -> Column:
    """Lower-case letters with one space around each run of them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+", " ")), F.lit(" "))


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts as numbers, and the text of each. Texts of fewer than three letters and spaces have none."""
    points, size = [], []
    for t in texts.to_pylist():
        p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        points.append(p)
        size.append(len(p))
    size = np.array(size, np.int64)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.concatenate(points).astype(np.int64)
    of = np.repeat(np.arange(len(size)), size)
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = of[:-2] == of[2:]
    return ((p[:-2] << 2 * _BITS) + (p[1:-1] << _BITS) + p[2:])[whole], of[:-2][whole]


@dataclass(frozen=True)
class Profiles:
    """langs by name; grams in order; logs: for each gram and, last, for any other, its log-probability in each language; floor: the least mean."""

    langs: list[str]
    grams: np.ndarray
    logs: np.ndarray
    floor: np.ndarray

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean log-probability in each language, and its number of trigrams."""
        g, of = _trigrams(texts)
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        entry = np.where(self.grams[at] == g, at, len(self.grams)) if len(self.grams) else np.zeros(len(g), np.int64)
        n = np.bincount(of, minlength=len(texts))
        total = np.stack([np.bincount(of, self.logs[entry, j], minlength=len(texts)) for j in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return total / np.maximum(n, 1)[:, None], n


#: Counts of trigrams that a task keeps before it adds up those of the same trigram, and before it hands them on.
HELD = 1 << 20


def _counts(labelled: DataFrame) -> DataFrame:
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n)], names=["lang", "gram", "n"])

        for batch in small(batches, "letters"):
            g, of = _trigrams(batch.column("letters"))
            langs = pc.dictionary_encode(batch.column("lang"))
            code = langs.indices.to_numpy()[of]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                grams, n = np.unique(g[code == k], return_counts=True)
                held.setdefault(lang, []).append((grams, n))
                size += len(grams)
            if size > HELD:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    return labelled.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all labelled texts. GRAMS trigrams in each language come to the driver, whatever the input."""
    told = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters(F.col(text)).alias("letters"))
    counts = cut_lineage(_counts(told), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    common = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(GRAMS).select("gram")
    langs = sorted(totals)
    at = {x: j for j, x in enumerate(langs)}
    found = counts.join(F.broadcast(common), "gram").collect()
    grams = np.unique(np.array([r.gram for r in found], np.int64))
    n = np.zeros((len(grams) + 1, len(langs)))
    for r in found:
        n[np.searchsorted(grams, r.gram), at[r.lang]] = r.n
    all_ = np.array([totals[x] for x in langs], float)
    n[-1] = all_ - n[:-1].sum(0)
    logs = np.log((n + 1) / (all_ + len(grams) + 1)) if langs else np.zeros((1, 0))
    plain = Profiles(langs, grams, logs, np.full(len(langs), -np.inf))
    own = _scored(told, plain).where("n > 0").groupBy("lang").agg(F.avg("own").alias("mean"), F.stddev_pop("own").alias("wide")).collect()
    floor = np.full(len(langs), -np.inf)
    for r in own:
        floor[at[r.lang]] = r["mean"] - WIDE * max(r.wide, 1e-9)
    return Profiles(langs, grams, logs, floor)


def _scored(told: DataFrame, profiles: Profiles) -> DataFrame:
    """lang, own (the mean log-probability in it) and n of labelled texts."""
    at = {x: j for j, x in enumerate(profiles.langs)}
    sent = told.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "letters"):
            if batch.num_rows:
                means, n = sent.value.means(batch.column("letters"))
                where = np.array([at[x] for x in batch.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(means[np.arange(len(n)), where]), pa.array(n)], names=["lang", "own", "n"])

    return told.mapInArrow(run, "lang string, own double, n bigint")


def detect(text: Column, profiles: Profiles, docs: DataFrame) -> Column:
    """The language of a column of docs; '' for none."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        known, out = sent.value, []
        for a, b in cuts(texts):  # what trigrams take follows the letters of a piece, not those of a batch
            if not known.langs:
                out += [""] * (b - a)
                continue
            means, n = known.means(texts.slice(a, b - a))
            best = means.argmax(1)
            sure = (n > 0) & (means[np.arange(len(n)), best] >= known.floor[best])
            out += np.where(sure, np.array(known.langs, object)[best], "").tolist()
        return pa.array(out, pa.string())

    return run(letters(text))


# --- Porter's stemmer ----------------------------------------------------------------------------

# Endings and what they become, in the order in which they are tried; words with a stem of their own.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
OWN = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _shape(word: str) -> str:
    """c for a consonant, v for a vowel; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends like 'hop', or is like 'at'."""
    s = _shape(word)
    return s[-3:] == "cvc" and word[-1] not in "wxy" or s == "vc"


def stem(word: str) -> str:
    """Porter's stem of a lower-case word, with the additions that are in common use (words of their own, y after a vowel, fulli, logi)."""
    if word in OWN:
        return OWN[word]
    if len(word) <= 2:
        return word
    w = word
    # plurals
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and progressive
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif _doubled(cut):
                w = cut if cut[-1] in "lsz" else cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    # suffixes one after another
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    w = _replaced(w, STEP2)
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        w = w[:-1]
    w = _replaced(w, STEP3)
    end = next((e for e in STEP4 if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _replaced(word: str, endings: list[tuple[str, str]]) -> str:
    """The first ending that fits gives way, if what stands before it has a measure."""
    for end, by in endings:
        if word.endswith(end):
            return word[: -len(end)] + by if _measure(word[: -len(end)]) > 0 else word
    return word


#: Distinct words whose stems a task keeps.
STEMS = 1 << 17


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stem of each word; a task works out each distinct word once, of those it has met lately."""
    known: dict[str | None, str | None] = {None: None}
    for lists in words:
        pieces = []
        for a, b in cuts(lists):
            piece = lists.slice(a, b - a)
            coded = pc.dictionary_encode(piece.flatten())
            if len(known) > STEMS:
                known = {None: None}
            own = []
            for w in coded.dictionary.to_pylist():
                if w not in known:
                    known[w] = stem(w)
                own.append(known[w])
            n = pc.list_value_length(piece)
            ends = pa.array(np.append(0, np.cumsum(pc.fill_null(n, 0).to_numpy())), pa.int32())
            pieces.append(pa.ListArray.from_arrays(ends, pa.array(own, pa.string()).take(coded.indices), mask=n.is_null()))
        yield pa.concat_arrays(pieces) if pieces else lists
