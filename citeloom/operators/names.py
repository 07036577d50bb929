"""Names against a list of names by a weighted ratio that knows reordered, contained and misspelt names.

The score, from 0 to 100, is the best of: the ratio of both names; for names of similar length, nine
and a half tenths of the ratio of their sorted words, or of the words beside those that both have; for names of which one is half as
long again or more, nine (beyond eight times the length, six) tenths of the best ratio of the shorter with any part
of the longer, and the same of their words. The ratio is 200 times the longest common subsequence by
both lengths. Each distinct name is scored once in a task; names that share no word, have too few letters in common and don't
contain each other can't reach 90 and aren't scored for such a threshold.

Defined results: null and empty names have no match; of equal scores the first choice is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What sorted words, and parts of names, count.
WORDS, PART, SMALL_PART, LONGER, MUCH_LONGER = 0.95, 0.9, 0.6, 1.5, 8.0


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by the bits of one number for each letter of the shorter."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & at.get(ch, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def part_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a part of the longer that is as long, or shorter at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    parts = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
    best = max(ratio(a, p) for p in parts)
    if len(a) == len(b):
        best = max(best, max(ratio(b, a[max(0, i) : i + len(b)]) for i in range(1 - len(b), len(a))))
    return best


def _beside(a: str, b: str) -> tuple[str, str, str]:
    """The distinct words that both have, that only a has and that only b has, sorted."""
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def word_ratio(a: str, b: str) -> float:
    """The best of the ratio of all words, sorted, and of those that both have with either's others added."""
    both, one, two = _beside(a, b)
    if both and not (one and two):
        return 100.0
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    gap = 1 if both else 0
    n, m = len(both) + gap + len(one), len(both) + gap + len(two)
    apart = len(one) + len(two) - 2 * common(one, two)
    best = max(best, 100.0 - 100.0 * apart / (n + m) if n + m else 100.0)
    if both:
        best = max(best, 100.0 - 100.0 * (gap + len(one)) / (len(both) + n), 100.0 - 100.0 * (gap + len(two)) / (len(both) + m))
    return best


def part_word_ratio(a: str, b: str) -> float:
    both, one, two = _beside(a, b)
    if both:
        return 100.0
    return max(part_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), part_ratio(one, two))


def weighted(a: str, b: str) -> float:
    """The score of two names."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < LONGER:
        return max(ratio(a, b), WORDS * word_ratio(a, b))
    scale = PART if times <= MUCH_LONGER else SMALL_PART
    return max(ratio(a, b), scale * part_ratio(a, b), scale * WORDS * part_word_ratio(a, b))


def possible(a: str, b: str, letters: tuple[Counter, Counter], least: float) -> bool:
    """False only where the score can't reach least."""
    if least < 90:
        return True
    return a in b or b in a or (letters[0] & letters[1]).total() >= 0.85 * min(len(a), len(b)) or not set(a.split()).isdisjoint(b.split())


def best(name: str, choices: list[tuple[str, str, Counter]], least: float) -> str | None:
    """Of choices (name, the same in lower case, its letters) the first with the highest score."""
    own, found, top = Counter(name), None, least
    for choice, plain, letters in choices:
        if possible(name, plain, (own, letters), least):
            score = weighted(name, plain)
            if score > top or score == top and found is None:
                found, top = choice, score
    return found


def nearest(name: Column, choices: list[str], least: float = 90.0) -> Column:
    """The choice with the highest score for a cleaned (lower-case) name, if it is at least least; the list of choices is a parameter."""
    known = [(c, c.lower(), Counter(c.lower())) for c in choices]

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, str | None] = {}
        for batch in batches:
            if len(memo) > 1 << 20:
                memo.clear()
            for x in batch.dropna().unique():
                if x not in memo:
                    memo[x] = best(x, known, least) if x else None
            yield batch.map(lambda x: memo.get(x) if x is not None else None).astype(object)

    return run(name) if choices else F.lit(None).cast("string")
