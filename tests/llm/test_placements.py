"""Benchmark decontamination against plain templates and placements, and its recall by the length of an item."""

import re

import pytest
from pyspark.sql import functions as F

from citeloom.llm import common, decontaminate as D

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain_templates(t, kind):
    """(template, value or None) of each token; kind 1 takes runs of names and of number words as one, kind 2 knows no slots."""
    out, before = [], None
    for m in TOKEN.finditer(t):
        w, word = m[0], lower(m[0])
        gap = t[before.end() : m.start()] if before else ""
        begins = before is None or re.search(r"[.!?\n:]", gap) is not None
        digit = w[0].isascii() and w[0].isdigit()
        number = digit or word in D.NUMBERS
        name = not begins and not number and ("A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ")
        last = out[-1] if out else None
        unit = not number and not name and last is not None and last["number"] and word in D.UNITS
        joint = digit and last is not None and last["digit"] and gap in (",", ".")
        if kind == 1 and last is not None and gap in (" ", "-"):
            joint = joint or number and not digit and last["number"] and not last["digit"] or name and last["name"]
        now = {"digit": digit, "number": number, "name": name, "slot": "#" if number else "N" if name else "U" if unit else None, "value": word}
        if joint:
            now["value"] = (last["value"], word)
            out.pop()
        out.append(now)
        before = m
    if kind == 2:
        return [(lower(m[0]), None) for m in TOKEN.finditer(t)]
    return [(x["slot"] or x["value"], x["value"] if x["slot"] else None) for x in out]


def plain_windows(tokens, n, least):
    return {i: tuple(t for t, _ in tokens[i : i + n]) for i in range(len(tokens) - n + 1) if sum(v is None for _, v in tokens[i : i + n]) >= least}


def plain_placements(docs, items):
    found = set()
    for kind in range(3):
        made = {k: plain_templates(t, kind) for k, t in docs}
        for item, t in items:
            own = plain_templates(t, kind)
            n = D.WINDOW if len(own) >= D.WINDOW else len(own)
            if n < D.SHORTEST:
                continue
            windows = plain_windows(own, n, 0 if kind == 2 else min(D.LITERALS, n - 1))
            for k, tokens in made.items():
                places: dict = {}
                for j, w in plain_windows(tokens, n, 0 if kind == 2 else min(D.LITERALS, n - 1)).items():
                    for i, x in windows.items():
                        if w == x:
                            places.setdefault(j - i, []).append((i, [(own[i + s][1], tokens[j + s][1]) for s in range(n) if own[i + s][1] is not None]))
                for at, met in places.items():
                    pairs = {p for _, ps in met for p in ps}
                    if len(met) >= min(D.MEETINGS, len(windows)) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                        found.add((k, item, kind, at, len(met), len(windows), any(a != b for a, b in pairs)))
    return found


PLANTED = [
    "John has 3 apples and gives twenty five of them to Mary Ann before he walks 10 km home.",
    "What is 1,000 plus 2.5 when nothing else is known about the sum of both",
    "A train leaves at 9 and drives 60 miles in 2 hours until it stops",
    "How many days are there",
]
ASKED = [
    "Here: Paul has 7 apples and gives forty one of them to Sue Lee before he walks 10 km home. More text.",
    "Paul has 7 apples and gives 7 of them to Paul before he walks 7 km home.",
    "so what is 20 plus 7.25 when nothing else is known about the sum of both, they ask",
    "what is 5 plus 5 when nothing else is known about the sum of both",
    "A TRAIN leaves at 9 and drives 60 miles in 2 hours until it stops! A train leaves at 4 and drives 6 miles in 4 hours until it stops",
    "tell me how many days are there in May",
    "",
]


def test_placements_are_those_of_plain_windows(spark):
    docs = [(r.doc_id, r.text or "") for r in common.table(spark, SF, "documents").collect() if len(r.text or "") < 4000][:120] + [(1000 + i, t) for i, t in enumerate(ASKED)]
    items = [(r.item_id, r.text or "") for r in common.table(spark, SF, "benchmark").collect()] + [(500 + i, t) for i, t in enumerate(PLANTED)]
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("kind < 3")
    rows = {(r.doc_id, r.item_id, r.kind, r["at"], r.meetings, r.item_windows, r.altered) for r in got.collect()}
    want = plain_placements(docs, items)
    assert rows == want and {(k, i) for k, i, *_ in want if k >= 1000} >= {(1000, 500), (1002, 501), (1004, 502), (1005, 503)} and any(x[-1] for x in want)


@pytest.mark.parametrize("asked_again", [False, True])
def test_recall_by_length_of_items(spark, asked_again):
    """Items of n words are found inside a sentence from four tokens on; with other numbers, where enough words stay."""
    words = "when does the blue river cross that old stone bridge near our village again".split()
    items, docs = [], []
    for n in range(1, 14):
        own = [*words[:n]]
        if n > 3:
            own[2] = "12"
        items.append((n, " ".join(own)))
        told = [("95" if asked_again and w == "12" else w) for w in own]
        docs += [(n, "they wondered for long: " + " ".join(told) + " and then went home, all of them"), (100 + n, "first line\n" + " ".join(told) + "\nlast line")]
    schema = "text string"
    found = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, f"doc_id long, {schema}"), spark.createDataFrame(items, f"item_id long, {schema}")).collect()}
    inside = [n for n in range(1, 14) if (n, n) in found]
    lines = [n for n in range(1, 14) if (100 + n, n) in found]
    # four to seven tokens are one window of all but one literal at least
    assert inside == list(range(4, 14)) and lines == list(range(1, 14))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, PLANTED[0], 5, "a", 1, [1])], "doc_id long, text string, at int, print string, w int, slots array<int>")
    items = spark.createDataFrame([(9, PLANTED[0], 5, 6)], "item_id long, text string, at int, kind int")
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()] == [(1, 9)]
    assert D.remove(docs, items).count() == 0 and D.remove(docs, items.where("false")).columns == docs.columns and D.leaks(docs.where("false"), items).where(F.lit(True)).count() == 0
