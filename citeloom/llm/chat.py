"""Chat formatting with a grammar round trip.

Turns are rendered between marks; the result is parsed again by a deterministic grammar and the
recovered turns are compared with the source. Where they differ, texts that hold control strings are
escaped by one more rule until they are identical:

level 0: texts as they are; level 1: a backslash goes after the first character of what looks like a
control string (escaped ones get one more); level 2: after every ``<`` and ``[``, which a header tells.

Defined results: null text and null role count as empty; turns are ordered by turn (null first),
then role, then text; repeated rows are turns of their own; a conversation is formatted whole,
whatever its length; other columns are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("<<ROLE ", ">>\n", "\n<</ROLE>>\n")
HEADER = "<<ESC>>\n"
_CONTROL = "(/?s>|</?SYS>>|</?ROLE|<ESC>>|/?INST\\])"
_TURN = "(?s)<<SYS>>\\n.*?\\n<</SYS>>\\n|<s>\\[INST\\] .*? \\[/INST\\]|<s> .*? </s>|<<ROLE [0-9A-F]*>>\\n.*?\\n<</ROLE>>\\n"


def _escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        return F.regexp_replace(text, "([<\\[])(\\\\*)" + _CONTROL, "$1\\\\$2$3")
    return F.regexp_replace(text, "([<\\[])", "$1\\\\")


def _unescape(text: Column, level: Column) -> Column:
    return F.when(level == 2, F.regexp_replace(text, "([<\\[])\\\\", "$1")).otherwise(F.regexp_replace(text, "([<\\[])\\\\(\\\\*)" + _CONTROL, "$1$2$3"))


def _render(turns: Column, level: int) -> Column:
    def one(x: Column) -> Column:
        text = _escape(x["text"], level)
        out = F.concat(F.lit(OTHER[0]), F.hex(x["role"]), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
        for role, (a, b) in MARKS.items():
            out = F.when(x["role"] == role, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
        return out

    body = F.array_join(F.transform(turns, one), "")
    return F.concat(F.lit(HEADER), body) if level == 2 else body


def parse(formatted: Column) -> Column:
    """The turns (role, text) of formatted; null if the grammar does not cover all of it."""
    headed = formatted.startswith(HEADER)
    body = F.when(headed, F.substring(formatted, len(HEADER) + 1, 2**31 - 1)).otherwise(formatted)
    level = F.when(headed, 2).otherwise(1)
    found = F.regexp_extract_all(body, F.lit(_TURN), F.lit(0))

    def one(x: Column) -> Column:
        role, text = F.unhex(F.regexp_extract(x, "^<<ROLE ([0-9A-F]*)>>", 1)).cast("string"), F.regexp_extract(x, "(?s)^<<ROLE [0-9A-F]*>>\\n(.*)\\n<</ROLE>>\\n$", 1)
        for name in ("system", "assistant", "user"):
            a, b = MARKS[name]
            role = F.when(x.startswith(a), F.lit(name)).otherwise(role)
            text = F.when(x.startswith(a), F.substr(x, F.lit(len(a) + 1), F.length(x) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), _unescape(text, level).alias("text"))

    return F.when(F.array_join(found, "") == body, F.transform(found, one))


def format_conversations(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, formatted, level (of escaping), turns (as parsed from formatted) and round_trip."""
    none = F.lit("")
    source = rows.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(role, none).alias("role"), F.coalesce(text, none).alias("text")))).alias("t"))
    df = source.select(key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    df = df.withColumn("f", _render(F.col("source"), 0)).withColumn("turns", parse(F.col("f"))).withColumn("level", F.lit(0))
    for level in (1, 2):
        same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
        df = df.withColumn("g", F.when(same, F.col("f")).otherwise(_render(F.col("source"), level))).withColumn("level", F.when(same, F.col("level")).otherwise(level))
        df = df.select(key, "source", F.col("g").alias("f"), "level", F.when(F.col("level") < level, F.col("turns")).otherwise(parse(F.col("g"))).alias("turns"))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    # The last level is unambiguous; were it not, no conversation is given that reads back otherwise.
    turns = F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not read back")).cast(df.schema["turns"].dataType))
    return df.select(key, F.col("f").alias("formatted"), "level", turns.alias("turns"), same.alias("round_trip"))


def loss_spans(formatted: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """One row per turn that bears loss: key, position of the turn, text."""
    rows = formatted.select(key, F.posexplode("turns").alias("position", "t"))
    return rows.where(F.col("t.role") == "assistant").select(key, "position", F.col("t.text").alias("text"))
