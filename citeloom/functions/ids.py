"""Identifier and text normalisers as column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def work_id(c: Column) -> Column:
    """Last path segment, upper case, with a leading W."""
    last = F.upper(F.element_at(F.split(F.trim(c), "/"), -1))
    return F.when(last.startswith("W"), last).otherwise(F.concat(F.lit("W"), last))


def strict_work_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(c), "W[0-9]+", 0), F.lit(""))


def match_doi(c: Column, every_prefix: bool = False) -> Column:
    """Lower case, without the first (or every) leading resolver prefix; null if nothing is left."""
    pattern = "^(https?://(dx\\.)?doi\\.org/|doi:)" + ("+" if every_prefix else "")
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(c)), pattern, "")), F.lit(""))


def find_doi(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0), F.lit(""))


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;\\\\\n]"), lambda x: F.trim(x)), lambda x: x != "")


def author_summary(names: Column, first: int = 3) -> Column:
    return F.concat(F.array_join(F.slice(names, 1, first), ", "), F.when(F.size(names) > first, " et al.").otherwise(""))


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_\\s-]", ""), "[\\s-]+", "_"), 1, 50)


#: Maps that are put in order at once.
BATCH = 100


def _ordered(gaps: bool):
    @F.arrow_udf("string")
    def run(maps: pa.Array) -> pa.Array:
        out = [_joined(maps.slice(a, BATCH), gaps) for a in range(0, len(maps), BATCH)]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return run


def _joined(maps: pa.Array, gaps: bool) -> pa.Array:
    """The words of each map by position, then by name; with gaps, each has as many spaces before it as there are places since the one before, else one."""
    n = np.diff(maps.offsets.to_numpy())
    lists, words = maps.items.slice(maps.offsets[0].as_py(), int(n.sum())), maps.keys.slice(maps.offsets[0].as_py(), int(n.sum()))
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.repeat(np.arange(len(maps)), n), many)
    word, at = np.repeat(np.arange(len(words)), many), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((at, doc))
    if (np.diff(at[order]) == 0)[np.diff(doc[order]) == 0].any():
        rank = pc.rank(words, tiebreaker="dense").to_numpy()
        order = np.lexsort((rank[word], at, doc))
    doc, at = doc[order], at[order]
    first = np.append(True, np.diff(doc) != 0) if len(doc) else np.zeros(0, bool)
    gap = np.where(first, at, np.maximum(np.diff(at, prepend=0), 1)) if gaps else np.where(first, 0, 1)
    told = pc.binary_join_element_wise(pc.binary_repeat(" ", pa.array(gap)), words.take(pa.array(word[order])), "")
    size = np.bincount(doc, minlength=len(maps))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), told), "")
    return pc.if_else(pa.array(size > 0), joined, pa.scalar(None, pa.string()))


def gapped_text(index: Column) -> Column:
    """The words of a map from word to positions, in order; a position without a word is an empty string. Null for no words."""
    return _ordered(True)(index)


def from_inverted_index(m: Column) -> Column:
    """Words of a word-to-positions map in the order of their positions, with one space between."""
    return F.nullif(F.trim(_ordered(False)(m)), F.lit(""))


def presence(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))
