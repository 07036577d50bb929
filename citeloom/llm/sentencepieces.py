"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of a model has a whitespace marker behind another character, merges never cross from
a word into the next marker. A text then falls into chunks (markers, then what follows up to the
next marker) that are segmented independently: each distinct chunk is segmented once and its ids
are joined back to the texts by position.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ``""``. Rows
that repeat are encoded each. Texts may be of any length; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct chunks that a task keeps; beyond it the table starts anew, which costs time only.
TABLE = 200_000


@lru_cache(maxsize=2)
def processor(model: str):
    """The library's processor of a model whose chunks are independent; ValueError for other models."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=model)
    if any(re.search(f"[^{MARK}]{MARK}", found.id_to_piece(i)) for i in range(found.vocab_size())):
        raise ValueError("a piece crosses a whitespace marker: chunks aren't independent")
    lone = found.piece_to_id(MARK)
    if found.id_to_piece(lone) != MARK or found.encode("  a  b ") != [*found.encode("  a"), *found.encode(" b"), lone]:
        raise ValueError("the model normalises whitespace: chunks aren't independent")
    return found


class ChunkTable:
    """ids of each distinct chunk, segmented once, and the same as text."""

    def __init__(self, model: str):
        self.processor, self.known = processor(model), {}
        self.lone = self.processor.piece_to_id(MARK)

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > TABLE:  # what is still in use stays
            self.known = {c: self.known[c] for c in chunks if c in self.known}
        # The dummy prefix that the library puts before a text stands for the chunk's first marker.
        new = [c for c in chunks if c not in self.known]
        for c, ids in zip(new, self.processor.encode([c[1:] for c in new], num_threads=1) if new else []):
            ids = tuple(ids) or (self.lone,)  # tuples of numbers cost the garbage collector nothing
            self.known[c] = ids, ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """The ids of each text, and the same joined by commas."""
        chunks = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(chunks)))
        for found in chunks:
            rows = [self.known[c] for c in found]
            yield list(chain.from_iterable([r[0] for r in rows])), ",".join([r[1] for r in rows])


def encode(docs: DataFrame, model: str, *, text: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns of keep (all but the text by default) with n_tokens; ids: the ids themselves;
    digests: SHA-256 of the decimal ids joined by commas and of the text that decode(ids) gives."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    added = {"ids": ("array<int>", ids), "n_tokens": ("bigint", True), "ids_sha256": ("string", digests), "decoded_sha256": ("string", digests)}
    fields = [docs.schema[c] for c in keep if c not in added]
    spec = {k: t for k, (t, wanted) in added.items() if wanted}
    source = docs.select(*[F.col(f"`{f.name}`").alias(f"__{i}") for i, f in enumerate(fields)], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{k} {t}" for k, t in spec.items()])
    return source.mapInArrow(_encoder(model, [f.name for f in fields], spec), schema)


def _encoder(model: str, keep: list[str], spec: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from citeloom.llm.common import small_batches

        table = ChunkTable(model)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        kinds = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}
        for batch in small_batches(batches, "__text", 1 << 20):
            out: dict[str, list] = {k: [] for k in spec}
            for ids, joined in table.encode([x or "" for x in batch.column("__text").to_pylist()]):
                if "ids" in out:
                    out["ids"].append(ids)
                out["n_tokens"].append(len(ids))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(digest(joined))
                    out["decoded_sha256"].append(digest(table.processor.decode(ids) if ids else ""))
            yield pa.RecordBatch.from_arrays([batch.column(f"__{i}") for i in range(len(keep))] + [pa.array(v, kinds[spec[k]]) for k, v in out.items()], names=[*keep, *spec])

    return run


def decode(encoded: DataFrame, model: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the library's text of each row of ids; null ids give null."""
    fields = [f for f in encoded.schema if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{text}` string"])
    at, names = [f.name for f in fields].index(ids), [f.name for f in fields] + [text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(model)
        for batch in batches:
            values = [None if x is None else p.decode(x) if x else "" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=names)

    return encoded.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)
