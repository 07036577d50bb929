"""A folder of papers' files as a Spark data source, read and written file by file.

``register(spark)`` adds the format ``papers_folder``. Reading gives one row for each file: its path
below the folder and its bytes; files that can't be read are left out. ``read`` lets tasks list the folders, and
deals files to tasks so that these get ``bytes`` each, or ``files`` (4,096), on average. Writing takes rows (path, content): every file is written
under another name and renamed when it is whole, so a task that is run again leaves no halves.

Notes are Markdown files with fields in front, between lines of three dashes, in the part of YAML that such
notes use: scalars, plain or quoted, over one line or several, lists in brackets or with a dash on each line.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from citeloom.operators.scratch import cut_lineage
from citeloom.sources import papers, works

_ROW = "path string, content binary"
#: Bytes of files that a task hands on at once (a larger file alone).
_HELD = 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


def _level(folder: str, below: str, suffix: str) -> Iterator[tuple[str, int, bool]]:
    """Path below the folder and bytes of each file that stands in a folder below it, and its folders. Names of a local folder come one by one."""
    from pyarrow import fs

    files, root = _filesystem(folder)
    at = f"{root}/{below}".rstrip("/") or "/"
    if isinstance(files, fs.LocalFileSystem):
        try:
            entries = os.scandir(at)
        except (FileNotFoundError, NotADirectoryError):
            return
        with entries:
            for e in entries:
                try:
                    if e.is_dir():
                        yield f"{below}{e.name}/", 0, True
                    elif e.is_file() and e.name[0] not in "._" and e.name.endswith(suffix):
                        yield f"{below}{e.name}", e.stat().st_size, False
                except OSError:
                    continue
        return
    for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if f.type == fs.FileType.Directory:
            yield f"{below}{f.base_name}/", 0, True
        elif f.is_file and f.base_name[0] not in "._" and f.base_name.endswith(suffix):
            yield f"{below}{f.base_name}", f.size, False


def _walk(folder: str, below: str, suffix: str, deep: bool = True) -> Iterator[str]:
    for path, _, is_folder in _level(folder, below, suffix):
        if not is_folder:
            yield path
        elif deep:
            yield from _walk(folder, path, suffix)


def _contents(folder: str, paths: Iterable[str]) -> Iterator[tuple[str, bytes]]:
    files, root = _filesystem(folder)
    for path in paths:
        try:
            with files.open_input_stream(f"{root}/{path}") as f:
                content = f.read()
        except OSError:
            continue
        yield path, content


class Part(InputPartition):
    def __init__(self, below: str):
        self.below = below


class Reader(DataSourceReader):
    """A task for each folder in the given one. read() deals files evenly."""

    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[Part]:
        return [Part(""), *(Part(path) for path, _, is_folder in _level(self.folder, "", self.suffix) if is_folder)]

    def read(self, part: Part) -> Iterator[tuple]:
        yield from _contents(self.folder, _walk(self.folder, part.below, self.suffix, deep=part.below != ""))


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = _filesystem(self.folder)
        made = set()
        for path, content in rows:
            target = f"{root}/{path}"
            parent, _, name = target.rpartition("/")
            if parent not in made:
                files.create_dir(parent, recursive=True)
                made = {parent, *(made if len(made) < 1000 else ())}
            fresh = f"{parent}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(fresh) as f:
                f.write(bytes(content))
            files.move(fresh, target)
        return WriterCommitMessage()


class PapersFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers_folder"

    def schema(self) -> str:
        return _ROW

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PapersFolder)


def _listing(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path and size of each file. Tasks list the folders of one level at a time; the driver gets no names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (e for batch in batches for below in batch.column(0).to_pylist() for e in _level(folder, below, suffix))
        while rows := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], names=["path", "size", "folder"])

    level, folders, listed = spark.range(1).select(F.lit("").alias("path")), 1, []
    while folders:
        dealt = level.repartition(min(folders, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
        here = cut_lineage(dealt.mapInArrow(run, "path string, size bigint, folder boolean"), "listing")
        listed.append(here.where("not folder").select("path", "size"))
        level = here.where("folder").select("path")
        folders = level.count()
    return functools.reduce(DataFrame.unionByName, listed)


def read(spark: SparkSession, folder: str, suffix: str = "", bytes: int = 64 << 20, files: int = 4096) -> DataFrame:
    """path and content of each file in a folder and those below it."""
    listed = _listing(spark, folder, suffix)
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, content in _contents(folder, (p for batch in batches for p in batch.column(0).to_pylist())):
            rows.append((path, content))
            held += len(content)
            if held >= _HELD or len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "content"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "content"])

    return listed.select("path").repartition(max(1, -(-n // files), -(-size // bytes)), "path").mapInArrow(run, _ROW)


def write(files: DataFrame, folder: str, dealt: bool = True) -> None:
    """Rows (path, content) as files; those that are there already are replaced. A file costs much the same however small it is, so
    rows are dealt to as many tasks as shuffles have partitions, which by their bytes may be one; dealt: they lie so already."""
    register(files.sparkSession)
    files = files if dealt else files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    files.select("path", F.col("content").cast("binary")).write.format("papers_folder").mode("append").save(folder)


def text_of(content: str) -> Column:
    """Bytes as text; what is no UTF-8 becomes a replacement character."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def metadata(files: DataFrame) -> DataFrame:
    """path, kind and the fields of each file whose kind has a reader and that says anything."""
    kind = papers.kind_of_bytes(F.col("content"), F.col("path"))
    told = files.withColumn("kind", kind)
    tex = works.latex("text")
    plain = told.where("kind = 'latex'").select("path", "kind", text_of("content").alias("text")).select("path", "kind", tex.alias("m")).select("path", "kind", "m.title", "m.authors", "m.abstract", F.col("m.year").cast("string").alias("year"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("venue"))
    rest = told.where(F.col("kind").isin("html", "xml", "tei", "docx")).select("path", "kind", papers.by_kind("kind", "content").alias("m")).select("path", "kind", "m.*")
    return rest.unionByName(plain).where("title is not null or size(authors) > 0 or abstract is not null or year is not null or doi is not null or venue is not null")


# --- notes ---------------------------------------------------------------------------------------

_KEY = re.compile(r"([A-Za-z_][\w -]*?):(?:\s+(.*))?\Z")


def _scalar(text: str) -> str | None:
    """A value as text; null for the ways to say nothing."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text, strict=False)
        except ValueError:
            return text[1:-1]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    text = re.split(r"\s#", text)[0].strip()
    return None if text in ("", "~", "null", "Null", "NULL") else text


def _items(text: str) -> list[str]:
    """The values of a list in brackets."""
    found = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|\Z)""", text.strip()[1:-1])
    return [x for f in found if (x := _scalar(f)) is not None]


def front_fields(text: str) -> tuple[dict[str, str], dict[str, list[str]]] | None:
    """Scalars and lists in front of a note; null without a whole block. Nested blocks other than lists are passed over."""
    found = re.match(r"---[^\S\n]*\r?\n(.*?)^---[^\S\n]*\r?$", text, re.S | re.M)
    if not found:
        return None
    scalars, lists, key, held = {}, {}, None, []

    def close() -> None:
        nonlocal key, held
        if key is not None:
            own, rest = held[0], held[1:]
            if not own and rest and all(x.lstrip().startswith("- ") or x.strip() == "-" or x[:1].isspace() for x in rest):
                entries: list[str] = []
                for x in rest:
                    if re.match(r"\s*-(\s|\Z)", x):
                        entries.append(x.strip()[1:].strip())
                    elif entries:
                        entries[-1] += " " + x.strip()
                if entries:
                    lists[key] = [y for x in entries if (y := _scalar(x)) is not None]
            else:
                whole = " ".join([own, *(x.strip() for x in rest)]).strip()
                if whole.startswith("[") and whole.endswith("]"):
                    lists[key] = _items(whole)
                elif (value := _scalar(whole)) is not None:
                    scalars[key] = value
        key, held = None, []

    for line in re.split(r"\r?\n", found[1]):
        top = _KEY.match(line)
        if top and not line[0].isspace():
            close()
            key, held = top[1], [(top[2] or "").strip()]
        elif key is not None and line.strip():
            held.append(line)
    close()
    return (scalars, lists) if scalars or lists else None


@F.pandas_udf(T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]))
def note(texts: pd.Series) -> pd.DataFrame:
    """fields and lists of each note; null where there are none."""
    rows = [front_fields(x) if x else None for x in texts]
    return pd.DataFrame({"fields": [r[0] if r else None for r in rows], "lists": [r[1] if r else None for r in rows]})


def library(files: DataFrame) -> DataFrame:
    """path, fields and lists of the notes among files; those without fields are left out."""
    told = files.where(F.endswith("path", F.lit(".md"))).select("path", note(text_of("content")).alias("n"))
    return told.select("path", "n.fields", "n.lists").where("fields is not null")


def note_text(fields: dict[str, Column], title: Column, body: list[Column]) -> Column:
    """A note: fields by name in front, as JSON values, which are YAML too; then a heading and paragraphs, without null ones."""

    def line(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), "(?s)\\A\\[(.*)\\]\\z", "$1"), F.lit("null")), F.lit("\n"))

    front = F.concat(*[line(n, c) for n, c in fields.items()])
    return F.concat(F.lit("---\n"), front, F.lit("---\n\n# "), F.coalesce(title, F.lit("Untitled")), F.lit("\n\n"), F.concat_ws("\n\n", *body), F.lit("\n"))
