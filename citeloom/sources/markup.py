"""Items of a reference manager, kinds of files by extension, and sinks that read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def library_item(json: Column) -> Column:
    """title, authors (creators who are authors and have a last name), year, doi, tags, publication, url, abstract and kind of a
    reference manager's item."""
    item = F.from_json(json, "title string, DOI string, date string, publicationTitle string, url string, abstractNote string, itemType string, creators array<struct<creatorType: string, firstName: string, lastName: string>>, tags array<struct<tag: string>>")
    part = lambda x: F.nullif(F.trim(x), F.lit(""))
    who = F.filter(item["creators"], lambda c: (c["creatorType"] == "author") & part(c["lastName"]).isNotNull())
    names = F.coalesce(F.transform(who, lambda c: F.concat_ws(" ", part(c["firstName"]), part(c["lastName"]))), F.array().cast("array<string>"))
    told = lambda c: F.coalesce(item[c], F.lit(""))
    year = F.nullif(F.regexp_extract(item["date"], "\\b(?:19|20)\\d{2}\\b", 0), F.lit(""))
    tags = F.coalesce(F.transform(item["tags"], lambda t: t["tag"]), F.array().cast("array<string>"))
    return F.struct(F.coalesce(item["title"], F.lit("Untitled")).alias("title"), names.alias("authors"), year.cast("int").alias("year"), told("DOI").alias("doi"), tags.alias("tags"), told("publicationTitle").alias("publication"), told("url").alias("url"), told("abstractNote").alias("abstract"), told("itemType").alias("kind"))


def kind_of(path: Column) -> Column:
    """Which reader a file is for, by its extension."""
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("html", "htm"), "html").when(ext.isin("xml", "jats", "nxml"), "xml").when(ext == "tex", "latex").when(ext == "docx", "docx").otherwise("unknown")


def write_catalog(rows: DataFrame, path: str, flags: list[str]) -> DataFrame:
    """rows as a Parquet table whose flags are booleans without nulls, read back."""
    rows.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flags}).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_checkpoint(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Each frame as a Parquet table and a manifest (frame, rows) as JSON, read back."""
    spark = next(iter(frames.values())).sparkSession
    counts = None
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        own = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("frame"), F.count("*").alias("rows"))
        counts = own if counts is None else counts.unionByName(own)
    counts.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("frame string, rows bigint").json(f"{path}/manifest")


def write_lines(rows: DataFrame, path: str) -> DataFrame:
    """rows as JSON lines, read back as text."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
    return rows.sparkSession.read.text(path)
