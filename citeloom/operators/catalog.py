"""Catalog and staging queries: composed filters, facets in one pass, stable pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators import predicates as P


@dataclass(frozen=True)
class CatalogQuery:
    search: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    venue: str | None = None
    doi_search: str | None = None
    doi: str = "all"
    marks: list[str] = field(default_factory=list)
    venues: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    sort: str = "year"
    descending: bool = True
    page: int = 1
    page_size: int = 50

    def where(self, df: DataFrame) -> Column:
        parts = [P.mark_filter(F.col("mark"), self.marks)]
        if self.search:
            parts.append(P.literal_search([F.col("title"), F.col("paperId")], self.search))
        for column, pattern in (("venue", self.venue), ("doi", self.doi_search)):
            if pattern and pattern.strip() and column in df.columns:
                parts.append(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))).rlike(pattern.strip().lower()))
        if self.year_min is not None or self.year_max is not None:
            parts.append(P.year_range(F.col("year"), self.year_min, self.year_max))
        if self.doi != "all":
            has = F.coalesce(F.trim("doi") != "", F.lit(False))
            parts.append(has if self.doi == "with" else ~has)
        if self.venues:
            parts.append(F.trim("venue").isin(self.venues))
        if self.topics:
            parts.append(F.col("topic").isin(self.topics))
        for name, op, value, to in P.parse_rules(self.rules):
            c = routed(df, name)
            if c is not None:
                number = dict(df.select(c.alias("c")).dtypes)["c"] in ("int", "bigint", "double")
                parts.append(P.number_rule(c, op, float(value), None if to is None else float(to)) if number else P.text_rule(c, op, value))
        return P._all(parts)


def routed(df: DataFrame, name: str) -> Column | None:
    """The column that a rule's name is for: identifiers are DOIs, else URLs; authors are their names in one text; None if there is none."""
    if name == "identifier":
        return next((F.col(c) for c in ("doi", "url") if c in df.columns), None)
    if name == "authors" and "authors_display" in df.columns:
        return F.array_join("authors_display", " || ")
    return F.col(name) if name in df.columns else None


def with_marks(papers: DataFrame, marks: DataFrame) -> DataFrame:
    return papers.join(marks, "paperId", "left").withColumn("mark", F.coalesce("mark", F.lit("standard")))


def select(papers: DataFrame, marks: DataFrame, q: CatalogQuery) -> DataFrame:
    df = with_marks(papers, marks)
    return df.where(q.where(df))


def page(df: DataFrame, q: CatalogQuery, key: str = "paperId") -> DataFrame:
    """Nulls come first in both directions; the key makes the order total."""
    if not 1 <= q.page_size <= 200:
        raise ValueError("page_size must be 1 to 200")
    c = F.col(q.sort)
    return df.orderBy(c.desc_nulls_first() if q.descending else c.asc_nulls_first(), key).offset((q.page - 1) * q.page_size).limit(q.page_size)


def staging_page(df: DataFrame, sort: str, descending: bool, number: int, size: int, key: str) -> DataFrame:
    """Empty values come last in both directions, whatever the case."""
    size, number = min(max(size, 1), 200), max(number, 1)
    c = F.lower(F.col(sort).cast("string")) if dict(df.dtypes)[sort] == "string" else F.col(sort)
    empty = F.col(sort).isNull() | (F.trim(F.col(sort).cast("string")) == "")
    return df.orderBy(empty, c.desc() if descending else c.asc(), key).offset((number - 1) * size).limit(size)


def facets(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of all facets from one pass: each row gives its values to all of them."""
    def named(k: str, c: Column) -> Column:
        return F.transform(c, lambda v: F.struct(F.lit(k).alias("facet"), F.trim(v).alias("value")))

    rows = df.select(F.explode(F.concat(*[named(k, c) for k, c in columns.items()])).alias("x")).select("x.*").where("value is not null and value <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def paper_facets(papers: DataFrame) -> DataFrame:
    one = lambda c: F.array(F.col(c).cast("string"))
    return facets(papers, {"title": one("title"), "venue": one("venue"), "year": one("year"), "authors": F.col("authors_display"), "identifier": F.array(F.when(F.trim("doi") != "", F.concat(F.lit("doi::"), "doi")))})


def staging_facets(rows: DataFrame) -> DataFrame:
    """As paper_facets of staging rows: authors are one text, identifiers are DOIs and URLs."""
    one = lambda c: F.array(F.col(c).cast("string"))
    named = F.array(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{c}::"), F.trim(c))) for c in ("doi", "url")])
    return facets(rows, {**{c: one(c) for c in ("title", "authors", "venue", "year")}, "identifier": named})


def facet_options(counts: DataFrame, selected: list[tuple[str, str]], cap: int | None = 150) -> DataFrame:
    """The cap commonest of each facet (None: all), and those selected though absent with count 0."""
    from pyspark.sql import Window

    top = counts
    if cap is not None:
        top = counts.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("r") <= cap).drop("r")
    chosen = counts.sparkSession.createDataFrame(selected, "facet string, value string")
    return top.unionByName(chosen.join(counts, ["facet", "value"], "left").select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))).distinct()


def in_order(papers: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of ids in the order given, each once."""
    wanted = papers.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(ids))], "paperId string, position int")
    return papers.join(F.broadcast(wanted), "paperId").orderBy("position")  # ids are an argument of the call


def clamped_page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page of at most 50 rows; a number past the last page means the last."""
    size = min(max(size, 1), 50)
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def export_new(rows: DataFrame, present: DataFrame) -> DataFrame:
    """rows whose key (the DOI, else the URL) is not in the target; rows without a key are all new."""
    key = F.coalesce(F.nullif(F.lower(F.trim("doi")), F.lit("")), F.nullif(F.lower(F.trim("url")), F.lit("")))
    there = present.select(key.alias("key")).where("key IS NOT NULL").distinct()
    return rows.withColumn("key", key).join(there, "key", "left_anti").drop("key")
