"""Works and library rows between shapes: projections, validation, explosion and staging.

Defined results: missing arrays count as empty, missing text as ''; of rows with equal keys the first
in the given order stays; tables without rows give none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import ids
from citeloom.operators import predicates as P


def some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def authorship(records: DataFrame) -> DataFrame:
    """Distinct (paperId, authorId) of papers, of what cites them and of what they cite."""
    own = records.select("paperId", F.explode("authors").alias("authorId"))
    for c in ("citations", "references"):
        own = own.unionByName(records.select(F.explode(c).alias("p")).select(F.col("p.paperId").alias("paperId"), F.explode("p.authors").alias("authorId")))
    return own.where(F.coalesce(F.trim("authorId") != "", F.lit(False))).distinct()


def nested_edges(records: DataFrame, column: str, other: str) -> DataFrame:
    """Distinct (paperId, other) of an array of papers in each record; pairs without an id go."""
    pairs = records.select("paperId", F.explode(F.transform(column, lambda p: p["paperId"])).alias(other))
    return pairs.where(some(F.col("paperId")).isNotNull() & some(F.col(other)).isNotNull()).distinct()


def abstracts(rows: DataFrame) -> DataFrame:
    return rows.where(some(F.col("abstract")).isNotNull()).select("paperId", "abstract").distinct()


def valid_legacy(papers: DataFrame) -> DataFrame:
    """As valid papers; a processed one has an abstract, be it empty."""
    return papers.where(some(F.col("paperId")).isNotNull() & F.col("title").isNotNull() & (~F.coalesce("processed", F.lit(False)) | F.col("abstract").isNotNull()))


def validation_counts(rows: DataFrame) -> DataFrame:
    good = F.col("paperId").isNotNull() & F.col("title").isNotNull()
    return rows.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"))


def coerced(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns as the types asked for: booleans that don't parse are false, text that is missing is '', numbers stay null."""
    def one(c: str, t: str) -> Column:
        x = F.col(c)
        if t == "boolean":
            text = F.lower(F.trim(x.cast("string")))
            return F.coalesce(text.isin("true", "1", "yes", "1.0"), F.lit(False))
        if t == "string":
            return F.coalesce(x.cast("string"), F.lit(""))
        number = x.cast("string").try_cast("double")
        return number.cast("bigint") if t == "bigint" else number

    return rows.select(*[one(c, types[c]).alias(c) if c in types else F.col(c) for c in rows.columns])


def hierarchy(concepts: Column) -> Column:
    """Names of concepts by level: domains, fields, subfields and, from the third level on, topics."""
    named = F.filter(concepts, lambda x: F.coalesce(F.trim(x["name"]) != "", F.lit(False)))
    at = lambda rule: F.transform(F.filter(named, rule), lambda x: x["name"])
    return F.struct(at(lambda x: x["level"] == 0).alias("domains"), at(lambda x: x["level"] == 1).alias("fields"), at(lambda x: x["level"] == 2).alias("subfields"), at(lambda x: x["level"] >= 3).alias("topics"))


def paper_of(work: DataFrame) -> DataFrame:
    """paperId, doi, venue, venue_id, year, title, authors, abstract and n_topics of works with nested fields. The venue is that of the
    primary location, else the host, else the first other location with a name; its id is the first two's."""
    others = F.filter(F.transform("locations", lambda x: some(x["name"])), lambda n: n.isNotNull())
    place = F.coalesce(some(F.col("primary_location.name")), some(F.col("host_venue.name")), F.get(others, 0), F.lit(""))
    source = F.upper(F.element_at(F.split(F.trim(F.coalesce(some(F.col("primary_location.id")), some(F.col("host_venue.id")))), "/"), -1))
    names = F.filter(F.transform("authorships", lambda a: a["name"]), lambda n: F.coalesce(F.trim(n) != "", F.lit(False)))
    return work.select(ids.work_id(F.col("id")).alias("paperId"), F.coalesce(ids.match_doi(F.col("doi")), F.lit("")).alias("doi"), place.alias("venue"), source.alias("venue_id"), F.col("publication_year").alias("year"), F.coalesce("title", F.lit("")).alias("title"),
                       names.alias("authors"), ids.from_inverted_index(F.col("abstract_index")).alias("abstract"), F.size(hierarchy(F.col("concepts"))["topics"]).alias("n_topics"))


def institutions(authorships: Column) -> Column:
    """Names of the authors' institutions, each where it is first seen."""
    return F.array_distinct(F.filter(F.flatten(F.transform(authorships, lambda a: F.coalesce(a["institutions"], F.array().cast("array<string>")))), lambda n: F.coalesce(F.trim(n) != "", F.lit(False))))


def detail_of(work: DataFrame) -> DataFrame:
    url = F.coalesce(some(F.col("primary_location.url")), F.concat(F.lit("https://doi.org/"), ids.match_doi(F.col("doi"))), F.col("id"))
    return work.select(ids.work_id(F.col("id")).alias("paperId"), F.greatest(F.size("referenced_works"), F.lit(0)).alias("references_count"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), institutions(F.col("authorships")).alias("institutions"), url.alias("url"),
                       ids.author_summary(F.transform("authorships", lambda a: a["name"])).alias("authors"))


#: Names under which rows carry a field, in the order they are asked for.
ALIASES = {"paper_id": ["paper_id", "paperId", "id"], "title": ["title", "display_name", "name"], "year": ["year", "publication_year"], "venue": ["venue", "journal", "source"]}


def normalised(rows: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The first of each field's names that has a value; rows without an id go."""
    aliases = ALIASES if aliases is None else aliases
    picked = {f: [some(F.col(c).cast("string")) for c in names if c in rows.columns] for f, names in aliases.items()}
    out = rows.select(*[F.coalesce(*cs, F.lit(None)).alias(f) if cs else F.lit(None).cast("string").alias(f) for f, cs in picked.items()])
    return out.where(F.col(next(iter(aliases))).isNotNull())


def staged(library: DataFrame, source: str) -> DataFrame:
    """Library papers as staging rows, all selected."""
    return library.select("paperId", "title", F.array_join("authors", ", ").alias("authors"), "venue", "year", F.coalesce("doi", F.lit("")).alias("doi"), F.lit(source).alias("source"), F.lit("library").alias("source_type"), F.lit(True).alias("is_selected"))


def library_edit(library: DataFrame, added: DataFrame, removed: DataFrame, key: str = "paperId") -> tuple[DataFrame, DataFrame]:
    """(the library after it, counts added, skipped, removed, missing): ids present are skipped, absent ones not removed."""
    new, gone = added.dropDuplicates([key]), removed.select(key).distinct()
    fresh = new.join(library.select(key), key, "left_anti")
    after = library.unionByName(fresh).join(gone, key, "left_anti")
    found = gone.join(library.select(key).union(fresh.select(key)), key, "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(new, "asked").crossJoin(n(fresh, "added")).crossJoin(n(gone, "named")).crossJoin(n(found, "removed"))  # one row each
    return after, counts.select("added", (F.col("asked") - F.col("added")).alias("skipped"), "removed", (F.col("named") - F.col("removed")).alias("missing"))


def staging_selection(rows: DataFrame, chosen: DataFrame, dropped: DataFrame, key: str = "staging_id") -> DataFrame:
    """rows without the dropped, with is_selected set for the chosen alone."""
    marked = chosen.select(key, F.lit(True).alias("__on")).distinct()
    return rows.join(dropped.select(key), key, "left_anti").join(marked, key, "left").withColumn("is_selected", F.coalesce("__on", F.lit(False))).drop("__on")


@dataclass(frozen=True)
class StagingFilter:
    """All conditions hold; text is compared trimmed and in lower case, and a null year passes a range but no set."""

    sources: list[str] = field(default_factory=list)
    year_min: int | None = None
    year_max: int | None = None
    title: str = ""
    venue: str = ""
    author: str = ""
    keyword: str = ""
    doi: str = ""
    selected_only: bool = False
    retraction: str = ""
    titles: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    venues: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)

    def column(self, types: dict[str, str]) -> Column:
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        has = low("doi") != ""
        parts = []
        if self.sources:
            wanted = [s.lower() for s in self.sources]
            parts.append(low("source").isin(wanted) | low("source_type").isin(wanted))
        if self.year_min is not None or self.year_max is not None:
            parts.append(P.year_range(F.col("year"), self.year_min, self.year_max, nulls=True))
        parts += [F.contains(low(c), F.lit(q.strip().lower())) for c, q in (("title", self.title), ("venue", self.venue), ("authors", self.author)) if q.strip()]
        if q := self.keyword.strip().lower():
            parts.append(F.contains(low("title"), F.lit(q)) | F.contains(low("abstract"), F.lit(q)))
        parts += [has] if self.doi == "with" else [~has] if self.doi == "without" else []
        parts += [flag("is_selected")] if self.selected_only else []
        parts += [flag("is_retracted")] if self.retraction == "retracted" else [~flag("is_retracted")] if self.retraction == "not_retracted" else []
        parts += [F.trim(low(c)).isin([v.strip().lower() for v in vs if v.strip()]) for c, vs in (("title", self.titles), ("authors", self.authors), ("venue", self.venues)) if any(v.strip() for v in vs)]
        if self.years:
            parts.append(F.coalesce(F.col("year").isin(self.years), F.lit(False)))
        if found := identifier_rules(self.identifiers):
            parts.append(P._any([(F.trim(low(c)) != "") & (F.trim(low(c)) == v) for c, v in found]))
        for c, op, value, to in P.parse_rules(self.rules):
            if c in ("year",) or types.get(c) in ("int", "bigint", "double"):
                parts.append(P.number_rule(F.col(c), op, float(value), None if to is None else float(to)))
            else:
                parts.append(P.text_rule(identifier() if c == "identifier" else F.col(c), op, value))
        return P._all(parts) if parts else F.lit(True)


def identifier() -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce("doi", F.lit("")), F.coalesce("url", F.lit(""))))


def identifier_rules(values: list[str]) -> list[tuple[str, str]]:
    """(column, value) of doi::value and url::value; what else is asked for is dropped."""
    found = [v.partition("::") for v in values]
    return [(c.strip().lower(), v.strip().lower()) for c, sep, v in found if sep and c.strip().lower() in ("doi", "url") and v.strip()]


def flagged(rows: DataFrame, names: list[str]) -> Column:
    """Whether any of the columns with these names, as far as there are such, is true."""
    there = [F.coalesce(F.col(c).cast("string").try_cast("boolean"), F.lit(False)) for c in names if c in rows.columns]
    return P._any(there) if there else F.lit(False)


def topic_filter(rows: DataFrame, topics: list[str], models: list[str], model: str | None = None) -> Column:
    """Whether a model's topic is asked for; model: that one's column alone."""
    columns = [f"{m}_topic" for m in ([model] if model else models) if f"{m}_topic" in rows.columns]
    return P._any([F.coalesce(F.col(c).cast("string").isin(topics), F.lit(False)) for c in columns]) if columns and topics else F.lit(not topics)


def column_values(rows: DataFrame, titles: list[str] = (), venues: list[str] = (), years: list[int] = (), authors: list[str] = (), identifiers: list[str] = ()) -> Column:
    """Title and venue trimmed and as they are; an author as an element; identifiers in lower case."""
    parts = [F.coalesce(F.trim(c).isin(list(vs)), F.lit(False)) for c, vs in (("title", titles), ("venue", venues)) if vs]
    parts += [F.coalesce(F.col("year").isin(list(years)), F.lit(False))] if years else []
    parts += [F.coalesce(F.arrays_overlap("authors_display", F.lit(list(authors))), F.lit(False))] if authors else []
    found = identifier_rules(list(identifiers))
    parts += [P._any([F.lower(F.trim(F.col(c))) == v for c, v in found if c in rows.columns])] if found else []
    return P._all(parts) if parts else F.lit(True)
