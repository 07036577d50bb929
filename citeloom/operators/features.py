"""Author, paper and venue features of a citation network (A1-A9, U, J1-J4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Word that a title may hold, by the column that tells it.
TITLE_WORDS = ("review", "survey", "tutorial", "benchmark", "dataset")
# Fixed values.
PREPRINT_SERVERS = ["arxiv", "biorxiv", "chemrxiv", "hal", "hprints", "medrxiv", "mp_arc", "ssrn", "techrxiv", "zenodo"]


def citation_counts(edges: DataFrame) -> DataFrame:
    """Rows of edges that leave each paper; pairs seen from both sides count twice."""
    return edges.groupBy("paperId").agg(F.count("*").alias("citation_count"))


def paper_features(papers: DataFrame, edges: DataFrame, paper_author: DataFrame) -> DataFrame:
    incoming = edges.groupBy(F.col("referencePaperId").alias("paperId")).agg(F.countDistinct("paperId").alias("in_citations"))
    authors = paper_author.groupBy("paperId").agg(F.countDistinct("authorId").alias("num_authors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return papers.select("paperId").join(citation_counts(edges), "paperId", "left").join(incoming, "paperId", "left").join(authors, "paperId", "left").select("paperId", zero("citation_count"), zero("in_citations"), zero("num_authors"))


def author_features(papers: DataFrame, edges: DataFrame, paper_author: DataFrame) -> DataFrame:
    """Papers, citations, years and co-authors of each author. Distinct co-authors take a row for each pair of authors of a paper, so
    papers with very many authors cost the square of that; Spark splits such papers' partitions."""
    own = paper_author.join(citation_counts(edges), "paperId", "left").join(papers.select("paperId", "year"), "paperId", "left")
    n = F.coalesce("citation_count", F.lit(0))
    mates = paper_author.join(paper_author.withColumnsRenamed({"authorId": "mate"}), "paperId").where("authorId <> mate").groupBy("authorId").agg(F.countDistinct("mate").alias("mates"))
    out = own.groupBy("authorId").agg(F.count("*").alias("num_papers"), F.sum(n).alias("num_citations"), F.max(n).alias("max_citations"), F.countDistinct("paperId").alias("num_coauthors"), F.coalesce(F.min("year"), F.lit(0)).alias("year_first_publication"), F.coalesce(F.max("year"), F.lit(0)).alias("year_last_publication"))
    return out.join(mates, "authorId", "left").withColumns({"avg_citations": F.round(F.col("num_citations") / (F.col("num_papers") + 1e-8), 6), "num_distinct_coauthors": F.coalesce("mates", F.lit(0)).cast("long")}).drop("mates")


def edge_venues(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the venues of both ends (null where a paper isn't known)."""
    a, b = papers.select("paperId", F.col("venue").alias("citing_venue")), papers.select(F.col("paperId").alias("referencePaperId"), F.col("venue").alias("cited_venue"))
    return edges.join(a, "paperId", "left").join(b, "referencePaperId", "left")


def venue_features(papers: DataFrame, edges: DataFrame, null_venues: list[str] | None = None) -> DataFrame:
    """Per venue: papers, citations within it, and those across, counted by the cited and by the citing venue."""
    if null_venues:
        papers = papers.withColumn("venue", F.when(~F.lower("venue").isin(null_venues), F.col("venue")))
    e = edge_venues(papers, edges)
    same = e.citing_venue.eqNullSafe(e.cited_venue)
    # One pass over the edges: each gives a row to the venues that it counts for.
    ends = e.select(F.explode(F.array(F.struct(F.col("citing_venue").alias("venue"), same.cast("int").alias("s"), F.lit(0).alias("c"), (~same).cast("int").alias("b")), F.struct(F.col("cited_venue").alias("venue"), F.lit(0).alias("s"), (~same).cast("int").alias("c"), F.lit(0).alias("b")))).alias("x")).select("x.*")
    rows = ends.withColumn("p", F.lit(0)).unionByName(papers.select("venue", F.lit(0).alias("s"), F.lit(0).alias("c"), F.lit(0).alias("b"), F.lit(1).alias("p"))).where("venue is not null")
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return rows.groupBy("venue").agg(total("p", "total_papers"), total("s", "self_citations"), total("c", "citing_others"), total("b", "being_cited_by_others"))


def title_flags(papers: DataFrame, abstracts: DataFrame | None = None) -> DataFrame:
    flags = {f"tc_{w}": F.coalesce(F.contains(F.lower("title"), F.lit(w)), F.lit(False)) for w in TITLE_WORDS}
    return papers.select("paperId", *[c.alias(k) for k, c in flags.items()], F.coalesce(F.lower("venue").isin(PREPRINT_SERVERS), F.lit(False)).cast("int").alias("is_preprint"))


def year_histogram(papers: DataFrame) -> DataFrame:
    return papers.where("year is not null").groupBy("year").agg(F.count("*").alias("papers")).orderBy("year")


def truthy(column: str, kind: str) -> Column:
    """How many a row counts for in a column of flags of whatever kind: booleans, numbers, or words for yes."""
    c = F.col(column)
    if kind == "boolean":
        return F.coalesce(c.cast("int"), F.lit(0))
    if kind == "string":
        return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "y", "retracted"), F.lit(False)).cast("int")
    return F.coalesce(c.cast("int"), F.lit(0))


def overview(papers: DataFrame, graph: DataFrame, topic: str = "topic_id", flags: tuple[str, ...] = ("retracted", "isRetracted", "is_retracted")) -> DataFrame:
    """One row: nodes and edges of the graph, its papers and authors, and the papers, topics and retracted papers of a catalog (the
    first column of flags that is there)."""
    kind = lambda k: F.coalesce(F.col("etype") == k, F.lit(False))
    ends = F.array(F.struct(F.col("src").alias("id"), kind("cites").alias("paper"), kind("author").alias("author"), F.lit(1).alias("edges")), F.struct(F.col("dst").alias("id"), F.lit(True).alias("paper"), F.lit(False).alias("author"), F.lit(0).alias("edges")))
    # One pass over the graph: an edge is counted at its start.
    nodes = graph.select(F.inline(ends)).groupBy("id").agg(F.bool_or("paper").alias("paper"), F.bool_or("author").alias("author"), F.sum("edges").alias("edges"))
    counts = nodes.agg(F.count("id").alias("total_nodes"), F.count_if("paper").alias("paper_nodes"), F.count_if("author").alias("author_nodes"), F.coalesce(F.sum("edges"), F.lit(0)).cast("bigint").alias("total_edges"))
    flag = next((c for c in flags if c in papers.columns), None)
    retracted = F.sum(truthy(flag, dict(papers.dtypes)[flag])) if flag else F.lit(0)
    topics = F.countDistinct(F.when(F.col(topic) >= 0, F.col(topic))) if topic in papers.columns else F.lit(0)
    own = papers.agg(F.count("*").alias("total_papers"), topics.cast("bigint").alias("total_topics"), F.coalesce(retracted, F.lit(0)).cast("bigint").alias("retracted_papers"))
    return counts.crossJoin(own)  # one row each


def progress(papers: DataFrame, fresh: DataFrame, citations: DataFrame, references: DataFrame, path: str) -> DataFrame:
    """One row of counters of an iteration, observed while its frames are written to path: no frame is read twice for them. fresh
    are the papers that the iteration found; those that are there already aren't added."""
    spark = papers.sparkSession
    new = fresh.join(papers.select("paperId"), "paperId", "left_anti").dropDuplicates(["paperId"])
    every = papers.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)), allowMissingColumns=True)
    counts = {"papers": (every, [F.count("*").alias("papers_collected"), F.count_if("isSeed").alias("seed_papers"), F.count_if("__new").alias("papers_added")]), "citations": (citations, [F.count("*").alias("citations_collected")]), "references": (references, [F.count("*").alias("references_collected")])}
    row = {}
    for name, (frame, columns) in counts.items():
        seen = Observation()
        frame.observe(seen, *columns).drop("__new").write.mode("overwrite").parquet(f"{path}/{name}")
        row |= seen.get
    return spark.createDataFrame([row], ", ".join(f"{k} bigint" for k in row))


def author_names(papers: DataFrame, paper_author: DataFrame, authors: DataFrame) -> DataFrame:
    """papers with authors_display, sorted; [] where there are none."""
    named = paper_author.join(authors.where("authorName is not null"), "authorId").groupBy("paperId").agg(F.array_sort(F.collect_set("authorName")).alias("authors_display"))
    return papers.join(named, "paperId", "left").withColumn("authors_display", F.coalesce("authors_display", F.array().cast("array<string>")))


def top_authors(catalog: DataFrame, edges: DataFrame, paper_author: DataFrame, n: int = 50) -> DataFrame:
    """The authors with the highest mean centrality (along edges, else against them) of their papers in a catalog, with all their
    papers counted and the citations of those in the catalog summed; authors without a paper there have no row."""
    score = next((c for c in ("centrality_in", "centrality_out") if c in catalog.columns), None)
    own = catalog.select("paperId", (F.col(score) if score else F.lit(0.0)).alias("c")).join(citation_counts(edges), "paperId", "left")
    rows = paper_author.join(own.withColumn("there", F.lit(True)), "paperId", "left").groupBy("authorId").agg(F.count("*").alias("papers"), F.sum("citation_count").alias("citations"), F.avg("c").alias("centrality"), F.max("there").alias("there"))
    return rows.where("there").select("authorId", "papers", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("centrality", F.lit(0.0)).alias("centrality")).orderBy(F.desc("centrality"), "authorId").limit(n)


def topic_overview(catalog: DataFrame, tops: DataFrame) -> DataFrame:
    """topic_id, papers and topic_label (its five heaviest terms) of each topic of a catalog; tops has (topic, place, term)."""
    counted = catalog.where("topic_id >= 0").groupBy("topic_id").agg(F.count("*").alias("papers"))
    words = tops.where("place <= 5").groupBy(F.col("topic").alias("topic_id")).agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("w"))
    label = F.array_join(F.transform("w", lambda x: x["term"]), " ")
    return counted.join(words, "topic_id", "left").select("topic_id", "papers", F.coalesce(label, F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))).alias("topic_label"))


def topic_links(catalog: DataFrame, site: str) -> DataFrame:
    """A row (topic_id, paperId, doi, url) for each paper of each topic; a topic's list may be of any length, so it stays rows."""
    own = F.nullif(F.col("url"), F.lit("")) if "url" in catalog.columns else F.lit(None).cast("string")
    return catalog.where("topic_id >= 0").select("topic_id", "paperId", "doi", F.coalesce(own, F.concat(F.lit(site), "paperId")).alias("url"))


def top_by_measures(rows: DataFrame, key: str, measures: list[str], each: int = 5, n: int = 20) -> DataFrame:
    """The first n of the union of each measure's largest, in the order of measures; a key stays once."""
    tops = [rows.orderBy(F.desc(m), key).limit(each).select(key, F.lit(i).alias("place"), F.col(m).alias("value")) for i, m in enumerate(measures)]
    union = tops[0]
    for t in tops[1:]:
        union = union.unionByName(t)
    first = union.groupBy(key).agg(F.min(F.struct("place", (-F.col("value")).alias("v"))).alias("b"))
    return first.orderBy("b.place", "b.v", key).limit(n).select(key, F.col("b.place").alias("place"))
