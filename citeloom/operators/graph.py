"""Heterogeneous citation graph and directed eigenvector centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from citeloom.operators import scratch
from citeloom.operators.predicates import meaningful_venue
from citeloom.operators.scratch import cut_lineage


#: Kinds of edges; an edge of several kinds is of the first.
KINDS = ("author", "cites", "venue")


def build(papers: DataFrame, references: DataFrame, citations_in: DataFrame | None, paper_author: DataFrame, ignored_venues: list[str] | None = None) -> DataFrame:
    """Distinct edges (src, dst, etype): author to paper, venue to paper, cited to citing. Rows may repeat; references may hold reversed citations, too."""
    def edge(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(KINDS.index(kind)).alias("kind"))

    venues = papers.where(F.coalesce(F.col("venue") != "", F.lit(False)) & ~F.col("venue").isin(ignored_venues or [""]))
    parts = [edge(paper_author, "authorId", "paperId", "author"), edge(venues, "venue", "paperId", "venue"), edge(references, "referencePaperId", "paperId", "cites")]
    if citations_in is not None:
        parts.append(edge(citations_in, "paperId", "citingPaperId", "cites"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # The least number, as the least word would make edges be sorted.
    return out.groupBy("src", "dst").agg(F.min("kind").alias("kind")).select("src", "dst", F.array(*[F.lit(k) for k in KINDS])[F.col("kind")].alias("etype"))


def size(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("nodes"))
    return ends.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def _step(x: DataFrame, edges: DataFrame) -> DataFrame:
    """x + A'x: a node gains what its in-edges bring; the shift keeps it from oscillating."""
    gain = edges.join(x.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "v")
    return x.unionByName(gain).groupBy("id").agg(F.sum("v").alias("v"))


def centrality(edges: DataFrame, max_iter: int = 100, tol: float = 1e-6, reverse: bool = False, fixed: bool = False) -> DataFrame:
    """(id, v) of unit length; null values if it doesn't converge. fixed: max_iter rounds, converged or not."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")
    e = cut_lineage(e.distinct(), "edges")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = ids.count()
    x = ids.withColumn("v", F.lit(1.0 / max(n, 1)))
    for k in range(max_iter):
        y = cut_lineage(_step(x, e), "rank")
        norm = y.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 1.0
        y = y.withColumn("v", F.col("v") / norm)
        if not fixed:
            moved = y.join(x.withColumnRenamed("v", "w"), "id").agg(F.sum(F.abs(F.col("v") - F.col("w")))).first()[0] or 0.0
            if moved < n * tol:
                return y
        x = y
    return x if fixed else x.withColumn("v", F.lit(None).cast("double"))


#: Nodes with a larger share of all edges than one in so many are joined by broadcast; there are at most that many at either end.
HUBS = 1000


def _directed(edges: DataFrame) -> DataFrame:
    """Edges in both directions: what ``here`` has goes ``there``, along edges (back = false) or against them."""
    ways = F.array(F.struct(F.col("src").alias("here"), F.col("dst").alias("there"), F.lit(False).alias("back")), F.struct(F.col("dst").alias("here"), F.col("src").alias("there"), F.lit(True).alias("back")))
    return edges.select(F.inline(ways))


def centralities(edges: DataFrame, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """id, centrality_in and centrality_out of each node of edges (src, dst): eigenvector centrality along edges and against them.

    Both vectors are of unit length and come from one power iteration, x + A'x from equal entries; a direction has
    settled when its entries moved by less than tol for each node, all told. It is null for all if it hasn't after max_iter rounds.
    Edges are laid out once, apart by direction and bucketed by the node they start from, and the vectors likewise, so that a round shuffles one
    partial sum for each node and task only, and looks entries up in a bucket of the vectors, which are few beside its edges and don't make them be sorted; the few nodes with very many edges are joined by broadcast. A direction that has
    settled is carried along as it is, and its edges aren't read any more. Norms are observed while a round is written, and so is
    the least that entries can have moved: only where that is little are they read once more.
    """
    spark = edges.sparkSession
    with scratch.Tables(spark) as tables:
        plain = cut_lineage(edges.select("src", "dst").distinct(), "plain-edges")
        # Rounds compare, hash and shuffle numbers, whatever the ids are. An edge counts at its ends if it has both.
        whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
        ends = plain.select(F.inline(F.array(*[F.struct(F.col(name).alias("name"), (whole & (c == "i")).alias("i"), (whole & (c == "o")).alias("o")) for name, c in (("dst", F.lit("i")), ("src", F.lit("o")))])))
        counted, told = ends.groupBy("name").agg(*[F.count_if(c).alias(c) for c in "io"]).withColumn("id", F.monotonically_increasing_id()), Observation()
        degree = F.col("i") + F.col("o")
        named = cut_lineage(counted.observe(told, F.count("*").alias("nodes"), F.sum(degree).alias("ends"), F.max(degree).alias("most")), "nodes")
        n, ends = told.get["nodes"], told.get["ends"]
        if not n:
            return named.select(F.col("name").alias("id"), F.lit(None).cast("double").alias("centrality_in"), F.lit(None).cast("double").alias("centrality_out"))
        number = [named.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst")]
        both = _directed(plain.join(number[0], "src").join(number[1], "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
        hubs = hot = None
        if told.get["most"] * HUBS > ends:
            hubs = F.broadcast(cut_lineage(named.where(degree * HUBS > ends).select(F.col("id").alias("here")), "hubs"))
            both = cut_lineage(both, "edges")
            hot = cut_lineage(both.join(hubs, "here"), "hub-edges")
            both = both.join(hubs, "here", "left_anti")
        cold = tables.bucketed(both, "here", dealt=False, apart=["back"])
        # In the first round, from equal entries, an edge brings 1 / n wherever it comes from.
        state = added = named.select("id", *[((1.0 + F.col(c)) / n).alias(c) for c in "io"], *[F.lit(1.0 / n).alias(f"was_{c}") for c in "io"])
        left, norm = ["i", "o"], {"i": 1.0, "o": 1.0}
        way, moved = {"i": ~F.col("back"), "o": F.col("back")}, lambda c, by: F.sum(F.abs(F.col(c) / by[c] - F.col(f"was_{c}")))
        for _ in range(max_iter):
            size, before = Observation(), norm
            seen = [y for c in left for y in (F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"norm_{c}"), F.sum(c).alias(f"sum_{c}"), moved(c, before).alias(f"moved_{c}"))]
            state = tables.bucketed(added.observe(size, *seen), "id")
            norm = {c: size.get[f"norm_{c}"] or 1.0 if c in left else 1.0 for c in "io"}
            # A round's norm is known when it is written; by the norm before, the movement is wrong by what the sum of entries allows at the most.
            near = [c for c in left if size.get[f"moved_{c}"] - size.get[f"sum_{c}"] * abs(1 / norm[c] - 1 / before[c]) < n * tol]
            if near:
                exact = state.agg(*[moved(c, norm).alias(c) for c in near]).first()
                left = [c for c in left if c not in near or not exact[c] < n * tol]
            if not left:
                break
            x = state.select("id", *[(F.col(c) / norm[c]).alias(c) for c in "io"])
            sent = x.select(F.col("id").alias("here"), *left)
            met = [(cold, sent.hint("shuffle_hash"))] + ([(hot, F.broadcast(sent.join(hubs, "here", "left_semi")))] if hubs is not None else [])
            gains = [(links if len(left) == 2 else links.where(way[left[0]])).join(values, "here").select(F.col("there").alias("id"), *[F.when(way[c], F.col(c)).alias(f"gain_{c}") for c in left]) for links, values in met]
            gained = (gains[0] if hubs is None else gains[0].unionByName(gains[1])).groupBy("id").agg(*[F.sum(f"gain_{c}").alias(f"gain_{c}") for c in left])
            added = x.join(gained.hint("shuffle_hash"), "id", "left").select("id", *[(F.col(c) + F.coalesce(f"gain_{c}", F.lit(0.0)) if c in left else F.col(c)).alias(c) for c in "io"], *[F.col(c).alias(f"was_{c}") for c in left])
        done = tables.kept(state)
    found = [(F.lit(None).cast("double") if c in left else F.col(c) / norm[c]).alias(name) for c, name in (("i", "centrality_in"), ("o", "centrality_out"))]
    return named.select("id", "name").join(done.select("id", *found), "id").select(F.col("name").alias("id"), "centrality_in", "centrality_out")


def frontier(papers: DataFrame, forbidden: DataFrame) -> DataFrame:
    return papers.where(~F.col("selected") & ~F.col("processed")).join(forbidden.select("paperId"), "paperId", "left_anti")


def bypass_threshold(rows: DataFrame, decay: float, order: str = "paperId") -> DataFrame:
    """exp(-decay * position). Positions over a global order come from counts of ranges, not from one task."""
    # Written once, as a range's number must be the same where ranges are counted and where their rows are.
    spans = cut_lineage(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "spans")
    sizes = spans.groupBy("part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    at = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return spans.withColumn("own", at).join(F.broadcast(before.select("part", "before")), "part").withColumn("position", F.col("own") + F.col("before")).withColumn("threshold", F.exp(-decay * F.col("position"))).drop("part", "own", "before")


def weights(rows: DataFrame, decay: float, as_of_year: int) -> DataFrame:
    """exp(-decay * age) * the larger centrality, made to sum to 1. rows are made once and written, as they are counted, summed and weighed."""
    told = Observation()
    rows = cut_lineage(rows.observe(told, F.count("*").alias("n")), "weighed")
    low = F.lit(1e-5 / (told.get["n"] + 1))
    c = F.greatest(F.coalesce("c_in", low), F.coalesce("c_out", low))
    raw = F.exp(-decay * (as_of_year - F.col("year"))) * c
    w = rows.withColumn("w", F.when(raw > 0, raw).otherwise(F.lit(1e-50)))
    return w.crossJoin(w.agg(F.sum("w").alias("total"))).withColumn("weight", F.col("w") / F.col("total")).drop("w", "total")  # one row on the right


def sample(rows: DataFrame, k: int, seed: int, key: str = "paperId", weight: str = "weight") -> DataFrame:
    """k rows without replacement, by exponential keys; the draw depends on key and seed alone."""
    return rows.orderBy(-F.log(unit(F.col(key), seed)) / F.col(weight), key).limit(k)


def unit(key: Column, seed: int) -> Column:
    """A number between 0 and 1 that depends on key and seed alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(seed)))), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def split(rows: DataFrame, passes: Column, seed: int, key: str = "paperId") -> DataFrame:
    """Rows whose draw is under their threshold, and of the others those that pass."""
    return rows.where((unit(F.col(key), seed) < F.col("threshold")) | F.coalesce(passes, F.lit(False)))


def sampling_round(papers: DataFrame, forbidden: DataFrame, centralities: DataFrame, passes: Column, venue_ok: Column, *, decay: float, age_decay: float, as_of_year: int, k: int, seed: int) -> DataFrame:
    """papers with selected set for those that this round draws: frontier, threshold and split, venue, weights, sample."""
    rows = split(bypass_threshold(frontier(papers, forbidden), decay), passes, seed).where(venue_ok)
    known = rows.join(centralities, "paperId", "left").select("paperId", "year", "c_in", "c_out")
    drawn = sample(weights(known, age_decay, as_of_year), k, seed)
    on = drawn.select("paperId", F.lit(True).alias("__on"))
    return papers.join(on, "paperId", "left").withColumn("selected", F.col("selected") | F.coalesce("__on", F.lit(False))).drop("__on")


def property_graph(papers: DataFrame, references: DataFrame, citations_in: DataFrame, paper_author: DataFrame, authors: DataFrame) -> DataFrame:
    """JSON lines of nodes (paper, venue, author) and relationships (PUBLISHED_BY, AUTHORED_BY, CITE).

    Relationships have ids without gaps, from 0 in the order of label, start and end: they are sorted over all partitions, whose sizes say
    where each begins to count. A venue's id is the md5 of its trimmed lower-case name; authors without a name and ends
    that are no papers of the graph give no relationship; a paper without id or title is none.
    """
    js = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    node = lambda id_, label, **properties: js(type=F.lit("node"), id=id_, labels=F.array(F.lit(label)), properties=F.struct(*[v.alias(k) for k, v in properties.items()])).alias("value")
    known = papers.where((F.coalesce("paperId", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).dropDuplicates(["paperId"])
    place = F.lower(F.trim("venue"))
    venues = known.where(meaningful_venue(F.col("venue"))).select("paperId", place.alias("venue"), F.md5(place).alias("venue_id"))
    named = paper_author.join(authors.where("authorName is not null").dropDuplicates(["authorId"]), "authorId").join(known.select("paperId"), "paperId", "left_semi").distinct()
    nodes = known.select(node(F.col("paperId"), "paper", title=F.array("title"), year=F.col("year"), processed=F.col("processed"))).unionByName(venues.select("venue_id", "venue").distinct().select(node(F.col("venue_id"), "venue", venue=F.col("venue")))).unionByName(named.select("authorId", "authorName").distinct().select(node(F.col("authorId"), "author", name=F.col("authorName"))))
    ends = known.select("paperId")
    cites = references.select(F.col("paperId").alias("start"), F.col("referencePaperId").alias("end")).unionByName(citations_in.select(F.col("citingPaperId").alias("start"), F.col("paperId").alias("end")))
    for c in ("start", "end"):
        cites = cites.join(ends.select(F.col("paperId").alias(c)), c, "left_semi")
    edge = lambda df, label, start, end, kind: df.select(F.lit(label).alias("label"), F.col(start).alias("start"), F.col(end).alias("end"), F.lit(kind).alias("kind"))
    links = edge(venues, "PUBLISHED_BY", "paperId", "venue_id", "venue").unionByName(edge(named, "AUTHORED_BY", "paperId", "authorId", "author")).unionByName(edge(cites, "CITE", "start", "end", "paper"))
    end = lambda c, kind: F.struct(F.col(c).alias("id"), F.array(kind).alias("labels"))
    told = scratch.numbered(links, ["label", "start", "end"], "n").select(js(type=F.lit("relationship"), id=F.col("n").cast("string"), label=F.col("label"), start=end("start", F.lit("paper")), end=end("end", F.col("kind"))).alias("value"))
    return nodes.unionByName(told)
