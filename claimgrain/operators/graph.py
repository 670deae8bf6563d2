"""Property graph as two tables, with neighbour and bounded-path queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.session import remove_folder, stored, stored_at

MAX_PATHS = 5


def complete_triples(triples: DataFrame) -> DataFrame:
    """Trimmed triples with all three parts present and defaults filled in."""
    trimmed = triples
    for c in ("subject", "relation", "object"):
        trimmed = trimmed.withColumn(c, F.trim(F.col(c)))
    present = (F.col("subject") != "") & (F.col("relation") != "") & (F.col("object") != "")
    return (trimmed.filter(present)
            .withColumn("evidence_tier", F.coalesce("evidence_tier", F.lit(3)))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
            .withColumn("source_chunk_id", F.coalesce("source_chunk_id", F.lit("")))
            .withColumn("subject_type", F.coalesce("subject_type", F.lit("unknown")))
            .withColumn("object_type", F.coalesce("object_type", F.lit("unknown"))))


def build_edges(triples: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge per (src, dst): the last triple in ``seq`` order wins.

    max_by combines before the shuffle, so a pair repeated in a third of all triples is
    one row per task by the time it is exchanged.
    """
    attrs = F.struct("relation", "evidence_tier", "source_chunk_id", "confidence")
    return (complete_triples(triples)
            .groupBy(F.col("subject").alias("src"), F.col("object").alias("dst"))
            .agg(F.max_by(attrs, F.col(seq)).alias("a")).select("src", "dst", "a.*"))


def build_nodes(triples: DataFrame, seq: str = "seq") -> DataFrame:
    """Every subject and object with the type it was given last (object after subject)."""
    both = F.array(
        F.struct(F.col("subject").alias("id"), F.col("subject_type").alias("entity_type"),
                 F.lit(0).alias("side")),
        F.struct(F.col("object").alias("id"), F.col("object_type").alias("entity_type"),
                 F.lit(1).alias("side")))
    ends = complete_triples(triples).select(F.col(seq).alias("seq"), F.inline(both))
    return ends.groupBy("id").agg(
        F.max_by("entity_type", F.struct("seq", "side")).alias("entity_type"))


def graph_counts(triples: DataFrame) -> DataFrame:
    """Number of nodes, edges and complete triples, from one scan of the triples."""
    item = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    subject, object_, none = F.col("subject"), F.col("object"), F.lit("")
    items = F.array(item("edges", subject, object_), item("nodes", subject, none),
                    item("nodes", object_, none))
    distinct = (complete_triples(triples).select(F.inline(items))
                .groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    return distinct.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))


def neighbors(edges: DataFrame, entities: DataFrame, relation: str | None = None) -> DataFrame:
    """Outgoing and incoming edges of each entity; a self-loop appears in both.

    Every edge becomes its two directed rows, so edges are read once and joined once."""
    if relation is not None:
        edges = edges.filter(F.col("relation") == relation)
    side = lambda own, other, name: F.struct(
        F.col(own).alias("entity"), F.col(other).alias("neighbor"), F.lit(name).alias("direction"))
    directed = edges.select(
        F.inline(F.array(side("src", "dst", "outgoing"), side("dst", "src", "incoming"))),
        "relation", "evidence_tier", "confidence")
    return directed.join(entities.select("entity").distinct(), "entity", "left_semi")


def contraindications(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return neighbors(edges, entities, dims.CONTRAINDICATION)


def _keep_first(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows of each group; cut per task before the shuffle, then finally."""
    window = Window.partitionBy(*by).orderBy(*order)
    return (rows.withColumn("_pos", F.row_number().over(window))
            .filter(F.col("_pos") <= limit).drop("_pos"))


def _meet(pairs: DataFrame, heads: DataFrame, ends: DataFrame) -> DataFrame:
    """``heads(source, y, ...)`` and ``ends(target, y, ...)`` of each pair that share ``y``.

    A pair is expanded from its smaller side and the other side is met on the full key, so its
    rows are the smaller of the two lists and a hub's many heads are not multiplied by its
    targets. A pair with an empty side has no rows.
    """
    h = heads.groupBy("source").agg(F.count(F.lit(1)).alias("_heads"))
    e = ends.groupBy("target").agg(F.count(F.lit(1)).alias("_ends"))
    sized = pairs.join(h, "source").join(e, "target")
    from_heads = (sized.filter("_heads <= _ends").select("source", "target")
                  .join(heads, "source").join(ends, ["target", "y"]))
    from_ends = (sized.filter("_heads > _ends").select("source", "target")
                 .join(ends, "target").join(heads, ["source", "y"]))
    return from_heads.unionByName(from_ends)


def evidence_paths(edges: DataFrame, pairs: DataFrame, limit: int = MAX_PATHS) -> DataFrame:
    """Directed simple paths of at most four edges, shortest first, ``limit`` per pair.

    Built in rising length; a pair with enough short paths is left out of the longer joins.
    Longer paths are a head source -> x -> y and a tail y -> z -> target that share y. Heads
    are made once per source and tails once per target, and both keep only the first
    ``limit + 2`` middle nodes per end node. That is exact: a path using a later middle node
    can swap it for any kept one except the at most two that already occur in the path, so
    at least ``limit`` paths come before it. Pairs meet heads and tails from the smaller side
    (``_meet``), so a hub with a third of all edges adds a bounded list per node. What several
    lengths read (links, heads, the paths so far) is written once.
    """
    pair = ["source", "target"]
    links = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "links")
    into = links.select(F.col("src").alias("y"), F.col("dst").alias("target"))
    wanted = stored(pairs.select(*pair).filter("source <> target").distinct(), "pairs")

    def short_of(found: DataFrame) -> DataFrame:
        enough = (found.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") >= limit).select(*pair))
        return wanted.join(enough, pair, "left_anti")

    def first_paths(rows: DataFrame, *nodes: str) -> DataFrame:
        return _keep_first(rows.select(*pair, F.array(*nodes).alias("path")), pair, ["path"], limit)

    one = wanted.join(into.withColumnRenamed("y", "source"), pair).select(
        *pair, F.array(*pair).alias("path"))

    first_hop = wanted.select("source").distinct().join(
        links, F.col("source") == F.col("src")).select("source", F.col("dst").alias("x"))
    heads = stored(_keep_first(
        first_hop.join(links, F.col("x") == F.col("src")).filter("dst <> source")
        .select("source", "x", F.col("dst").alias("y")), ["source", "y"], ["x"], limit + 2), "heads")
    two = first_paths(wanted.join(heads.withColumnRenamed("y", "target"), pair),
                      "source", "x", "target")

    upto2 = stored(one.unionByName(two), "paths")
    three = first_paths(_meet(short_of(upto2), heads, into).filter("x <> target"),
                        "source", "x", "y", "target")

    three = stored(three, "paths")
    upto3 = upto2.unionByName(three)
    need4 = stored(short_of(upto3), "pairs")
    last_hop = need4.select("target").distinct().join(into, "target").select(
        "target", F.col("y").alias("z"))
    tails = _keep_first(
        last_hop.join(links, F.col("z") == F.col("dst")).filter("src <> target")
        .select("target", F.col("src").alias("y"), "z"), ["target", "y"], ["z"], limit + 2)
    tail_lists = tails.groupBy("target", "y").agg(F.array_sort(F.collect_list("z")).alias("zs"))
    usable = F.slice(F.filter("zs", lambda z: (z != F.col("x")) & (z != F.col("source"))), 1, limit)
    meet = (_meet(need4, heads, tail_lists).filter("x <> target and y <> target")
            .withColumn("zs", usable).filter(F.size("zs") > 0))
    four = first_paths(
        _keep_first(meet, pair, ["x", "y"], limit)
        .select(*pair, "x", "y", F.explode("zs").alias("z")), "source", "x", "y", "z", "target")

    ranked = Window.partitionBy(*pair).orderBy("hops", "path")
    return (upto3.unionByName(four).withColumn("hops", F.size("path") - 1)
            .withColumn("path_rank", F.row_number().over(ranked))
            .filter(F.col("path_rank") <= limit))


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edges as JSON lines with source, target and attributes."""
    return edges.select(F.to_json(F.struct(
        F.col("src").alias("source"), F.col("dst").alias("target"), "relation",
        "evidence_tier", "source_chunk_id", "confidence")).alias("value"))


def supports(edges: DataFrame) -> DataFrame:
    """``id, entity``: the chunks that edges rest on, and the entities of those edges."""
    return edges.filter("source_chunk_id <> ''").select(
        F.col("source_chunk_id").alias("id"),
        F.explode(F.array("src", "dst")).alias("entity")).distinct()


def expand_hits(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks reached through the graph from each query's hits, without a similarity.

    hit chunk -> entities of the edges it supports -> all edges of those entities -> the
    chunks supporting them. Deduplicated after each step, so a hub entity is visited once
    per query however many hits lead to it.
    """
    ends = edges.filter("source_chunk_id <> ''").select(
        "source_chunk_id", F.explode(F.array("src", "dst")).alias("entity"))
    reached = (hits.select("query_id", "chunk_id")
               .join(ends, F.col("chunk_id") == F.col("source_chunk_id"))
               .select("query_id", "entity").distinct())
    return (reached.join(ends.distinct(), "entity")
            .select("query_id", F.col("source_chunk_id").alias("chunk_id")).distinct())


# ---- scores that spread over the graph ---------------------------------------------------------

def personalised_rank(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, tolerance: float = 1e-4,
                      max_rounds: int = 200) -> DataFrame:
    """``query_id, node, score, missing``: how often a walk from a query's seeds is at each node.

    ``seeds(query_id, node, weight)``: a walk begins at a seed by weight, goes back with probability
    ``restart`` and else along an out-edge of ``edges(src, dst)``, each alike; it ends where there is
    none. Scores are pushed: a node with more than ``tolerance`` of unsettled weight per out-edge
    settles its restart share and hands on the rest, for all queries at once, round by round. A score
    is never above the true one and at most ``missing`` below it; that is what the query left
    unsettled, ``tolerance`` times the edges of the nodes it reached at most.

    Repeated edges count once. Weights that are null or not above 0, and null queries and nodes,
    take no part. Only nodes with unsettled weight meet their edges, and the flows into a node add
    up before the shuffle, so a hub costs its edges once per round and query. A round's table
    replaces the last one in the work folder.
    """
    spark = edges.sparkSession
    links = stored(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "links")
    degrees = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    known = seeds.filter("query_id IS NOT NULL AND node IS NOT NULL AND weight > 0")
    total = known.groupBy("query_id").agg(F.sum("weight").alias("total"))
    begun = (known.groupBy("query_id", "node").agg(F.sum("weight").alias("w")).join(total, "query_id")
             .join(degrees, "node", "left").select(
                 "query_id", "node", F.coalesce("degree", F.lit(0)).alias("degree"),
                 F.lit(0.0).alias("score"), (F.col("w") / F.col("total")).alias("open")))
    state, path = stored_at(begun, "rank")
    unsettled = F.col("open") > tolerance * F.greatest("degree", F.lit(1))
    for _ in range(max_rounds):
        if state.filter(unsettled).isEmpty():
            break
        active = state.filter(unsettled)
        share = F.when(F.col("degree") > 0, restart).otherwise(1.0)
        flows = (active.filter("degree > 0").join(links, F.col("node") == F.col("src"))
                 .groupBy("query_id", F.col("dst").alias("node"))
                 .agg(F.sum((1 - restart) * F.col("open") / F.col("degree")).alias("open"))
                 .join(degrees, "node", "left")
                 .select("query_id", "node", F.coalesce("degree", F.lit(0)).alias("degree"),
                         F.lit(0.0).alias("score"), "open"))
        settled = state.select(
            "query_id", "node", "degree",
            (F.col("score") + F.when(unsettled, share * F.col("open")).otherwise(0.0)).alias("score"),
            F.when(unsettled, F.lit(0.0)).otherwise(F.col("open")).alias("open"))
        merged = settled.unionByName(flows).groupBy("query_id", "node").agg(
            F.max("degree").alias("degree"), F.sum("score").alias("score"), F.sum("open").alias("open"))
        last, (state, path) = path, stored_at(merged, "rank")
        remove_folder(spark, last)
    missing = state.groupBy("query_id").agg(F.sum("open").alias("missing"))
    return (state.filter("score > 0").join(missing, "query_id")
            .select("query_id", "node", "score", "missing"))


def spread_relevance(hits: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """``query_id, id, relevance`` of the chunks that the graph leads to from each query's hits.

    The entities of a hit's edges are the query's seeds, by the hit's similarity (negative ones count
    nothing). A chunk's relevance is the rank of its best entity as a share of the query's highest
    rank, so it lies between 0 and 1. ``options`` go to ``personalised_rank``; walks use edges in both
    directions.
    """
    ends = supports(edges)
    seeds = (hits.join(ends, "id").groupBy("query_id", F.col("entity").alias("node"))
             .agg(F.sum("similarity").alias("weight")))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ranks = personalised_rank(both, seeds, **options)
    highest = ranks.groupBy("query_id").agg(F.max("score").alias("highest"))
    return (ranks.join(highest, "query_id").join(ends, F.col("node") == F.col("entity"))
            .groupBy("query_id", "id").agg(F.max(F.col("score") / F.col("highest")).alias("relevance")))
