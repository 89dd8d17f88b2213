"""Graph traversal by joins. Edges: source, target and whatever else; every loop's depth is a parameter or ends at a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .ranking import first_wins


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops) within `depth` undirected hops; the frontier alone is joined at each level."""
    links = undirected(edges)
    seen = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("hops", F.lit(0))
    for d in range(1, depth + 1):
        front = seen.where(F.col("hops") == d - 1).join(links, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
        seen = seen.union(front.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(d)))
        if d < depth:
            seen = cut(seen)
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Edges within `depth` (1 at least) undirected hops of each seed, direction kept: those incident to nodes at most depth - 1 away."""
    inner = reach(edges, seeds, max(1, int(depth)) - 1).select("seed", "id")
    cols = [c for c in ("source", "relation", "target") if c in edges.columns]
    out = edges.join(inner, F.col("id") == F.col("source")).select("seed", *cols)
    back = edges.join(inner, F.col("id") == F.col("target")).select("seed", *cols)
    return out.union(back).distinct()


def induced(edges: DataFrame, seeds: DataFrame, radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within `radius` of any seed, and the edges among them that are not deprecated."""
    links = undirected(edges)
    nodes = seeds.select("id").distinct()
    for _ in range(radius):
        more = nodes.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id"))
        nodes = nodes.union(more).distinct()
    kept = edges.where(~deprecated(F.col("edge_type"))) if "edge_type" in edges.columns else edges
    kept = kept.join(nodes.withColumnRenamed("id", "source"), "source", "left_semi").join(nodes.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, kept


def deprecated(edge_type):
    return F.lower(F.coalesce(edge_type, F.lit(""))) == "deprecated"


def strategy(edges: DataFrame) -> str:
    """'bfs' if all weights are equal, else 'dijkstra'; over the whole graph."""
    n = edges.agg(F.count_distinct(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))).first()[0]
    return "bfs" if n <= 1 else "dijkstra"


def shortest_paths(edges: DataFrame, sources: DataFrame | None, by: str = "dijkstra", targets: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(source, target, cost, hops, path) of the best directed path from each source to every node (or target) it reaches, or of the pairs (source, target) asked for.

    Cost is the weight (dijkstra) or the hops (bfs); ties by hops, then path. Frontiers are relaxed until nothing improves; paths are not bounded by length.
    With pairs, a path dearer than the dearest of its source's targets is not grown once all of them are reached, unless weights can be negative."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if by == "dijkstra" and "weight" in edges.columns else F.lit(1.0)
    step = cut(edges.select(F.col("source").alias("u"), F.col("target").alias("v"), w.alias("w")).groupBy("u", "v").agg(F.min("w").alias("w")))
    if pairs is not None:
        pairs = cut(pairs.select("source", "target").distinct())
        start, prune = pairs.select("source").distinct(), step.where("w < 0").isEmpty()
    else:
        start, prune = sources.select(F.col("id").alias("source")).distinct(), False
    best = cut(start.select("source", F.col("source").alias("target"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("source").alias("path")))
    front = best
    while True:
        grown = front.join(step, F.col("target") == F.col("u")).where(~F.array_contains("path", F.col("v")))
        grown = grown.select("source", F.col("v").alias("target"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("v")).alias("path"))
        every = best.withColumn("new", F.lit(False)).union(grown.withColumn("new", F.lit(True)))
        every = cut(first_wins(every, ["source", "target"], ["cost", "hops", "path", "new"]))
        front, best = every.where("new").drop("new"), every.drop("new")
        if prune:
            cost = best.select("source", "target", "cost")
            bound = pairs.join(cost, ["source", "target"], "left").groupBy("source").agg(F.when(F.count("cost") == F.count("*"), F.max("cost")).alias("bound"))
            front = front.join(bound, "source").where("bound IS NULL OR cost <= bound").drop("bound")
        if front.isEmpty():
            break
    best = best.where("hops > 0")
    best = best if pairs is None else best.join(pairs, ["source", "target"], "left_semi")
    return best.join(targets.select(F.col("id").alias("target")).distinct(), "target", "left_semi") if targets is not None else best


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, target): each seed (id) and every node that a directed path leads to from it; only the frontier is joined and written."""
    step = cut(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).distinct())
    front = cut(seeds.select(F.col("id").alias("source"), F.col("id").alias("target")).distinct())
    seen = front
    while not front.isEmpty():
        grown = front.join(step, F.col("target") == F.col("u")).select("source", F.col("v").alias("target")).distinct()
        front = cut(grown.join(seen, ["source", "target"], "left_anti"))
        seen = seen.union(front)
    return seen


def topological_order(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((plan_id, id, level, position) of nodes, (plan_id, source, target) of edges on or between cycles).

    Kahn's peel by levels. The first level is in node order; a later one is ordered by the place of a node's last parent in the level above,
    then by the edge's seq there. Nodes: plan_id, id, seq; edges: plan_id, source, target, seq. All plans are peeled together."""
    at = Window.partitionBy("plan_id")
    edges = cut(first_wins(edges.select("plan_id", "source", "target", "seq"), ["plan_id", "source", "target"], ["seq"]))
    indeg = edges.groupBy("plan_id", F.col("target").alias("id")).agg(F.count("*").alias("left"))
    rest = cut(nodes.select("plan_id", "id", "seq").join(indeg, ["plan_id", "id"], "left").fillna(0, ["left"]))
    front = rest.where("left = 0").withColumn("place", F.row_number().over(at.orderBy("seq"))).select("plan_id", "id", "place")
    front, rest, level, done = cut(front), rest.where("left > 0"), 0, None
    while not front.isEmpty():
        placed = front.withColumn("level", F.lit(level))
        done = placed if done is None else done.union(placed)
        hit = edges.join(front.withColumnRenamed("id", "source"), ["plan_id", "source"]).groupBy("plan_id", F.col("target").alias("id")).agg(F.count("*").alias("hit"), F.max(F.struct("place", "seq")).alias("last"))
        now = cut(rest.join(hit, ["plan_id", "id"], "left").withColumn("left", F.col("left") - F.coalesce("hit", F.lit(0))))
        front = now.where("left = 0").withColumn("place", F.row_number().over(at.orderBy("last.place", "last.seq", "seq"))).select("plan_id", "id", "place")
        rest = now.where("left > 0").select("plan_id", "id", "seq", "left")
        level += 1
    order = (done if done is not None else front.withColumn("level", F.lit(0))).withColumn("position", F.row_number().over(at.orderBy("level", "place"))).drop("place")
    on = edges.join(rest.select("plan_id", F.col("id").alias("source")), ["plan_id", "source"], "left_semi").join(rest.select("plan_id", F.col("id").alias("target")), ["plan_id", "target"], "left_semi")
    while True:  # nodes behind a cycle are no part of it
        alive = on.select("plan_id", F.col("source").alias("target")).distinct()
        now = cut(on.join(alive, ["plan_id", "target"], "left_semi").select("plan_id", "source", "target", "seq"))
        if now.count() == on.count():
            return order.select("plan_id", "id", "level", "position"), now.select("plan_id", "source", "target")
        on = now


class PlanningError(ValueError):
    """A workflow graph has a cycle; the message lists its edges."""


def plan_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    order, cycle = topological_order(nodes, edges)
    if not cycle.isEmpty():
        named = ", ".join(f"{r.source} -> {r.target}" for r in cycle.limit(20).collect())
        raise PlanningError(f"the workflow has a cycle: {named}")
    return order


def adjacency(edges: DataFrame, key: str = "source", other: str = "target") -> DataFrame:
    """(id, neighbours) in edge order; swap the names for the reverse lists."""
    return edges.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", other, "relation"))), lambda x: F.struct(x[other].alias("id"), x["relation"].alias("relation"))).alias("neighbours"))
