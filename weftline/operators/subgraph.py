"""Contextual subgraphs of an action plan: validate, expand, reconnect along shortest paths. A merged path can connect later pairs, so these go in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from . import traverse as T

RADIUS, MAX_PATH = 1, 4


def is_executable(executable: Column) -> Column:
    """Nodes without the flag are executable."""
    return F.coalesce(executable, F.lit(True))


def split_actions(actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates of each action split in supported and unsupported; an action is invalid if it has some, but none supported.

    actions: ordinal, prompt_node_id, prompt_text, candidates (domain_node_id, domain_node_name, similarity), prompt_id if there are several plans; nodes: id, executable."""
    keys = [c for c in ("prompt_id", "ordinal", "prompt_node_id") if c in actions.columns]
    flat = actions.select(*keys, F.posexplode_outer("candidates").alias("rank", "c"))
    n = nodes.select(F.col("id").alias("_id"), is_executable(F.col("executable")).alias("_x"))
    ok = flat.join(n, F.col("c.domain_node_id") == F.col("_id"), "left").withColumn("ok", F.coalesce("_x", F.lit(False)))
    side = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull() & keep, F.struct("rank", "c")))), lambda x: x["c"])
    out = ok.groupBy(*keys).agg(side(F.col("ok")).alias("supported"), side(~F.col("ok")).alias("unsupported"))
    return out.withColumn("invalid", (F.size("unsupported") > 0) & (F.size("supported") == 0))


def candidate_pairs(split: DataFrame) -> DataFrame:
    """Candidates of consecutive actions that have any, each with each, but no node with itself."""
    by = [c for c in ("prompt_id",) if c in split.columns]
    kept = split.where(F.size("supported") > 0)
    at = kept.withColumn("next", F.lead("supported").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("ordinal"))).where("next IS NOT NULL")
    pairs = at.select(*by, "ordinal", F.posexplode("supported").alias("i", "a"), "next").select(*by, "ordinal", "i", F.col("a.domain_node_id").alias("source"), F.posexplode("next").alias("j", "b"))
    return pairs.select(*by, "ordinal", "i", "j", "source", F.col("b.domain_node_id").alias("target")).where("source <> target")


def reconnect(edges: DataFrame, sub_nodes: DataFrame, sub_edges: DataFrame, pairs: DataFrame, by: str, max_path: int = MAX_PATH) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Merge the best path of each pair that the subgraph does not connect yet; the globally best path is taken, and only then rejected for its length or a deprecated edge.

    Pairs are those of one plan (bounded by its actions' candidates), so they are driver rows. Merged edges join only ends of pairs and nodes of their paths;
    what the subgraph connects among these is asked once, and the order of merges is followed on that closure."""
    wanted = [(r.source, r.target) for r in pairs.orderBy("ordinal", "i", "j").collect()]
    report: list[dict] = []
    if not wanted:
        return sub_nodes, sub_edges, report
    spark = edges.sparkSession
    ends = "source string, target string"
    best = {(r.source, r.target): r for r in T.shortest_paths(edges, None, by, pairs=spark.createDataFrame(wanted, ends)).collect()}
    on_paths = sorted({e for r in best.values() for e in zip(r.path, r.path[1:])})
    old = edges.where(T.deprecated(F.col("edge_type"))).join(spark.createDataFrame(on_paths, ends), ["source", "target"], "left_semi") if on_paths else None
    bad = {(r.source, r.target) for r in old.select("source", "target").distinct().collect()} if old is not None else set()

    def reason(pair):
        r = best.get(pair)
        if r is None:
            return "no path"
        return f"path too long: {r.hops} hops" if r.hops > max_path else "path uses a deprecated edge" if any(e in bad for e in zip(r.path, r.path[1:])) else None

    verdict = {p: reason(p) for p in wanted}
    places = {n for p in wanted for n in p} | {n for p, why in verdict.items() if why is None for n in best[p].path}
    at = spark.createDataFrame([(n,) for n in sorted(places)], "id string")
    joined = T.reachable(sub_edges, at).join(at.withColumnRenamed("id", "target"), "target", "left_semi")
    leads: dict[str, set[str]] = {n: set() for n in places}
    for r in joined.collect():
        leads[r.source].add(r.target)

    def connected(s, t):
        seen, todo = {s}, [s]
        while todo:
            new = leads[todo.pop()] - seen
            seen |= new
            todo += new
        return t in seen

    merged: list[tuple[str, str]] = []
    for s, t in wanted:
        if connected(s, t):
            continue
        r, why = best.get((s, t)), verdict[s, t]
        report.append({"source": s, "target": t, "path": r.path if r else None, "cost": r.cost if r else None, "reason": why})
        if why is None:
            for a, b in zip(r.path, r.path[1:]):
                merged.append((a, b))
                leads[a].add(b)
    if merged:
        m = spark.createDataFrame(merged, "source string, target string").distinct()
        sub_edges = sub_edges.unionByName(edges.join(F.broadcast(m), ["source", "target"], "left_semi").select(*sub_edges.columns)).distinct()
        sub_nodes = sub_nodes.union(m.select("source")).union(m.select("target")).distinct()
    return sub_nodes, sub_edges, report


def build(actions: DataFrame, nodes: DataFrame, edges: DataFrame, radius: int = RADIUS, max_path: int = MAX_PATH) -> dict:
    """Subgraph around a plan's actions, with what was rejected."""
    split = cut(split_actions(actions, nodes))
    seeds = split.select(F.explode("supported").alias("c")).select(F.col("c.domain_node_id").alias("id")).distinct()
    sub_nodes, sub_edges = T.induced(edges, seeds, max(0, radius))
    by = T.strategy(edges)
    sub_nodes, sub_edges, report = reconnect(edges, sub_nodes, sub_edges, candidate_pairs(split), by, max(1, max_path))
    return {"nodes": sub_nodes, "edges": sub_edges, "actions": split, "invalid": split.where("invalid"), "strategy": by, "connections": report, "seeds": seeds}


def match_paths(matches: DataFrame, prompt_edges: DataFrame, edges: DataFrame, by: str = "dijkstra") -> dict[str, DataFrame]:
    """Prompt edges onto domain paths; pairs without a path are reported, never invented; nodes in between are flagged inferred.

    matches: prompt_id, id, node_id, score, text (accepted ones); prompt_edges: prompt_id, source, target."""
    side = lambda s: matches.select("prompt_id", F.col("id").alias(s), F.col("node_id").alias(f"{s}_node"))
    want = prompt_edges.join(side("source"), ["prompt_id", "source"]).join(side("target"), ["prompt_id", "target"]).where("source_node <> target_node")
    paths = T.shortest_paths(edges, None, by, pairs=want.select(F.col("source_node").alias("source"), F.col("target_node").alias("target"))).select(F.col("source").alias("source_node"), F.col("target").alias("target_node"), "path", "cost", "hops")
    got = want.join(paths, ["source_node", "target_node"], "left")
    direct = matches.groupBy("prompt_id", "node_id").agg(F.max(F.struct("score", "text")).alias("best"), F.array_sort(F.collect_list("text")).alias("texts"), F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    direct = direct.select("prompt_id", "node_id", F.col("best.score").alias("score"), F.col("best.text").alias("text"), "texts", "ids", "n")
    on = got.where("path IS NOT NULL").select("prompt_id", F.explode("path").alias("node_id")).distinct()
    inner = on.join(direct.select("prompt_id", "node_id"), ["prompt_id", "node_id"], "left_anti").withColumn("inferred", F.lit(True))
    hops = got.where("path IS NOT NULL").select("prompt_id", F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("source"), F.expr("slice(path, 2, size(path) - 1)").alias("target"))).alias("e"))
    return {
        "nodes": direct.select("prompt_id", "node_id", F.lit(False).alias("inferred")).unionByName(inner),
        "merged": direct,
        "edges": hops.select("prompt_id", "e.source", "e.target").distinct(),
        "unreachable": got.where("path IS NULL").select("prompt_id", "source", "target"),
        "duplicates": direct.where("n > 1"),
    }


def best_matches(concepts: DataFrame, nodes: DataFrame, threshold: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(accepted, unmatched): each concept's first best node by raw cosine. concepts: prompt_id, id, text, query."""
    from . import candidates as C

    q = concepts.select(F.struct("prompt_id", "id").alias("step_id"), "text", "query")
    best = C.nearest(q, nodes.select("seq", F.col("id").alias("node_id"), "embedding"), 1, "step_id", "seq", ("query", "embedding")).select("step_id.*", "text", "node_id", "score")
    return best.where(F.col("score") >= threshold), best.where(F.col("score") < threshold)


def diagnostics(concepts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of concepts, nodes and nodes with a vector."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) > 0).alias("embedded"))
    return concepts.agg(F.count("*").alias("concepts")).withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").drop("_k")
