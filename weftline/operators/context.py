"""Context graphs: direct candidates, neighbourhood inference, dependencies, semantics. All prompts go together, keyed by prompt_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import relations as R
from ..functions import text as X
from ..functions import vectors as V
from ..lineage import cut
from . import candidates as C
from .ranking import first_wins, last_wins, top_k

NEIGHBOUR_THRESHOLD = 0.25


def direct_candidates(steps: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Client search, then re-scored by 0.45 semantic + 0.35 lexical + 0.20 client score; client_rank keeps the search's order.

    steps: prompt_id, step_index, text, explicit, query."""
    keyed = steps.withColumn("step_id", F.struct("prompt_id", "step_index"))
    found = C.candidate_nodes(keyed, nodes, k).select("step_id", "id", F.col("score").alias("client_score"), F.col("rank").alias("client_rank"))
    both = found.join(keyed.select("step_id", "text", "explicit", "query"), "step_id").join(nodes, "id")
    lexical = X.lexical_builder(F.col("text"), F.col("name"), F.col("aliases"), F.col("description"))
    semantic = V.cosine_builder(V.doubles(F.col("query")), V.doubles(F.col("embedding")))
    scored = both.withColumn("lexical_score", lexical).withColumn("semantic_score", semantic)
    scored = scored.withColumn("score", V.blend_direct(F.col("semantic_score"), F.col("lexical_score"), F.col("client_score")))
    return scored.select(
        "step_id.*", F.col("id").alias("node_id"), "name", "node_type", "score", "lexical_score", "semantic_score", "explicit", (~F.col("explicit")).alias("inferred"),
        F.lit("direct").alias("source"), F.col("text").alias("prompt_text"), F.lit(None).cast("double").alias("relation_score"), "client_rank",
    )


def neighbour_candidates(steps: DataFrame, direct: DataFrame, seeds_edges: DataFrame, nodes: DataFrame, threshold: float = NEIGHBOUR_THRESHOLD) -> DataFrame:
    """Neighbours of a step's direct candidates. In order of (seed rank, edge seq, endpoint) the first edge that passes the threshold adds a node and fixes its score.

    seeds_edges: seed, source, relation, target, seq."""
    d = direct.select("prompt_id", "step_index", F.col("node_id").alias("seed"), F.col("client_rank").alias("seed_rank"))
    ends = F.posexplode(F.array("source", "target")).alias("endpoint", "id")
    near = d.join(seeds_edges, "seed").select("prompt_id", "step_index", "seed_rank", "seq", "relation", ends)
    near = near.join(direct.select("prompt_id", "step_index", F.col("node_id").alias("id")), ["prompt_id", "step_index", "id"], "left_anti")
    near = first_wins(near, ["prompt_id", "step_index", "id", "relation"], ["seed_rank", "seq", "endpoint"])  # a score depends on these alone
    near = near.join(steps.select("prompt_id", "step_index", "text", "query"), ["prompt_id", "step_index"]).join(nodes.drop("seq"), "id")
    lexical = X.lexical_builder(F.col("text"), F.col("name"), F.col("aliases"), F.col("description"))
    semantic = V.cosine_builder(V.doubles(F.col("query")), V.doubles(F.col("embedding")))
    near = near.withColumn("lexical_score", lexical).withColumn("semantic_score", semantic).withColumn("relation_score", R.relevance(F.col("relation")))
    near = near.withColumn("score", V.blend_neighbour(F.col("semantic_score"), F.col("lexical_score"), F.col("relation_score"))).where(F.col("score") >= threshold)
    first = first_wins(near, ["prompt_id", "step_index", "id"], ["seed_rank", "seq", "endpoint"])
    return first.select(
        "prompt_id", "step_index", F.col("id").alias("node_id"), "name", "node_type", "score", "lexical_score", "semantic_score", F.lit(False).alias("explicit"), F.lit(True).alias("inferred"),
        F.lit("neighborhood").alias("source"), F.col("text").alias("prompt_text"), "relation_score", (1_000_000 * F.col("seed_rank") + 2 * F.col("seq") + F.col("endpoint")).alias("client_rank"),
    )


def merge_candidates(rows: DataFrame, k: int) -> DataFrame:
    """Per step one row a node, the best, explicit if any of them is; then the best max(2k, 10), earlier rows first on ties."""
    keys = ["prompt_id", "step_index", "node_id"]
    explicit = rows.groupBy(*keys).agg(F.bool_or("explicit").alias("_e"))
    best = first_wins(rows, keys, [F.col("score").desc(), F.col("source"), F.col("client_rank")]).join(explicit, keys)
    best = best.withColumn("explicit", F.col("_e")).withColumn("inferred", ~F.col("_e") | (F.col("source") != "direct")).drop("_e")
    return top_k(best, ["prompt_id", "step_index"], [F.col("score").desc(), F.col("source"), F.col("client_rank")], max(2 * k, 10)).drop("client_rank")


def context_edges(domain: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One edge for each ordered pair, the last one written; dependencies come after domain edges, and semantics are added.

    domain: prompt_id, source, target, relation, seq; dependencies: prompt_id, source, target, seq."""
    d = domain.select("prompt_id", "source", "target", "relation", F.lit("domain").alias("origin"), F.struct(F.lit(0).alias("late"), F.col("seq").cast("long").alias("seq")).alias("seq"))
    p = dependencies.select("prompt_id", "source", "target", F.lit("PROMPT_DEPENDENCY").alias("relation"), F.lit("prompt").alias("origin"), F.struct(F.lit(1).alias("late"), F.col("seq").cast("long").alias("seq")).alias("seq"))
    return R.annotate(last_wins(d.unionByName(p), ["prompt_id", "source", "target"]))


def inferred_nodes(context_nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Context nodes that are no direct candidate, with their best score or 0, best first."""
    direct = candidates.where("source = 'direct'").select("prompt_id", "node_id")
    best = candidates.groupBy("prompt_id", "node_id").agg(F.max("score").alias("best"))
    out = context_nodes.join(direct, ["prompt_id", "node_id"], "left_anti").join(best, ["prompt_id", "node_id"], "left")
    return out.select("prompt_id", "node_id", "name", F.coalesce("best", F.lit(0.0)).alias("score"), F.lit(True).alias("inferred")).orderBy("prompt_id", F.col("score").desc(), "node_id")


def build(steps: DataFrame, dependencies: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 5, depth: int = 1) -> dict[str, DataFrame]:
    """Everything the planner needs: candidates, nodes and edges of the context graph, inferred nodes."""
    from .traverse import neighbourhood

    direct = cut(direct_candidates(steps, nodes, k))
    seeds = direct.select(F.col("node_id").alias("id")).distinct()
    known = nodes.select("id")
    whole = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    near = cut(neighbourhood(whole, seeds, depth).join(whole.groupBy("source", "relation", "target").agg(F.min("seq").alias("seq")), ["source", "relation", "target"]))
    cands = merge_candidates(direct.unionByName(neighbour_candidates(steps, direct, near, nodes)), k)
    mine = direct.select("prompt_id", F.col("node_id").alias("seed")).distinct().join(near, "seed")
    deps = C.resolve_dependencies(dependencies, steps, cands)
    ctx_edges = context_edges(mine.select("prompt_id", "source", "target", "relation", "seq"), deps)
    ids = direct.select("prompt_id", "node_id").union(mine.select("prompt_id", "source")).union(mine.select("prompt_id", "target")).distinct()
    ctx_nodes = ids.join(nodes.select(F.col("id").alias("node_id"), "name", "node_type", "description", "aliases", "seq"), "node_id")
    return {"candidates": cands, "nodes": ctx_nodes, "edges": ctx_edges, "inferred": inferred_nodes(ctx_nodes, cands)}
