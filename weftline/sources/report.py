"""Readable lines of plans, graphs, candidates and workflows, as DataFrames of (prompt_id, at, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_lines(order: DataFrame) -> DataFrame:
    """order: plan_id, id, position."""
    return order.select(F.col("plan_id").alias("prompt_id"), F.col("position").alias("at"), F.format_string("%d. %s", F.col("position").cast("int"), F.col("id")).alias("line"))


def candidate_lines(candidates: DataFrame) -> DataFrame:
    text = F.format_string("step %d, %d: %s (%s, %.3f, %s)", F.col("step_index").cast("int"), F.col("rank").cast("int"), "name", "node_type", "score", "source")
    return candidates.select("prompt_id", (F.col("step_index") * 1000 + F.col("rank")).alias("at"), text.alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select("prompt_id", F.xxhash64("source", "target").alias("at"), F.concat("source", F.lit(" -"), "relation", F.lit("-> "), "target").alias("line"))


def summary_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by type and of edges by relation."""
    n = nodes.groupBy(F.col("node_type").alias("k")).agg(F.count("*").alias("n")).select(F.lit(0).alias("prompt_id"), F.lit(0).alias("at"), F.concat(F.lit("nodes "), "k", F.lit(": "), "n").alias("line"))
    e = edges.groupBy(F.col("relation").alias("k")).agg(F.count("*").alias("n")).select(F.lit(0).alias("prompt_id"), F.lit(1).alias("at"), F.concat(F.lit("edges "), "k", F.lit(": "), "n").alias("line"))
    return n.unionByName(e)


def workflow_lines(documents: DataFrame) -> DataFrame:
    node = documents.select("prompt_id", F.posexplode("Nodes").alias("at", "n"))
    found = F.when(F.col("n.FunctionDetails.Found"), F.concat(F.lit(" = "), F.col("n.FunctionDetails.FunctionName"))).otherwise(" (no function)")
    return node.select("prompt_id", "at", F.concat(F.col("n.Name"), found).alias("line"))


def weighted_edge_lines(edges: DataFrame) -> DataFrame:
    """edges: prompt_id, source, target, relation, edge_type, weight, classification."""
    text = F.format_string("%s -%s-> %s (%s, weight %s, %s)", "source", "relation", "target", F.coalesce("edge_type", F.lit("?")), F.coalesce(F.col("weight").cast("string"), F.lit("?")), F.coalesce("classification", F.lit("?")))
    return edges.select("prompt_id", F.xxhash64("source", "relation", "target").alias("at"), text.alias("line"))


def selection_lines(beams: DataFrame, candidates: DataFrame) -> DataFrame:
    """What the best beam chose for each step, and where it came from."""
    chosen = beams.where("beam_rank = 1").select("prompt_id", F.explode("selection").alias("s")).select("prompt_id", "s.step_index", "s.node_id", "s.name")
    why = candidates.select("prompt_id", "step_index", "node_id", "prompt_text", "source")
    text = F.concat(F.coalesce("prompt_text", F.lit("")), F.lit(" -> "), F.coalesce("name", F.lit("")), F.lit(" (source "), F.coalesce("source", F.lit("unknown")), F.lit(")"))
    return chosen.join(why, ["prompt_id", "step_index", "node_id"], "left").select("prompt_id", F.col("step_index").alias("at"), text.alias("line"))


def order_lines(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """The execution order by names. order: prompt_id, node_id, position; nodes: prompt_id, node_id, name."""
    named = order.join(nodes.select("prompt_id", "node_id", "name"), ["prompt_id", "node_id"], "left")
    return named.select("prompt_id", F.col("position").alias("at"), F.coalesce("name", "node_id").alias("line"))
