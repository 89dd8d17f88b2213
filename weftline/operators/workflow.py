"""Workflow documents from ordered nodes, edges and function matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import last_wins

NODE_TYPE, VERSION, DONE = "CustomNode", "1.0", "Done"


def node_ids(nodes: DataFrame, deterministic: bool = True) -> DataFrame:
    """Nodes with a workflow id: a hash of prompt and node, or random."""
    key = F.sha2(F.concat_ws("|", F.col("prompt_id").cast("string"), F.col("node_id")), 256)
    return nodes.withColumn("wid", key if deterministic else F.uuid())


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(prompt_id, source, relation, target) by workflow id.

    One target for each source and relation, the last edge's; a prompt without edges is connected in its nodes' order; nodes without a way out end in 'Done'.
    nodes: prompt_id, node_id, wid, position; edges: prompt_id, source, target, relation, seq."""
    n = lambda s: nodes.select("prompt_id", F.col("node_id").alias(s), F.col("wid").alias(f"{s}_wid"))
    e = edges.join(n("source"), ["prompt_id", "source"]).join(n("target"), ["prompt_id", "target"])
    e = e.select("prompt_id", F.col("source_wid").alias("source"), F.coalesce("relation", F.lit("success")).alias("relation"), F.col("target_wid").alias("target"), "seq")
    made = last_wins(e, ["prompt_id", "source", "relation"]).drop("seq")
    after = F.lead("wid").over(Window.partitionBy("prompt_id").orderBy("position"))
    line = nodes.join(made.select("prompt_id").distinct(), "prompt_id", "left_anti").select("prompt_id", F.col("wid").alias("source"), F.lit("success").alias("relation"), after.alias("target"))
    made = made.unionByName(line.where("target IS NOT NULL"))
    ends = nodes.select("prompt_id", F.col("wid").alias("source")).join(made.select("prompt_id", "source").distinct(), ["prompt_id", "source"], "left_anti")
    return made.unionByName(ends.select("prompt_id", "source", F.lit("success").alias("relation"), F.lit(DONE).alias("target")))


def inputs(nodes: DataFrame) -> DataFrame:
    """(prompt_id, inputs): distinct inputs of matched functions in the order they are first seen."""
    each = nodes.where("found").select("prompt_id", "position", F.posexplode("inputs").alias("at", "name"))
    first = each.groupBy("prompt_id", "name").agg(F.min(F.struct("position", "at")).alias("first"))
    return first.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("inputs"))


def documents(nodes: DataFrame, edges: DataFrame, name: str = "Generated Workflow") -> DataFrame:
    """One nested workflow for each prompt.

    nodes: prompt_id, node_id, wid, position, name, description, inferred, found, function_name, function_description, inputs, outputs, score, status, semantic_text."""
    strings = F.expr("cast(array() as array<string>)")
    details = F.struct(
        F.col("found").alias("Found"), F.col("function_name").alias("FunctionName"), F.col("function_description").alias("Description"), F.coalesce("inputs", strings).alias("Inputs"),
        F.coalesce("outputs", strings).alias("Outputs"), F.col("score").alias("Score"), F.col("status").alias("Status"), F.col("semantic_text").alias("SemanticText"),
    )
    node = F.struct(
        "position", F.col("wid").alias("Id"), F.col("name").alias("Name"), F.lit(NODE_TYPE).alias("Type"), F.coalesce("description", F.lit("")).alias("Description"),
        F.when(F.col("found"), F.coalesce("inputs", strings)).otherwise(strings).alias("Inputs"), F.when(F.col("found"), F.coalesce("outputs", strings)).otherwise(strings).alias("Outputs"),
        F.col("inferred").alias("Inferred"), details.alias("FunctionDetails"),
    )
    by = nodes.groupBy("prompt_id").agg(F.array_sort(F.collect_list(node)).alias("Nodes"))
    out = connections(nodes, edges).groupBy("prompt_id", "source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "target")))).alias("to"))
    out = out.groupBy("prompt_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.map_entries("to").alias("to"))))).alias("c"))
    whole = by.join(out, "prompt_id").join(inputs(nodes), "prompt_id", "left")
    return whole.select(
        "prompt_id", F.sha2(F.col("prompt_id").cast("string"), 256).alias("Id"), F.lit(name).alias("Name"), F.lit(VERSION).alias("Version"), F.get("Nodes", F.lit(0))["Id"].alias("StartNodeId"),
        F.coalesce(F.col("inputs"), strings).alias("Inputs"), F.transform("Nodes", lambda n: n.dropFields("position")).alias("Nodes"),
        F.transform_values("c", lambda k, v: F.map_from_entries(v)).alias("Connections"),
    )
