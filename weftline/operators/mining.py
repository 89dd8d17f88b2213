"""Transitions and paths mined from workflows or from ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

TERMINAL = ["Done", "End", "Stop"]
WORKFLOW = "struct<Name:string,StartNodeId:string,Nodes:array<struct<Id:string,Name:string,Type:string>>,Connections:map<string,map<string,string>>>"


def parse_workflows(rows: DataFrame) -> DataFrame:
    """workflow_id and the parsed column of a JSON cell; unreadable cells are left out."""
    return rows.withColumn("w", F.from_json("WorkflowJson", WORKFLOW)).where("w.Nodes IS NOT NULL").select("workflow_id", "w.*")


def node_counts(nodes: DataFrame) -> DataFrame:
    """(name, type of the first occurrence, count)."""
    return nodes.groupBy("name").agg(F.min(F.struct("seq", "type"))["type"].alias("type"), F.count("*").alias("count"))


def workflow_nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("workflow_id", F.posexplode("Nodes").alias("seq", "n")).select("workflow_id", "seq", F.col("n.Id").alias("id"), F.col("n.Name").alias("name"), F.col("n.Type").alias("type"))


def workflow_edges(parsed: DataFrame) -> DataFrame:
    """Every transition with names on both ends; terminal and unknown targets are dropped, repeats stay."""
    steps = parsed.select("workflow_id", F.explode("Connections").alias("source_id", "to")).select("workflow_id", "source_id", F.posexplode(F.map_entries("to")).alias("ord", "e"))
    steps = steps.select("workflow_id", "source_id", "ord", F.col("e.key").alias("transition"), F.col("e.value").alias("target_id")).where(~F.col("target_id").isin(TERMINAL))
    n = lambda s: workflow_nodes(parsed).select("workflow_id", F.col("id").alias(f"{s}_id"), F.col("name").alias(s))
    return steps.join(n("source"), ["workflow_id", "source_id"]).join(n("target"), ["workflow_id", "target_id"]).select("workflow_id", "source", "target", "transition", "ord")


def follow(parsed: DataFrame) -> DataFrame:
    """(workflow_id, path of names): from the start along each node's first transition until a revisit, a terminal or an unknown target."""
    nodes = workflow_nodes(parsed).select("workflow_id", "id", "name")
    first = parsed.select("workflow_id", F.explode("Connections").alias("id", "to")).select("workflow_id", "id", F.get(F.map_values("to"), F.lit(0)).alias("next"))
    at = parsed.select("workflow_id", F.col("StartNodeId").alias("id")).join(nodes, ["workflow_id", "id"]).select("workflow_id", "id", F.array("id").alias("seen"), F.array("name").alias("path"))
    done = None
    at = cut(at)
    while not at.isEmpty():
        go = at.join(first, ["workflow_id", "id"], "left").join(nodes.select("workflow_id", F.col("id").alias("next"), F.col("name").alias("next_name")), ["workflow_id", "next"], "left")
        on = F.col("next_name").isNotNull() & ~F.array_contains("seen", F.coalesce("next", F.lit("")))
        go = cut(go.withColumn("on", on))
        ended = go.where(~F.col("on")).select("workflow_id", "path")
        done = ended if done is None else done.union(ended)
        at = go.where("on").select("workflow_id", F.col("next").alias("id"), F.concat("seen", F.array("next")).alias("seen"), F.concat("path", F.array("next_name")).alias("path"))
    return done if done is not None else at.select("workflow_id", "path")


def path_frequency(paths: DataFrame) -> DataFrame:
    return paths.groupBy("path").agg(F.count("*").alias("frequency"))


def event_transitions(events: DataFrame, by: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), what: str = "event_type") -> DataFrame:
    """Consecutive events of a key, counted by pair."""
    nxt = F.lead(what).over(Window.partitionBy(by).orderBy(*order))
    return events.select(F.col(what).alias("source"), nxt.alias("target")).where("target IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"))


def event_paths(events: DataFrame, by: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), what: str = "event_type") -> DataFrame:
    """(by, path): the walk over each key's events until an event type comes again.

    Only the first occurrence of each type matters, so rows are reduced to one for each key and type before they meet."""
    first = events.groupBy(by, what).agg(F.min(F.struct(*order)).alias("at"))
    again = events.groupBy(by).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by, what).orderBy(*order))
    second = events.withColumn("r", rank).where("r = 2").groupBy(by).agg(F.min(F.struct(*order)).alias("stop"))
    on = first.join(again, by).join(second, by, "left").where("stop IS NULL OR at < stop")
    return on.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", what))), lambda x: x[what]).alias("path"))
