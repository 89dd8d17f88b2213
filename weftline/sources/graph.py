"""Graph sources: stored records, in-memory rows, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relations as R
from ..functions.text import EMPTY, node_text_records
from ..operators.ranking import last_wins
from . import schemas

LABEL = "GraphNode"
DEFAULT_TYPE = "DomainEntity"


def decode_nodes(rows: DataFrame) -> DataFrame:
    """Stored rows to nodes: types are the distinct own types and labels, a scalar type is a list of one, the first is node_type; the name falls back to the id.

    rows: id, name, types (array or string), labels, type, description, aliases; missing columns count as null. Rows without an id are left out."""
    has = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    as_list = lambda c: F.expr(EMPTY) if c not in rows.columns else F.coalesce(F.col(c), F.expr(EMPTY)) if dict(rows.dtypes)[c].startswith("array") else F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(F.expr(EMPTY))
    types = F.array_distinct(F.concat(as_list("types"), F.filter(as_list("labels"), lambda x: x != LABEL)))
    out = rows.withColumn("_t", types).where(F.col("id").isNotNull())
    keep = [c for c in rows.columns if c not in ("id", "name", "types", "labels", "type", "description", "aliases")]
    return out.select(
        F.col("id").cast("string").alias("id"), F.coalesce(F.nullif(has("name", "string"), F.lit("")), F.col("id").cast("string")).alias("name"),
        F.coalesce(F.get("_t", F.lit(0)), has("type", "string"), F.lit(DEFAULT_TYPE)).alias("node_type"), F.coalesce(has("description", "string"), F.lit("")).alias("description"),
        as_list("aliases").alias("aliases"), F.col("_t").alias("types"), *keep,
    )


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All nodes, the last row of an id (by seq) if it comes twice."""
    rows = spark.read.parquet(path)
    return decode_nodes(last_wins(rows, ["id"]) if "seq" in rows.columns else rows.dropDuplicates(["id"]))


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def memory_graph(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of driver rows, numbered in the order given."""
    n = spark.createDataFrame([(i, *r) for i, r in enumerate(nodes)], "seq long, " + schemas.NODE)
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(edges)], "seq long, source string, target string, relation string")
    return n, e


def planner_graph(node_records: DataFrame, edge_records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags and routing weights; nodes without an id and edges with an unknown end are dropped.

    node_records: id, name, types, labels?, raw_records_json?; edge_records: id, source, target, type, condition, raw_type."""
    has = lambda c, t: F.col(c) if c in node_records.columns else F.lit(None).cast(t)
    types = F.when(F.coalesce(F.size("types"), F.lit(0)) > 0, F.col("types")).otherwise(F.filter(F.coalesce(has("labels", "array<string>"), F.expr(EMPTY)), lambda x: x != LABEL))
    nodes = node_records.where(F.coalesce("id", F.lit("")) != "").withColumn("_t", types)
    nodes = nodes.select(
        "id", F.coalesce("name", "id").alias("name"), F.col("_t").alias("types"), F.arrays_overlap("_t", F.array(F.lit("Operation"))).alias("executable"),
        F.arrays_overlap("_t", F.array(F.lit("Rule"))).alias("constraint"), node_text_records(F.col("name"), F.col("id"), F.col("_t"), has("raw_records_json", "string")).alias("text"),
    )
    known = nodes.select("id")
    edges = edge_records.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("RELATED_TO"))
    return nodes, edges.withColumn("_r", R.routing(kind)).select(
        "id", "source", "target", kind.alias("relation"), F.col("_r.edge_type").alias("edge_type"), F.col("_r.weight").alias("weight"), "condition",
        F.upper(F.trim(kind)).isin(R.ROUTING_CONTEXT).alias("context"), F.lit(1.0).alias("confidence"),
    )


def edges_of(edges: DataFrame | None, adjacency: DataFrame | None) -> DataFrame:
    """Edges if there are any, else those of adjacency lists (id, neighbours of id and relation)."""
    if edges is not None and not edges.isEmpty():
        return edges
    return adjacency.select(F.col("id").alias("source"), F.explode("neighbours").alias("n")).select("source", F.col("n.id").alias("target"), F.col("n.relation").alias("relation"))


def domain_context(nodes: DataFrame) -> DataFrame:
    """What a language model is told about nodes."""
    return nodes.select(F.struct("id", "name", F.col("node_type").alias("type"), "types", "description", "aliases").alias("context"))
