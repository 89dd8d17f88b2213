"""From stored workflows to the mined graph: nodes with counts and vectors, typed transitions, paths with frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relations as R
from ..functions.text import path_text
from ..lineage import cut
from ..operators import mining
from ..sources.documents import read_table

UNTYPED = "Custom"


def mine(rows: DataFrame, embedding) -> dict[str, DataFrame]:
    """nodes (id, name, type, embedding, count), edges (repeats stay), adjacency and reverse_adjacency, paths (path, frequency, embedding), workflows by name (the last row of a name).

    rows: workflow_id (in the order of the file) and WorkflowJson."""
    parsed = cut(mining.parse_workflows(rows))
    seen = mining.workflow_nodes(parsed).where("name IS NOT NULL").withColumn("seq", F.struct("workflow_id", "seq")).withColumn("type", F.coalesce("type", F.lit(UNTYPED)))
    nodes = mining.node_counts(seen).select(F.sha2("name", 256).alias("id"), "name", "type", embedding.encode(F.col("name")).alias("embedding"), "count")
    kind = R.edge_category(F.col("transition"))
    edges = mining.workflow_edges(parsed).withColumn("relation", F.col("transition")).withColumn("edge_type", kind).withColumn("weight", R.category_weight(F.col("edge_type"))).withColumn("confidence", F.lit(1.0))
    edges = cut(edges)

    def lists(key, other):
        link = F.struct("workflow_id", "ord", F.col(other).alias("name"), "transition", "relation", "edge_type", "weight", "confidence")
        return edges.groupBy(F.col(key).alias("name")).agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: x.dropFields("workflow_id", "ord")).alias("neighbours"))

    paths = mining.path_frequency(mining.follow(parsed).select("path")).withColumn("embedding", embedding.encode(path_text(F.col("path"))))
    last = parsed.groupBy("Name").agg(F.max("workflow_id").alias("workflow_id"))
    workflows = parsed.join(last, ["Name", "workflow_id"])
    return {"nodes": nodes, "edges": edges, "adjacency": lists("source", "target"), "reverse_adjacency": lists("target", "source"), "paths": paths, "workflows": workflows}


def run(spark: SparkSession, source: str, out: str, embedding) -> dict[str, int]:
    """Read a table of workflows (.csv, .xlsx), write every part as Parquet under `out`, return the counts."""
    rows = read_table(spark, source)
    if "workflow_id" not in rows.columns:
        rows = rows.withColumn("workflow_id", F.monotonically_increasing_id())
    counts = {}
    for name, df in mine(rows, embedding).items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        counts[name] = spark.read.parquet(f"{out}/{name}").count()
    return counts
