"""Graphs of whatever shape a caller holds, as rows; and small additions to graphs held as tables."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import relations as R
from ..operators.ranking import last_wins

NODE_ROW = "seq long, id string, name string, type string, types array<string>, labels array<string>, description string, aliases array<string>, embedding array<double>, executable boolean"
EDGE_ROW = "seq long, source string, target string, relation string, transition string, edge_type string, edge_category string, weight double, confidence double"


def node_items(graph: Any) -> list[tuple[Any, dict]]:
    """(id, attributes) of an object with `nodes(data=True)`, or of a dict whose `nodes` are a dict by id or a list; a list's nodes without an id are numbered."""
    if hasattr(graph, "nodes"):
        return [(k, dict(a)) for k, a in graph.nodes(data=True)]
    found = graph.get("nodes") if isinstance(graph, dict) else None
    if isinstance(found, dict):
        return [(k, dict(a)) for k, a in found.items()]
    if isinstance(found, list):
        return [(n.get("id", i), dict(n)) for i, n in enumerate(found)]
    raise TypeError("a graph has nodes(data=True) or a 'nodes' key with a dict or a list")


def edge_items(graph: Any) -> list[tuple[Any, Any, dict]]:
    """(source, target, attributes) of an object with `edges(data=True)`, or of a dict's `edges` (tuples or dicts), or, if it has none, of its `adjacency` lists."""
    if graph is None:
        return []
    if hasattr(graph, "edges"):
        return [(a, b, dict(x)) for a, b, x in graph.edges(data=True)]
    out = []
    for e in graph.get("edges") or []:
        if isinstance(e, dict):
            out.append((e.get("source"), e.get("target"), dict(e)))
        elif isinstance(e, (tuple, list)) and len(e) > 1:
            out.append((e[0], e[1], dict(e[2]) if len(e) > 2 and isinstance(e[2], dict) else {}))
    return out or [(a, x.get("target"), dict(x)) for a, to in (graph.get("adjacency") or {}).items() for x in to]


def _row(schema: str, values: dict) -> tuple:
    def fit(kind, v):
        if v is None:
            return None
        if kind.startswith("array"):
            one = [v] if isinstance(v, str) else list(v)
            return [float(x) for x in one] if "double" in kind else [str(x) for x in one]
        return {"long": int, "double": float, "boolean": bool}.get(kind, str)(v)

    return tuple(fit(kind, values.get(name)) for name, kind in (c.strip().split(" ", 1) for c in schema.split(",")))


def tables_of(spark: SparkSession, graph: Any) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in the order given; edges get what routing needs where it is absent. For graphs that a driver holds; stored ones are read as tables."""
    nodes = [_row(NODE_ROW, {**a, "seq": i, "id": k, "name": a.get("name", k)}) for i, (k, a) in enumerate(node_items(graph))]
    edges = [_row(EDGE_ROW, {**x, "seq": i, "source": a, "target": b}) for i, (a, b, x) in enumerate(edge_items(graph))]
    return spark.createDataFrame(nodes, NODE_ROW), R.edge_attributes(spark.createDataFrame(edges, EDGE_ROW))


def add_nodes(nodes: DataFrame, more: Iterable[dict] | DataFrame) -> DataFrame:
    """Nodes with more of them; of equal ids the added one stays."""
    return last_wins(_with(nodes, more), ["id"])


def add_edges(edges: DataFrame, more: Iterable[dict] | DataFrame) -> DataFrame:
    """Edges with more of them; of equal source, target and relation the added one stays."""
    return last_wins(_with(edges, more), ["source", "target", "relation"])


def _with(old: DataFrame, more: Iterable[dict] | DataFrame) -> DataFrame:
    """Added rows come behind all old ones: seq is a pair of the side and the place in it."""
    if not isinstance(more, DataFrame):
        fields = [StructField(f.name, f.dataType) for f in old.schema.fields if f.name != "seq"]
        rows = [(i, *[r.get(f.name) for f in fields]) for i, r in enumerate(more)]
        more = old.sparkSession.createDataFrame(rows, StructType([StructField("seq", LongType()), *fields]))
    place = lambda df, side: df.withColumn("seq", F.struct(F.lit(side).alias("side"), (F.col("seq") if "seq" in df.columns else F.lit(0)).cast("long").alias("at")))
    return place(old, 0).unionByName(place(more, 1), allowMissingColumns=True)
