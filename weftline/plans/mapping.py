"""Raw extraction to stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import ontology as O
from ..sources import documents as D
from ..sources import schemas
from ..sources.sinks import edge_properties, node_properties, write_graph, write_json


def map_graph(raw: DataFrame, ontology: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, the reject tables, duplicates and the summary."""
    types = ontology.select("node_types").first()[0]
    records, rels = D.raw_records(raw, types), D.raw_relationships(raw)
    nodes = O.group_nodes(records)
    out = O.map_relationships(rels, nodes, D.ontology_terms(ontology))
    return out | {"nodes": nodes, "duplicates": O.duplicate_ids(nodes), "summary": O.summary(records, rels, nodes, out["edges"])}


def run(spark: SparkSession, raw_path: str, ontology_path: str, out_path: str, categories: list[str] | None = None, batch_size: int | None = None) -> dict[str, DataFrame]:
    """Read both files, map, and write the graph and the reports."""
    ontology = D.read_first_json(spark, ontology_path, schemas.ONTOLOGY)
    kinds = categories or list(ontology.select("node_types").first()[0])
    done = map_graph(D.read_first_json(spark, raw_path, D.raw_schema(kinds)), ontology)
    write_graph(node_properties(done["nodes"]), edge_properties(done["edges"]), f"{out_path}/graph", batch_size)
    for k in ("duplicates", "unresolved", "unmapped", "invalid", "summary"):
        write_json(done[k], f"{out_path}/report/{k}")
    return done
