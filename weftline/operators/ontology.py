"""Raw extractions to a typed graph, rejects in quarantine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_term
from .ranking import first_wins


def group_nodes(records: DataFrame) -> DataFrame:
    """One node for each id: types and categories as sorted sets, name of the first record (the id if it has none), all records in order.

    records: seq, id, name, statement, category, type. Rows without an id and categories without a type are left out."""
    rows = records.where(F.col("id").isNotNull() & F.col("type").isNotNull())
    first = F.min(F.struct("seq", F.coalesce("name", "id").alias("name")))["name"]
    record = F.struct("seq", "id", "name", "statement")
    return rows.groupBy("id").agg(
        first.alias("name"),
        F.array_sort(F.collect_set("type")).alias("types"),
        F.array_sort(F.collect_set("category")).alias("raw_categories"),
        F.transform(F.array_sort(F.collect_list(record)), lambda r: F.struct(r["id"].alias("id"), r["name"].alias("name"), r["statement"].alias("statement"))).alias("raw_records"),
        F.count("*").alias("raw_record_count"),
    )


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("raw_record_count > 1").select("id", "types", "raw_record_count", F.lit("retained as a multi-label node; review during normalization").alias("action"))


def map_relationships(rels: DataFrame, nodes: DataFrame, terms: DataFrame) -> dict[str, DataFrame]:
    """Route relationships: unresolved endpoints first, then unknown wording, then endpoint types; of valid definitions the lowest def_index wins.

    rels: relationship_index, source, target, raw_type, type, condition; terms: def_index, type, raw_term, source_types, target_types."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("types").alias(f"{s}_types"))
    r = rels.withColumnRenamed("type", "wording").withColumn("raw_type", F.coalesce(F.nullif("raw_type", F.lit("")), "wording", F.lit(""))).drop("wording")
    r = r.join(side("source"), "source", "left").join(side("target"), "target", "left")
    missing = F.array_compact(F.array(F.when(F.col("source_types").isNull(), F.col("source")), F.when(F.col("target_types").isNull(), F.col("target"))))
    resolved = F.col("source_types").isNotNull() & F.col("target_types").isNotNull()
    t = terms.select(F.col("def_index"), F.col("type"), norm_term(F.col("raw_term")).alias("term"), F.col("source_types").alias("st"), F.col("target_types").alias("tt")).distinct()
    fits = F.arrays_overlap("st", "source_types") & F.arrays_overlap("tt", "target_types")
    hits = r.where(resolved).join(t, norm_term(F.col("raw_type")) == F.col("term"), "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    edges = first_wins(hits.where("fits"), ["relationship_index"], ["def_index"])
    edges = edges.select(F.concat(F.lit("edge:"), "relationship_index").alias("id"), "source", "target", "type", "condition", "raw_type", "relationship_index")
    by = ["relationship_index", "source", "target", "raw_type"]
    judged = hits.groupBy(*by).agg(
        F.bool_or("fits").alias("any_fits"), F.count("def_index").alias("n"), F.first("source_types").alias("source_types"), F.first("target_types").alias("target_types"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("def_index", "type")))), lambda x: x["type"]).alias("candidate_types"),
    )
    return {
        "edges": edges,
        "unresolved": r.where(~resolved).select(*by, missing.alias("missing_node_ids")),
        "unmapped": judged.where("n = 0").select(*by),
        "invalid": judged.where("n > 0 AND NOT any_fits").select(*by, "source_types", "target_types", "candidate_types"),
    }


def summary(records: DataFrame, rels: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; raw nodes count rows of unknown categories and without ids too."""
    n = lambda df, c: df.agg(F.count("*").alias(c)).withColumn("_k", F.lit(1))
    out = n(records, "raw_node_count").join(n(nodes, "mapped_node_count"), "_k").join(n(rels, "raw_relationship_count"), "_k").join(n(edges, "mapped_relationship_count"), "_k")
    return out.drop("_k")
