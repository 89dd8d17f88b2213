"""Prompt graphs: actions, entities, relations of an analysed prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_wins, last_wins


def nearest_actions(entities: DataFrame, actions: DataFrame) -> DataFrame:
    """Each entity beside the action of least token distance, the earliest on ties.

    The action before and the one after are found by running max and min, so no entity meets every action. prompt_id, ordinal, token_index in both."""
    a = actions.select("prompt_id", "token_index", F.lit(0).alias("k"), F.col("ordinal").alias("action"), F.lit(None).cast("long").alias("entity"))
    e = entities.select("prompt_id", "token_index", F.lit(1).alias("k"), F.lit(None).cast("long").alias("action"), F.col("ordinal").alias("entity"))
    both = a.unionByName(e)
    at = F.when(F.col("k") == 0, F.struct("token_index", "action"))
    w = Window.partitionBy("prompt_id").orderBy("token_index", "k", "action", "entity")
    low = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    first_at = both.where("k = 0").groupBy("prompt_id", "token_index").agg(F.min("action").alias("action"))
    near = both.select("prompt_id", "token_index", "k", "entity", low.alias("low"), high.alias("high")).where("k = 1")
    d = lambda c: F.abs(F.col(f"{c}.token_index") - F.col("token_index"))
    pick = F.when(F.col("high").isNull() | (d("low") <= d("high")), F.col("low.token_index")).otherwise(F.col("high.token_index"))
    out = near.withColumn("pick", pick).where("pick IS NOT NULL").select("prompt_id", F.col("entity").alias("entity"), F.col("pick").alias("token_index"), F.abs(F.col("pick") - F.col("token_index")).alias("distance"))
    return out.join(first_at, ["prompt_id", "token_index"]).select("prompt_id", "entity", "action", "distance")


def sequence_relations(actions: DataFrame) -> DataFrame:
    """Consecutive actions by lemma."""
    nxt = F.lead("lemma").over(Window.partitionBy("prompt_id").orderBy("token_index"))
    return actions.select("prompt_id", F.col("lemma").alias("source"), nxt.alias("target"), F.lit("sequence").alias("relation"), "token_index").where("target IS NOT NULL").dropDuplicates(["prompt_id", "source", "target", "relation"])


def build(actions: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). acts_on edges go from the nearest action to each entity; relations name lemmas and take the first action of that lemma; of parallel edges the last stays."""
    act = F.concat(F.lit("action:"), "ordinal")
    nodes = actions.select("prompt_id", act.alias("id"), F.col("text").alias("name"), F.lit("Action").alias("type")).unionByName(entities.select("prompt_id", F.concat(F.lit("entity:"), "ordinal").alias("id"), F.col("text").alias("name"), F.lit("Entity").alias("type")))
    near = nearest_actions(entities, actions).select("prompt_id", F.concat(F.lit("action:"), "action").alias("source"), F.concat(F.lit("entity:"), "entity").alias("target"), F.lit("acts_on").alias("relation"), F.struct(F.lit(0).alias("late"), F.col("entity").cast("long").alias("at")).alias("seq"))
    first = first_wins(actions, ["prompt_id", "lemma"], ["ordinal"])
    side = lambda s: first.select("prompt_id", F.col("lemma").alias(s), act.alias(f"{s}_id"))
    named = relations.join(side("source"), ["prompt_id", "source"]).join(side("target"), ["prompt_id", "target"])
    named = named.select("prompt_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", F.struct(F.lit(1).alias("late"), F.col("seq").cast("long").alias("at")).alias("seq"))
    return nodes, last_wins(near.unionByName(named), ["prompt_id", "source", "target"])


def concepts(nodes: DataFrame, edges: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Actions (or nodes without a type) with their text: the name and the distinct entities, from the graph and from an extractor."""
    want = nodes.where((F.col("type") == "Action") | F.col("type").isNull())
    ents = edges.where("relation = 'acts_on'").join(nodes.select("prompt_id", F.col("id").alias("target"), F.col("name").alias("entity")), ["prompt_id", "target"]).select("prompt_id", F.col("source").alias("id"), "entity", F.lit(0).alias("k"), "target")
    if extracted is not None:
        ents = ents.unionByName(extracted.select("prompt_id", "id", "entity", F.lit(1).alias("k"), F.col("entity").alias("target")))
    said = ents.groupBy("prompt_id", "id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "target", "entity"))), lambda x: x["entity"])).alias("entities"))
    return want.join(said, ["prompt_id", "id"], "left").select("prompt_id", "id", "name", F.concat_ws(" ", F.col("name"), F.array_join("entities", " ")).alias("text"))
