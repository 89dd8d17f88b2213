"""Relation semantics: dimension tables and scores by relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation, edge type, weight, classification, counts for ordering.
DOMAIN_RELATIONS = [
    ("OPERATION_REQUIRES", "mandatory", 1.0, "REQUIRED", True),
    ("OPERATION_PRECEDES", "mandatory", 1.0, "REQUIRED", True),
    ("OPERATION_INCLUDES", "mandatory", 2.0, "REQUIRED", True),
    ("OPERATION_CREATES", "alternative", 3.0, "POSSIBLE", True),
    ("OPERATION_MODIFIES", "alternative", 3.0, "POSSIBLE", True),
    ("OPERATION_VALIDATES", "alternative", 3.0, "POSSIBLE", True),
    ("OPERATION_ACCEPTS", "alternative", 4.0, "POSSIBLE", True),
    ("OPERATION_PRODUCES", "alternative", 3.0, "POSSIBLE", True),
    ("ACTOR_PERFORMS", "optional", 6.0, "CONTEXT", False),
    ("ACTOR_REQUESTS", "optional", 6.0, "CONTEXT", False),
    ("ENTITY_OWNS", "optional", 7.0, "CONTEXT", False),
    ("ENTITY_LINKED_TO", "optional", 7.0, "CONTEXT", False),
    ("EVENT_RELATES_TO", "optional", 7.0, "CONTEXT", False),
    ("RULE_CONSTRAINS", "optional", 5.0, "CONTEXT", False),
    ("COMPONENT_EXECUTES", "optional", 6.0, "CONTEXT", False),
    ("OPERATION_PRODUCES_EVENT", "optional", 6.0, "OPTIONAL", False),
    ("EVENT_TRIGGERS", "optional", 5.0, "OPTIONAL", False),
]
DOMAIN_DEFAULT = ("optional", 8.0, "OPTIONAL", False)
PROMPT_RELATIONS = [
    ("PROMPT_PRECEDES", "mandatory", 0.0, "REQUIRED", True),
    ("PROMPT_AND", "alternative", 2.0, "POSSIBLE", True),
    ("PROMPT_OR", "alternative", 2.0, "POSSIBLE", False),
    ("PROMPT_CONDITION", "optional", 4.0, "CONTEXT", False),
    ("PROMPT_UNLESS", "optional", 4.0, "CONTEXT", False),
    ("PROMPT_DEPENDENCY", "mandatory", 0.0, "REQUIRED", True),
]
PROMPT_DEFAULT = ("optional", 5.0, "OPTIONAL", False)
# Relation, edge type, weight of the routing tables.
ROUTING_RELATIONS = [
    ("OPERATION_REQUIRES", "mandatory", 1), ("OPERATION_PRECEDES", "mandatory", 1), ("OPERATION_INCLUDES", "mandatory", 2),
    ("EVENT_TRIGGERS", "mandatory", 2), ("OPERATION_PRODUCES_EVENT", "mandatory", 2), ("OPERATION_CREATES", "alternative", 3),
    ("OPERATION_MODIFIES", "alternative", 3), ("OPERATION_VALIDATES", "alternative", 3), ("OPERATION_PRODUCES", "alternative", 3),
    ("OPERATION_ACCEPTS", "alternative", 4), ("COMPONENT_EXECUTES", "alternative", 4), ("ACTOR_PERFORMS", "alternative", 4),
    ("ACTOR_REQUESTS", "alternative", 4), ("RULE_CONSTRAINS", "optional", 5), ("ENTITY_OWNS", "optional", 6),
    ("ENTITY_LINKED_TO", "optional", 6), ("EVENT_RELATES_TO", "optional", 6),
]
ROUTING_DEFAULT = ("optional", 5)
ROUTING_CONTEXT = ["ACTOR_PERFORMS", "ACTOR_REQUESTS", "COMPONENT_EXECUTES", "ENTITY_OWNS", "ENTITY_LINKED_TO", "EVENT_RELATES_TO", "RULE_CONSTRAINS"]
EDGE_WEIGHTS = [("mandatory", 1), ("alternative", 3), ("optional", 5), ("deprecated", 100)]
ORDERING = ["OPERATION_PRECEDES", "PROMPT_DEPENDENCY", "PROMPT_PRECEDES"]
STRUCTURAL = ["OPERATION_INCLUDES"]
CONTEXT = [
    "ENTITY_OWNS", "OPERATION_REQUIRES", "OPERATION_ACCEPTS", "OPERATION_CREATES", "OPERATION_MODIFIES", "OPERATION_VALIDATES",
    "OPERATION_PRODUCES", "OPERATION_PRODUCES_EVENT", "EVENT_RELATES_TO", "ENTITY_LINKED_TO",
]
CONSTRAINT = ["RULE_CONSTRAINS"]
EXECUTABLE_TYPES = ["Operation", "operation"]
RELEVANCE = {"REQUIRED": 1.0, "POSSIBLE": 0.75, "CONTEXT": 0.40}
RELEVANCE_DEFAULT = 0.20
CLASS_BONUS = {"REQUIRED": 0.25, "POSSIBLE": 0.08, "CONTEXT": 0.03}
STRUCTURAL_BONUS, CONNECTIVITY_BONUS, CONTEXT_BONUS = 0.12, 0.20, 0.03

SEMANTICS_DDL = "relation string, edge_type string, weight double, classification string, traverses_for_ordering boolean"


def domain_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAIN_RELATIONS, SEMANTICS_DDL)


def prompt_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMPT_RELATIONS, SEMANTICS_DDL)


def routing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTING_RELATIONS, "relation string, edge_type string, weight int")


def _struct(row) -> Column:
    return F.struct(F.lit(row[0]).alias("edge_type"), F.lit(row[1]).alias("weight"), F.lit(row[2]).alias("classification"), F.lit(row[3]).alias("traverses_for_ordering"))


def _lookup(rows, relation: Column, default) -> Column:
    table = F.create_map(*[x for r in rows for x in (F.lit(r[0]), _struct(r[1:]))])
    return F.coalesce(F.try_element_at(table, relation), _struct(default))


def semantics(relation: Column) -> Column:
    """Struct of edge_type, weight, classification, traverses_for_ordering: a literal map, so no join; PROMPT_ names have their own table."""
    relation = F.coalesce(relation, F.lit(""))
    return F.when(relation.startswith("PROMPT_"), _lookup(PROMPT_RELATIONS, relation, PROMPT_DEFAULT)).otherwise(_lookup(DOMAIN_RELATIONS, relation, DOMAIN_DEFAULT))


def annotate(edges: DataFrame) -> DataFrame:
    """Edges with relation semantics."""
    return edges.withColumn("_s", semantics(F.col("relation"))).select(*edges.columns, "_s.*")


def by_class(classification: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(classification == k, v).otherwise(out)
    return out


def relevance(relation: Column) -> Column:
    """By the domain table only, whatever the relation's name."""
    return by_class(_lookup(DOMAIN_RELATIONS, F.coalesce(relation, F.lit("")), DOMAIN_DEFAULT)["classification"], RELEVANCE, RELEVANCE_DEFAULT)


def routing(relation: Column) -> Column:
    """Struct of edge_type and weight; names are trimmed and upper-cased."""
    pair = lambda t, w: F.struct(F.lit(t).alias("edge_type"), F.lit(w).alias("weight"))
    table = F.create_map(*[x for r, t, w in ROUTING_RELATIONS for x in (F.lit(r), pair(t, w))])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(relation))), pair(*ROUTING_DEFAULT))


def edge_category(transition: Column) -> Column:
    """One of the four known categories; anything else is mandatory."""
    low = F.lower(F.trim(transition))
    return F.when(low.isin([k for k, _ in EDGE_WEIGHTS]), low).otherwise("mandatory")


def category_weight(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, w in EDGE_WEIGHTS for x in (F.lit(k), F.lit(w))]), category)


def edge_attributes(edges: DataFrame) -> DataFrame:
    """relation from relation, transition or 'success'; edge_type from edge_type, edge_category or 'mandatory'; weight and confidence only where absent."""
    col = lambda n, t: F.col(n) if n in edges.columns else F.lit(None).cast(t)
    kind = edge_category(F.coalesce(col("edge_type", "string"), col("edge_category", "string"), F.lit("mandatory")))
    return edges.withColumns(
        {
            "relation": F.coalesce(col("relation", "string"), col("transition", "string"), F.lit("success")),
            "edge_type": kind,
            "weight": F.coalesce(col("weight", "int"), category_weight(kind)),
            "confidence": F.coalesce(col("confidence", "double"), F.lit(1.0)),
        }
    )


def migrated_category(edge_type: Column, edge_category_: Column, transition: Column) -> Column:
    """As edge_attributes, but the transition names the category if nothing else does."""
    return edge_category(F.coalesce(edge_type, edge_category_, transition, F.lit("mandatory")))


def compatibility(relation: Column, classification: Column) -> Column:
    return F.when(relation.isin(ORDERING), CLASS_BONUS["REQUIRED"]).when(relation.isin(STRUCTURAL), STRUCTURAL_BONUS).otherwise(by_class(classification, CLASS_BONUS, 0.0))


def connectivity(source_type: Column, target_type: Column, relation: Column) -> Column:
    both = F.coalesce(source_type.isin(EXECUTABLE_TYPES) & target_type.isin(EXECUTABLE_TYPES), F.lit(False))
    ops = F.when(relation.isin(ORDERING), CONNECTIVITY_BONUS).when(relation.isin(STRUCTURAL), CONNECTIVITY_BONUS * 0.60).otherwise(CONNECTIVITY_BONUS * 0.50)
    return F.when(both, ops).when(relation.isin(CONTEXT), CONTEXT_BONUS).otherwise(0.0)
