"""Beam search over steps, all prompts together: one loop turn for each step index, top-k by window within each prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import relations as R
from ..functions import text as X
from ..lineage import cut
from .ranking import first_wins, ranked, top_k

EXPLICIT_BONUS, INFERRED_PENALTY, DISCONNECTED_PENALTY, RULE_PENALTY = 0.15, 0.03, 0.15, 0.75
VIOLATION = "struct<rule_node_id:string,rule_name:string,operation_id:string,relation:string,overlap_terms:array<string>,rule_text:string,reason:string>"
REASON = "Prompt appears to contradict a domain rule constraining this operation."


def executable(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates in the context graph whose type (else the node's) is executable."""
    n = nodes.select("prompt_id", "node_id", F.col("node_type").alias("_t"))
    return candidates.join(n, ["prompt_id", "node_id"]).where(F.coalesce("node_type", "_t").isin(R.EXECUTABLE_TYPES)).drop("_t")


def violations(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(prompt_id, step_index, node_id, violations): rules on a candidate's operation that share a token with the step and are contradicted by it."""
    rule = nodes.select("prompt_id", F.col("node_id").alias("source"), F.col("name").alias("rule_name"), X.rule_text(F.col("name"), F.col("description"), F.col("aliases")).alias("rule_text"))
    on = edges.where(F.col("relation").isin(R.CONSTRAINT)).join(rule, ["prompt_id", "source"]).select("prompt_id", F.col("source").alias("rule_node_id"), F.col("target").alias("node_id"), "relation", "rule_name", "rule_text")
    both = candidates.select("prompt_id", "step_index", "node_id", "prompt_text").join(on, ["prompt_id", "node_id"]).withColumn("overlap_terms", X.overlap_terms(F.col("prompt_text"), F.col("rule_text")))
    bad = both.where((F.size("overlap_terms") > 0) & X.contradicts(F.col("prompt_text"), F.col("rule_text")))
    item = F.struct("rule_node_id", "rule_name", F.col("node_id").alias("operation_id"), "relation", "overlap_terms", "rule_text", F.lit(REASON).alias("reason"))
    return bad.groupBy("prompt_id", "step_index", "node_id").agg(F.array_sort(F.collect_list(item)).alias("violations"))


def edge_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(prompt_id, a, b, compat, conn): the best scores of edges between two nodes, either way round."""
    kind = lambda s: nodes.select("prompt_id", F.col("node_id").alias(s), F.col("node_type").alias(f"{s}_type"))
    e = edges.join(kind("source"), ["prompt_id", "source"]).join(kind("target"), ["prompt_id", "target"])
    e = e.select("prompt_id", "source", "target", R.compatibility(F.col("relation"), F.col("classification")).alias("compat"), R.connectivity(F.col("source_type"), F.col("target_type"), F.col("relation")).alias("conn"))
    both = e.select("prompt_id", F.col("source").alias("a"), F.col("target").alias("b"), "compat", "conn").union(e.select("prompt_id", "target", "source", "compat", "conn"))
    return both.groupBy("prompt_id", "a", "b").agg(F.max("compat").alias("compat"), F.max("conn").alias("conn"))


def search(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, beam_width: int = 3, max_candidates: int = 10) -> DataFrame:
    """Best beams of each prompt: prompt_id, beam_rank, selected_ids, score, selection, violations.

    A step without an executable candidate is skipped. A beam that can't be extended dies if another one of its prompt was; if none was, all stay.
    Candidates: prompt_id, step_index, rank, node_id, name, node_type, score, explicit, source, prompt_text."""
    picked = top_k(executable(candidates, nodes), ["prompt_id", "step_index"], ["rank"], max_candidates, "cand_rank")
    picked = picked.join(violations(picked, nodes, edges), ["prompt_id", "step_index", "node_id"], "left").withColumn("violations", F.coalesce("violations", F.expr(f"cast(array() as array<{VIOLATION}>)")))
    picked, links = cut(picked), cut(edge_scores(nodes, edges))
    steps = [r[0] for r in picked.select("step_index").distinct().orderBy("step_index").collect()]
    item = "struct<step_index:int,node_id:string,name:string,candidate_score:double,relationship_score:double,connectivity_score:double,constraint_penalty:double>"
    beams = candidates.select("prompt_id").distinct().select("prompt_id", F.lit(1).alias("beam_rank"), F.expr(X.EMPTY).alias("selected_ids"), F.lit(0.0).alias("score"), F.expr(f"cast(array() as array<{item}>)").alias("selection"), F.expr(f"cast(array() as array<{VIOLATION}>)").alias("violations"))
    for i in steps:
        c = picked.where(F.col("step_index") == i).select("prompt_id", "node_id", "name", "cand_rank", F.col("score").alias("cs"), "explicit", "source", F.col("violations").alias("vs"))
        new = beams.join(c, "prompt_id").where(~F.array_contains("selected_ids", F.col("node_id")))
        met = new.select("prompt_id", "beam_rank", "node_id", F.explode("selected_ids").alias("a")).join(links.withColumnRenamed("b", "node_id"), ["prompt_id", "a", "node_id"])
        met = met.groupBy("prompt_id", "beam_rank", "node_id").agg(F.max("compat").alias("compat"), F.max("conn").alias("conn"))
        new = new.join(met, ["prompt_id", "beam_rank", "node_id"], "left").fillna(0.0, ["compat", "conn"])
        penalty = RULE_PENALTY * F.size("vs")
        gain = (
            F.col("cs") + F.col("compat") + F.col("conn")
            + F.when(F.col("explicit") & (F.col("source") == "direct"), EXPLICIT_BONUS).otherwise(0.0)
            - F.when(F.col("source") == "neighborhood", INFERRED_PENALTY).otherwise(0.0)
            - F.when((F.size("selected_ids") > 0) & (F.col("conn") <= 0), DISCONNECTED_PENALTY).otherwise(0.0)
            - penalty
        )
        chosen = F.struct(F.lit(i).cast("int").alias("step_index"), "node_id", "name", F.col("cs").alias("candidate_score"), F.col("compat").alias("relationship_score"), F.col("conn").alias("connectivity_score"), penalty.cast("double").alias("constraint_penalty"))
        grown = new.select(
            "prompt_id", F.col("beam_rank").alias("_b"), F.col("cand_rank").alias("_c"), F.concat("selected_ids", F.array("node_id")).alias("selected_ids"),
            (F.col("score") + gain).alias("score"), F.concat("selection", F.array(chosen)).alias("selection"), F.concat("violations", "vs").alias("violations"),
        )
        grown = first_wins(grown, ["prompt_id", "selected_ids"], [F.col("score").desc(), F.col("_b"), F.col("_c")])
        best = top_k(grown, ["prompt_id"], [F.col("score").desc(), F.col("_b"), F.col("_c")], beam_width, "beam_rank").drop("_b", "_c")
        beams = cut(best.select(*beams.columns).unionByName(beams.join(best.select("prompt_id").distinct(), "prompt_id", "left_anti").select(*beams.columns)))
    return beams


def expand(beams: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Execution graph of each prompt's best beam: operations in selection order, and only ordering edges between them.

    Prompts whose selection is empty have no nodes; the caller decides whether that is an error."""
    top = beams.where("beam_rank = 1").select("prompt_id", F.posexplode("selection").alias("seq", "s"))
    kind = nodes.select("prompt_id", "node_id", "node_type", "description")
    ops = top.select("prompt_id", "seq", "s.*").join(kind, ["prompt_id", "node_id"]).where(F.col("node_type").isin(R.EXECUTABLE_TYPES))
    ops = first_wins(ops, ["prompt_id", "node_id"], ["seq"])
    mine = ops.select("prompt_id", "node_id")
    order = edges.where(F.col("relation").isin(R.ORDERING)).join(mine.withColumnRenamed("node_id", "source"), ["prompt_id", "source"], "left_semi").join(mine.withColumnRenamed("node_id", "target"), ["prompt_id", "target"], "left_semi")
    return ops, order


def ranked_selection(beams: DataFrame) -> DataFrame:
    return ranked(beams, ["prompt_id"], [F.col("score").desc(), F.col("beam_rank")], "place")
