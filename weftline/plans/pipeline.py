"""Prompts to workflows. Every stage takes all prompts; only the last documents leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import cut
from ..operators import beam, context, workflow
from ..operators.candidates import match_functions
from ..operators.ranking import dedup_steps
from ..operators.traverse import plan_order
from ..sources import report
from ..sources.graph import domain_context
from ..sources.sinks import log_stage
from .config import Config
from .providers import fill_embeddings, parse_replies


def interpret(prompts: DataFrame, model=None, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(intents, steps, dependencies). Explicit steps come from the text; the model's count only where the text gives none. Equal steps are merged, explicit ones first.

    Without a model there are no inferred steps and no dependencies."""
    p = prompts.withColumn("steps", X.explicit_steps(F.col("text")))
    item = "struct<text:string,reason:string>"
    if model is None:
        r = p.select("prompt_id", F.lit(None).cast("string").alias("intent"), *[F.expr(f"cast(array() as array<{item}>)").alias(c) for c in ("explicit_steps", "inferred_steps")], F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("dependencies"))
    else:
        r = parse_replies(model.enrich(prompts, domain_context(nodes) if nodes is not None else None))
    both = cut(p.join(r.withColumnRenamed("intent", "said"), "prompt_id", "left"))
    said = F.transform("steps", lambda s: F.struct(s.alias("text"), F.lit("explicit in prompt").alias("reason")))
    explicit = F.when(F.size("steps") > 0, said).otherwise(F.coalesce("explicit_steps", F.expr(f"cast(array() as array<{item}>)")))
    rows = both.select("prompt_id", F.posexplode(explicit).alias("p", "s")).select("prompt_id", "s.*", F.lit(True).alias("explicit"), F.col("p").cast("long").alias("pos"))
    more = both.select("prompt_id", F.posexplode("inferred_steps").alias("p", "s")).select("prompt_id", "s.*", F.lit(False).alias("explicit"), (F.col("p") + (1 << 20)).cast("long").alias("pos"))
    steps = dedup_steps(rows.unionByName(more), X.norm_step(F.col("text")))
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("prompt_id").orderBy("pos")) - 1
    steps = steps.select("prompt_id", index.cast("int").alias("step_index"), "text", "explicit", "reason")
    deps = both.select("prompt_id", F.posexplode("dependencies").alias("seq", "d")).select("prompt_id", "seq", "d.before", "d.after")
    return both.select("prompt_id", X.intent(F.col("text"), F.col("steps"), F.col("said")).alias("intent")), steps, deps


class Pipeline:
    """nodes: seq and schemas.NODE; edges: seq, source, target, relation; functions: seq and schemas.FUNCTION."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, functions: DataFrame, embedding, model=None, config: Config = Config()):
        self.embedding, self.model, self.config = embedding, model, config
        self.nodes, self.edges = cut(fill_embeddings(nodes, embedding)), cut(edges)  # every stage reads them
        text = X.function_text(*[F.col(c) for c in ("name", "description", "inputs", "outputs")])
        self.functions = cut(functions.withColumn("embedding", embedding.encode(text)))

    def run(self, prompts: DataFrame, name: str = "Generated Workflow") -> DataFrame:
        """One workflow document for each prompt; a prompt for which no operation is selected is an error."""
        c = self.config
        _, steps, deps = interpret(prompts, self.model, self.nodes)
        steps = cut(steps.withColumn("query", self.embedding.encode(F.col("text"))))
        ctx = {k: cut(v) for k, v in context.build(steps, deps, self.nodes, self.edges, c.top_k, c.depth).items() if k != "inferred"}
        log_stage("candidates", ctx["candidates"], c.verbose)
        log_stage("weighted edges", report.weighted_edge_lines(ctx["edges"]), c.verbose)
        beams = beam.search(ctx["candidates"], ctx["nodes"], ctx["edges"], c.beam_width, c.max_candidates)
        none = prompts.join(beams.where("beam_rank = 1 AND size(selected_ids) > 0"), "prompt_id", "left_anti").limit(5).collect()
        if none:
            raise RuntimeError(f"no operation was selected for {[r.prompt_id for r in none]}")
        log_stage("beams", beams, c.verbose)
        log_stage("selected", report.selection_lines(beams, ctx["candidates"]), c.verbose)
        ops, order_edges = beam.expand(beams, ctx["nodes"], ctx["edges"])
        ops, order_edges = cut(ops), cut(order_edges.withColumn("seq", F.xxhash64("source", "relation", "target")))
        order = plan_order(ops.select(F.col("prompt_id").alias("plan_id"), F.col("node_id").alias("id"), "seq"), order_edges.withColumnRenamed("prompt_id", "plan_id"))
        placed = ops.drop("seq").join(order.select(F.col("plan_id").alias("prompt_id"), F.col("id").alias("node_id"), "position"), ["prompt_id", "node_id"])
        log_stage("execution order", report.order_lines(placed.select("prompt_id", "node_id", "position"), ops), c.verbose)
        text = X.match_text(F.col("name"), F.lit(None).cast("string"), F.lit(None).cast("string"))
        ask = placed.select(F.struct("prompt_id", "node_id").alias("text_id"), text.alias("text"), self.embedding.encode(text).alias("query"))
        found = match_functions(ask, self.functions, c.match_threshold).select(
            "text_id.*", F.col("text").alias("semantic_text"), F.col("score").alias("score"), "found", "status", "function_name", F.col("description").alias("function_description"), "inputs", "outputs"
        )
        direct = ctx["candidates"].groupBy("prompt_id", "node_id").agg((~F.bool_or("explicit")).alias("inferred"))
        whole = placed.select("prompt_id", "node_id", "name", "description", "position").join(found, ["prompt_id", "node_id"]).join(direct, ["prompt_id", "node_id"])
        whole = cut(workflow.node_ids(whole))
        return workflow.documents(whole, order_edges, name)
