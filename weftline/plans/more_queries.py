"""Further queries: sources, sinks, candidates, rules, plans, prompt graphs and documents, each with SQL computed from the tables on its own way."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import relations as R
from ..functions import text as X
from ..functions import triplets as T3
from ..lineage import checkpoint_dir
from ..operators import beam, candidates, context, mining, prompt_graph, subgraph, traverse, workflow
from ..sources import documents as D
from ..sources import graph as G
from ..sources import schemas, sinks
from .queries import S_CLIENT, S_FK, S_LEX_BUILDER, S_NODES, S_RAW, S_RELEVANCE, S_TOK, QUERIES, SQL, fk_edges, query, r9, s_contradicts, s_cos01, s_jaccard, s_tokens_builder, table, transition_edges, vector_nodes, vector_steps


def shared(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- candidates

S_NEAR_LEX = f"list_max([{', '.join(s_jaccard(s_tokens_builder('s.text'), s_tokens_builder(x)) for x in ('n.name', 'n.brand', 'n.description'))}])"

SQL["context_candidates"] = (
    S_CLIENT
    + f""", b AS (SELECT step_id, rank, id, 0.45 * semantic + 0.35 * {S_LEX_BUILDER} + 0.20 * score AS s FROM k),
e AS (SELECT 2 * seq + o AS eseq, 'v' || seq AS source, 'v' || (seq + st) AS target, relation, {S_RELEVANCE}::DOUBLE AS rel FROM nodes, (VALUES (0, 1, 'OPERATION_PRECEDES'), (1, 7, 'ENTITY_OWNS')) x(o, st, relation) WHERE seq + st IN (SELECT seq FROM nodes)),
i AS (SELECT source AS seed, eseq, rel, unnest([0, 1]) AS ep, unnest([source, target]) AS id FROM e UNION ALL SELECT target, eseq, rel, unnest([0, 1]), unnest([source, target]) FROM e),
n1 AS (SELECT k.step_id, k.rank AS seed_rank, i.* FROM k JOIN i ON k.id = i.seed),
n2 AS (SELECT n1.* FROM n1 LEFT JOIN k ON n1.step_id = k.step_id AND n1.id = k.id WHERE k.id IS NULL),
n3 AS (SELECT n2.*, 0.50 * {s_cos01('s.query', 'n.embedding')} + 0.25 * {S_NEAR_LEX} + 0.25 * rel AS s FROM n2 JOIN steps s USING (step_id) JOIN nodes n ON n.id = n2.id),
n4 AS (SELECT * FROM n3 WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY step_id, id ORDER BY seed_rank, eseq, ep) = 1),
m AS (SELECT step_id, id, 'direct' AS source, s, NULL::DOUBLE AS rel, rank AS cr FROM b UNION ALL SELECT step_id, id, 'neighborhood', s, rel, 1000000 * seed_rank + 2 * eseq + ep FROM n4),
z AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY s DESC, source, cr) AS place FROM m QUALIFY place <= 10)
SELECT step_id AS prompt_id, place AS rank, id AS node_id, source, round(s, 9) AS score, round(rel, 9) AS relation_score FROM z"""
)


@query(
    S_RAW
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY similarity DESC, seq) AS rank FROM c QUALIFY rank <= 3)
SELECT step_id AS text_id, rank, round(similarity, 9) AS score, CASE WHEN similarity >= 0.70 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status, CASE WHEN similarity >= 0.70 THEN name END AS function_name,
CASE WHEN similarity >= 0.70 THEN name END AS inputs FROM k"""
)
def function_topk(spark, d):
    """The best three functions of each text, through the matcher; those below the threshold keep their score and are hidden."""
    f = vector_nodes(spark, d).select("seq", "name", "description", F.array("name").alias("inputs"), F.array("description").alias("outputs"), "embedding")
    q = vector_steps(spark, d).select(F.col("step_id").alias("text_id"), "text", "query")
    out = candidates.match_functions(q, f, 0.70, 3)
    return out.select("text_id", F.col("rank").cast("long").alias("rank"), r9("score").alias("score"), "status", "function_name", F.array_join("inputs", ",").alias("inputs"))


@query(S_CLIENT.replace("FROM t WHERE score > 0", "FROM t WHERE score > 0 AND node_type = 'Operation'") + " SELECT step_id, rank, id, round(score, 9) AS score FROM k")
def typed_candidates(spark, d):
    found = candidates.candidate_nodes(vector_steps(spark, d), vector_nodes(spark, d), 5, ["Operation"])
    return found.select("step_id", F.col("rank").cast("long").alias("rank"), "id", r9("score").alias("score"))


S_BACKWARDS = S_RAW.replace("SELECT seq AS step_id, name || ' ' || brand AS text, embedding AS query", "SELECT seq AS step_id, name || ' ' || brand AS text, list_reverse(embedding) AS query")


@query(
    S_BACKWARDS
    + """, k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY step_id ORDER BY similarity DESC, seq) = 1)
SELECT step_id AS prompt_id, id AS node_id, round(similarity, 9) AS score, similarity >= 0.4 AS accepted FROM k"""
)
def concept_matches(spark, d):
    """Each concept's best node, accepted or unmatched; concepts ask with vectors read backwards, so that none finds itself."""
    concepts = vector_steps(spark, d).select(F.col("step_id").alias("prompt_id"), F.lit("a").alias("id"), "text", F.reverse("query").alias("query"))
    yes, no = subgraph.best_matches(concepts, vector_nodes(spark, d), 0.4)
    return yes.withColumn("accepted", F.lit(True)).unionByName(no.withColumn("accepted", F.lit(False))).select("prompt_id", "node_id", r9("score").alias("score"), "accepted")


@query(f"WITH {S_NODES} SELECT (SELECT count(*) FROM steps) AS concepts, count(*) AS nodes, count(*) FILTER (WHERE len(embedding) > 0) AS embedded FROM nodes")
def match_diagnostics(spark, d):
    return subgraph.diagnostics(vector_steps(spark, d), vector_nodes(spark, d))


@query(
    """WITH l AS (SELECT l_orderkey AS prompt_id, 'p' || l_partkey AS node_id, l_discount::DOUBLE AS score, CASE WHEN l_returnflag = 'R' THEN 'direct' ELSE 'neighborhood' END AS source FROM lineitem),
b AS (SELECT prompt_id, node_id, max(score) AS best, bool_or(source = 'direct') AS direct FROM l GROUP BY 1, 2)
SELECT prompt_id, node_id, node_id AS name, round(best, 9) AS score, true AS inferred FROM b WHERE NOT direct
UNION ALL SELECT o_orderkey, 'o' || o_orderkey, 'o' || o_orderkey, 0.0, true FROM orders"""
)
def inferred_listing(spark, d):
    """Context nodes that are no direct candidate, with their best score, or 0 where they are no candidate at all."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("prompt_id"), F.concat(F.lit("p"), "l_partkey").alias("node_id"), F.col("l_discount").cast("double").alias("score"), F.when(F.col("l_returnflag") == "R", "direct").otherwise("neighborhood").alias("source"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.concat(F.lit("o"), "o_orderkey").alias("node_id"))
    nodes = c.select("prompt_id", "node_id").distinct().unionByName(own).withColumn("name", F.col("node_id"))
    return context.inferred_nodes(nodes, c).select("prompt_id", "node_id", "name", r9("score").alias("score"), "inferred")


# ---- rules and beams

S_RULES = f"""
n AS (SELECT count(*) AS n FROM benchmark),
b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, text AS rule, {S_TOK.format('text')} AS r FROM benchmark),
p AS (SELECT conv_id, turn, 'never ' || lower(trim(text)) AS low, {S_TOK.format("'never ' || text")} AS p, conv_id % n AS k FROM conversations, n)"""


@query(
    f"""WITH {S_RULES}, j AS (SELECT conv_id, turn, list_sort(list_intersect(p, r)) AS overlap, {s_contradicts('p', 'r')} AS bad FROM p JOIN b USING (k))
SELECT conv_id AS prompt_id, turn AS step_index, array_to_string(overlap, ' ') AS overlap_terms, 'RULE_CONSTRAINS' AS relation FROM j WHERE bad AND len(overlap) > 0"""
)
def rule_violations(spark, d):
    """Every turn refuses one operation; a rule node of its conversation constrains it."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("description"))
    n = b.count()
    rules = b.join(b.select("item_id").withColumn("k", F.row_number().over(Window.orderBy("item_id")).cast("long") - 1), "item_id")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("step_index"), F.lit("op").alias("node_id"), F.concat(F.lit("Never "), "text").alias("prompt_text"))
    plans = turns.select("prompt_id").distinct().withColumn("k", F.col("prompt_id") % n).join(rules, "k")
    nodes = plans.select("prompt_id", F.lit("rule").alias("node_id"), F.lit("").alias("name"), "description", F.expr(X.EMPTY).alias("aliases"))
    edges = plans.select("prompt_id", F.lit("rule").alias("source"), F.lit("op").alias("target"), F.lit("RULE_CONSTRAINS").alias("relation"))
    out = beam.violations(turns, nodes, edges).select("prompt_id", "step_index", F.explode("violations").alias("v"))
    return out.select("prompt_id", "step_index", F.array_join("v.overlap_terms", " ").alias("overlap_terms"), "v.relation")


@query(
    """WITH c AS (SELECT vec_id // 25 AS prompt_id, vec_id % 25 + 1 AS rank, 'v' || vec_id AS node_id, label, round(abs(embedding[1]::DOUBLE), 6) AS score FROM embeddings WHERE label % 5 <> 4),
x AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY rank) AS cr FROM c QUALIFY cr <= 10),
s AS (SELECT *, score + 0.15 - CASE WHEN label % 8 <> 0 THEN 0.75 ELSE 0.0 END AS s FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY s DESC, cr) AS place FROM s QUALIFY place <= 3)
SELECT prompt_id, place AS beam_rank, node_id AS selected, round(s, 6) AS score, (CASE WHEN label % 8 <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_violations FROM k"""
)
def beam_rules(spark, d):
    """Steps with up to 25 candidates, of which ten are tried; rules on some operations contradict the step."""
    v = F.col("vec_id")
    c = table(spark, d, "embeddings").select(
        F.floor(v / 25).alias("prompt_id"), F.lit(0).alias("step_index"), (v % 25 + 1).alias("rank"), F.concat(F.lit("v"), v).alias("node_id"), F.concat(F.lit("v"), v).alias("name"), "label",
        F.when(F.col("label") % 5 == 4, "DomainEntity").otherwise("Operation").alias("node_type"), F.round(F.abs(F.get(F.col("embedding").cast("array<double>"), F.lit(0))), 6).alias("score"),
        F.lit(True).alias("explicit"), F.lit("direct").alias("source"), F.lit("Skip the customer check").alias("prompt_text"),
    )
    ops = c.select("prompt_id", "node_id", "name", "node_type", F.lit("").alias("description"), F.expr(X.EMPTY).alias("aliases"))
    rules = c.where("label % 8 <> 0").select("prompt_id", F.concat(F.lit("r"), "node_id").alias("node_id"), F.lit("customer check").alias("name"), F.lit("Rule").alias("node_type"), F.lit("must come first").alias("description"), F.expr(X.EMPTY).alias("aliases"))
    edges = R.annotate(rules.select("prompt_id", F.col("node_id").alias("source"), F.substring("node_id", 2, 20).alias("target"), F.lit("RULE_CONSTRAINS").alias("relation")))
    found = beam.search(c, ops.unionByName(rules), edges)
    return found.where("size(selected_ids) > 0").select("prompt_id", F.col("beam_rank").cast("long").alias("beam_rank"), F.array_join("selected_ids", ",").alias("selected"), F.round("score", 6).alias("score"), F.size("violations").cast("long").alias("n_violations"))


# ---- plans

S_PAIRS = """
a AS (SELECT o_custkey AS prompt_id, o_orderkey AS ordinal, list(DISTINCT 's' || l_suppkey ORDER BY 's' || l_suppkey) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT *, lead(c) OVER (PARTITION BY prompt_id ORDER BY ordinal) AS nx FROM a)"""


@query(f"WITH {S_PAIRS}, p AS (SELECT prompt_id, ordinal, unnest(c) AS source, nx FROM n WHERE nx IS NOT NULL), q AS (SELECT prompt_id, ordinal, source, unnest(nx) AS target FROM p) SELECT * FROM q WHERE source <> target")
def action_pairs(spark, d):
    """Customers are plans, their orders actions, and suppliers the actions' candidates."""
    item = F.struct(F.concat(F.lit("s"), "l_suppkey").alias("domain_node_id"), F.lit("").alias("domain_node_name"), F.lit(1.0).alias("similarity"))
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = o.groupBy(F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("ordinal")).agg(F.array_sort(F.collect_set(item)).alias("candidates")).withColumn("prompt_node_id", F.col("ordinal").cast("string"))
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit(True).alias("executable"))
    return subgraph.candidate_pairs(subgraph.split_actions(a, nodes)).select("prompt_id", "ordinal", "source", "target")


@query(
    """WITH q AS (SELECT n_nationkey AS o, (n_nationkey + (n_nationkey - n_regionkey) // 5 * 3) % 9 AS q FROM nation),
a AS (SELECT o, unnest([0, 1]) AS i, 2 * unnest([q, (q + 2) % 9]) AS pos FROM q),
w AS (SELECT row_number() OVER (ORDER BY x.o, x.i, y.i) AS k, x.pos AS s, y.pos AS t FROM a x JOIN a y ON y.o = x.o + 1 WHERE x.pos <> y.pos),
e AS (SELECT c_custkey AS u, 1 + c_custkey % 7 AS w, c_custkey % 20 = 11 AS old FROM customer WHERE c_custkey % 20 <> 19 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)),
v AS (SELECT k, s, t, count(u) = abs(t - s) AND t > s AS there, sum(w) AS cost, CASE WHEN t < s OR count(u) < t - s THEN 'no path' WHEN t - s > 4 THEN 'path too long: ' || (t - s) || ' hops' WHEN bool_or(old) THEN 'path uses a deprecated edge' END AS reason
      FROM w LEFT JOIN e ON u >= s AND u < t GROUP BY k, s, t),
seen AS (SELECT v.k, e.u, bool_or(b.k IS NOT NULL) AS has FROM v JOIN e ON e.u >= v.s AND e.u < v.t LEFT JOIN v b ON b.k < v.k AND b.reason IS NULL AND e.u >= b.s AND e.u < b.t GROUP BY v.k, e.u),
joined AS (SELECT k FROM seen GROUP BY k HAVING bool_and(has))
SELECT row_number() OVER (ORDER BY k) - 1 AS at, 'c' || s AS source, 'c' || t AS target, CASE WHEN there THEN array_to_string(list_transform(range(s, t + 1), lambda x: 'c' || x), ' -> ') END AS path,
       CASE WHEN there THEN cost::DOUBLE END AS cost, reason FROM v WHERE k NOT IN (SELECT k FROM joined)"""
)
def reconnected_plan(spark, d):
    """Nations are one plan's actions, with two customers each as candidates; customers are chained in twenties. The report of every connection tried, in order."""
    q = (F.col("n_nationkey") + F.expr("(n_nationkey - n_regionkey) div 5") * 3) % 9
    item = lambda x: F.struct(F.concat(F.lit("c"), (x * 2).cast("string")).alias("domain_node_id"), F.lit("").alias("domain_node_name"), F.lit(1.0).alias("similarity"))
    plan = table(spark, d, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("prompt_node_id"), F.array(item(q), item((q + 2) % 9)).alias("candidates"))
    c = table(spark, d, "customer").select("c_custkey")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    k = F.col("c_custkey")
    e = c.where(k % 20 != 19).join(c.select((k - 1).alias("c_custkey")), "c_custkey", "left_semi")
    e = e.select(name(k).alias("source"), name(k + 1).alias("target"), F.lit("OPERATION_PRECEDES").alias("relation"), F.when(k % 20 == 11, "Deprecated").otherwise("mandatory").alias("edge_type"), (k % 7 + 1).alias("weight"))
    report = subgraph.build(plan, c.select(name(k).alias("id"), F.lit(True).alias("executable")), e, radius=0)["connections"]
    rows = [(i, r["source"], r["target"], " -> ".join(r["path"]) if r["path"] else None, r["cost"], r["reason"]) for i, r in enumerate(report)]
    return spark.createDataFrame(rows, "at long, source string, target string, path string, cost double, reason string")


@query(
    f"""WITH {S_FK}, w AS (SELECT source, target, 1.0 + length(source) % 3 AS w FROM edges)
SELECT a.source, c.target, (a.w + b.w + c.w)::DOUBLE AS cost, 3::BIGINT AS hops, concat_ws(' -> ', a.source, a.target, b.target, c.target) AS path
FROM w a JOIN w b ON a.target = b.source JOIN w c ON b.target = c.source WHERE a.source LIKE 'o%' AND c.target = 'r0'"""
)
def order_paths(spark, d):
    """The best path of every order to the first region, along foreign keys; orders that lead elsewhere have none."""
    e = fk_edges(spark, d).withColumn("weight", F.lit(1.0) + F.length("source") % 3)
    pairs = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.lit("r0").alias("target"))
    return traverse.shortest_paths(e, None, "dijkstra", pairs=pairs).select("source", "target", "cost", F.col("hops").cast("long").alias("hops"), X.path_text(F.col("path")).alias("path"))


@query(
    """WITH m AS (SELECT o_custkey AS prompt_id, o_orderkey::VARCHAR AS id, o_orderpriority AS node_id, o_totalprice::DOUBLE AS score, o_orderstatus || o_orderkey AS text FROM orders),
b AS (SELECT prompt_id, node_id, score, text FROM m QUALIFY row_number() OVER (PARTITION BY prompt_id, node_id ORDER BY score DESC, text DESC) = 1),
g AS (SELECT prompt_id, node_id, string_agg(text, '|' ORDER BY text) AS texts, count(*) AS n FROM m GROUP BY 1, 2)
SELECT prompt_id, node_id, round(score, 6) AS score, text, texts, n, n > 1 AS duplicate FROM b JOIN g USING (prompt_id, node_id)"""
)
def merged_matches(spark, d):
    """Several matches of one node are merged; the best text stays, and repeats are reported."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("node_id"), F.col("o_totalprice").cast("double").alias("score"), F.concat("o_orderstatus", "o_orderkey").alias("text"))
    none = spark.createDataFrame([], "prompt_id long, source string, target string")
    out = subgraph.match_paths(m, none, transition_edges(spark, d))
    twice = out["duplicates"].select("prompt_id", "node_id", F.lit(True).alias("duplicate"))
    return out["merged"].join(twice, ["prompt_id", "node_id"], "left").select("prompt_id", "node_id", F.round("score", 6).alias("score"), "text", F.array_join("texts", "|").alias("texts"), "n", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


@query(
    f"WITH {S_FK}, k AS (SELECT * FROM edges WHERE relation <> 'OPERATION_PRECEDES'), und AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), seeds AS (SELECT 'n' || n_nationkey AS id FROM nation), "
    "near AS (SELECT id FROM seeds UNION SELECT b FROM seeds JOIN und ON a = id), far AS (SELECT id FROM near UNION SELECT b FROM near JOIN und ON a = id) "
    "SELECT source, relation, target FROM k WHERE source IN (SELECT id FROM far) AND target IN (SELECT id FROM far)"
)
def induced_without_deprecated(spark, d):
    """Edges of one relation are deprecated: they spread the radius, but are no edges of the subgraph."""
    e = fk_edges(spark, d).withColumn("edge_type", F.when(F.col("relation") == "OPERATION_PRECEDES", "Deprecated").otherwise("mandatory"))
    seeds = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return traverse.induced(e, seeds, 2)[1].select("source", "relation", "target")


# ---- mining

S_WORKFLOWS = """
o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_type, min(i) AS i FROM o GROUP BY 1, 2),
x AS (SELECT f.user_id, f.event_type AS source, coalesce(o.event_type, 'Done') AS target FROM f LEFT JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)"""


def workflow_rows(spark, d):
    """A JSON cell for each user: event types are nodes, connected to what follows their first occurrence."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    first = e.withColumn("next", F.coalesce(nxt, F.lit("Done"))).groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "next")).alias("f"))
    by = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("f.event_id").alias("at"), "event_type", F.col("f.next").alias("next")))).alias("n"))
    node = F.transform("n", lambda x: F.struct(x["event_type"].alias("Id"), F.upper(x["event_type"]).alias("Name"), F.lit("Task").alias("Type")))
    links = F.map_from_entries(F.transform("n", lambda x: F.struct(x["event_type"], F.create_map(F.lit("success"), x["next"]))))
    cell = F.to_json(F.struct(F.lit("w").alias("Name"), F.get("n", F.lit(0))["event_type"].alias("StartNodeId"), node.alias("Nodes"), links.alias("Connections")))
    return by.select(F.col("user_id").alias("workflow_id"), cell.alias("WorkflowJson"))


@query(f"WITH {S_WORKFLOWS} SELECT user_id AS workflow_id, upper(source) AS source, upper(target) AS target, 'success' AS transition FROM x WHERE target <> 'Done'")
def workflow_transitions(spark, d):
    return mining.workflow_edges(mining.parse_workflows(workflow_rows(spark, d))).select("workflow_id", "source", "target", "transition")


@query(
    f"""WITH RECURSIVE {S_WORKFLOWS},
w AS (SELECT user_id, event_type AS at, [event_type] AS path FROM f WHERE i = 1
      UNION ALL SELECT w.user_id, x.target, list_append(path, x.target) FROM w JOIN x ON x.user_id = w.user_id AND x.source = w.at WHERE x.target <> 'Done' AND NOT list_contains(path, x.target)),
l AS (SELECT user_id, path FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY len(path) DESC) = 1)
SELECT upper(array_to_string(path, ' -> ')) AS path, count(*) AS frequency FROM l GROUP BY 1"""
)
def followed_paths(spark, d):
    """First transitions from each workflow's start until a node comes again or the workflow ends."""
    return mining.path_frequency(mining.follow(mining.parse_workflows(workflow_rows(spark, d))).select(X.path_text(F.col("path")).alias("path")))


# ---- text and prompt graphs


@query(
    """SELECT p_partkey, p_name || ' ' || p_type AS rule_text, trim(p_name || ' Part Item ' || p_brand || ' ' || p_type) AS record_text, p_name || ' p' || p_partkey AS bare_text FROM part"""
)
def record_texts(spark, d):
    """Rule texts, and node texts with the statements of their raw records."""
    c, none = F.col, F.lit(None).cast("string")
    p = table(spark, d, "part")
    said = lambda **of: F.struct(*[of.get(n, none).alias(n) for n in ("statement", "description", "summary")])
    raw = F.to_json(F.array(said(statement=c("p_brand"), description=F.lit("")), said(summary=c("p_type"))))
    return p.select(
        "p_partkey", X.rule_text(c("p_name"), c("p_type"), F.expr(X.EMPTY)).alias("rule_text"), X.node_text_records(c("p_name"), c("p_type"), F.array(F.lit("Part"), F.lit("Item")), raw).alias("record_text"),
        F.concat_ws(" ", X.node_text_records(c("p_name"), c("p_type"), F.expr(X.EMPTY), none), F.concat(F.lit("p"), "p_partkey")).alias("bare_text"),
    )


@query(
    """SELECT p_partkey, 1::BIGINT AS pos, p_name AS subject, 'made of' AS relation, p_type AS object FROM part
UNION ALL SELECT p_partkey, 2, p_name, 'sold as', p_brand FROM part UNION ALL SELECT p_partkey, 3, p_brand, 'holds', p_name FROM part"""
)
def extracted_triplets(spark, d):
    """Linearised replies of a relation extractor, with an incomplete triplet at the end."""
    c = F.col
    said = F.concat(F.lit("<s><triplet> "), c("p_name"), F.lit(" <subj> "), c("p_type"), F.lit(" <obj> made of <triplet> "), c("p_name"), F.lit(" <subj> "), c("p_brand"), F.lit(" <obj>  sold as <triplet> "), c("p_brand"), F.lit(" <subj> "), c("p_name"), F.lit(" <obj> holds <triplet> left <subj> over</s><pad>"))
    t = table(spark, d, "part").select("p_partkey", F.posexplode(T3.triplets(said)).alias("pos", "t"))
    return t.select("p_partkey", (c("pos") + 1).cast("long").alias("pos"), "t.subject", "t.relation", "t.object")


S_TURNS = """
a AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), e AS (SELECT conv_id, turn FROM conversations WHERE role <> 'user'),
n AS (SELECT e.conv_id, e.turn AS entity, a.turn AS action FROM e JOIN a USING (conv_id) QUALIFY row_number() OVER (PARTITION BY e.conv_id, e.turn ORDER BY abs(a.turn - e.turn), a.turn) = 1)"""


def turn_graph(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("ordinal"), F.col("turn").alias("token_index"), F.concat(F.lit("say "), F.col("turn") % 3).alias("lemma"), F.concat("role", "turn").alias("text"), "role")
    actions, entities = c.where("role = 'user'"), c.where("role <> 'user'")
    return prompt_graph.build(actions, entities, prompt_graph.sequence_relations(actions).withColumnRenamed("token_index", "seq"))


@query(
    f"""WITH {S_TURNS},
l AS (SELECT conv_id, turn, 'say ' || (turn % 3) AS lemma, lead('say ' || (turn % 3)) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM a),
f AS (SELECT conv_id, lemma, min(turn) AS turn FROM l GROUP BY 1, 2),
r AS (SELECT DISTINCT l.conv_id, x.turn AS s, y.turn AS t FROM l JOIN f x ON x.conv_id = l.conv_id AND x.lemma = l.lemma JOIN f y ON y.conv_id = l.conv_id AND y.lemma = l.nxt)
SELECT conv_id AS prompt_id, 'action:' || action AS source, 'entity:' || entity AS target, 'acts_on' AS relation FROM n
UNION ALL SELECT conv_id, 'action:' || s, 'action:' || t, 'sequence' FROM r"""
)
def prompt_graph_edges(spark, d):
    """Turns of users are actions, others entities; relations name lemmas and take the first action of that lemma."""
    return turn_graph(spark, d)[1].select("prompt_id", "source", "target", "relation")


@query(
    f"""WITH {S_TURNS}, g AS (SELECT n.conv_id, action, string_agg(role || entity, ' ' ORDER BY 'entity:' || entity) AS said FROM n JOIN conversations c ON c.conv_id = n.conv_id AND c.turn = n.entity GROUP BY 1, 2)
SELECT a.conv_id AS prompt_id, 'action:' || a.turn AS id, 'user' || a.turn AS name, concat_ws(' ', 'user' || a.turn, said) AS text FROM a LEFT JOIN g ON g.conv_id = a.conv_id AND g.action = a.turn"""
)
def concept_texts(spark, d):
    return prompt_graph.concepts(*turn_graph(spark, d)).select("prompt_id", "id", "name", F.trim("text").alias("text"))


# ---- sources and sinks


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, 'Customer' AS node_type, c_mktsegment AS description, 'Customer,' || c_mktsegment AS types, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS looked_up FROM customer")
def stored_graph(spark, d):
    """Nodes through the sink and back, keys checked, the last row of an id kept; a lookup by id marks some."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.array(F.lit("Customer"), "c_mktsegment").alias("types"), F.col("c_mktsegment").alias("description"), F.col("c_custkey").alias("seq"))
    edges = fk_edges(spark, d).select("source", "target", F.when(F.col("relation").startswith("operation"), "OPERATION_REQUIRES").otherwise(F.col("relation")).alias("type"))
    path = shared(spark, "graph")
    sinks.write_graph(rows, edges, path)
    nodes = G.read_nodes(spark, f"{path}/nodes")
    asked = nodes.where("CAST(id AS LONG) % 10 = 0").select(F.col("id").alias("asked"))
    out = nodes.join(asked, F.col("id") == F.col("asked"), "left")
    return out.select("id", "name", "node_type", "description", F.array_join("types", ",").alias("types"), F.when(F.col("asked").isNotNull(), 1).otherwise(0).alias("looked_up"))


@query(
    f"""WITH {S_FK} SELECT CASE WHEN relation = 'operation_requires ' THEN 'OPERATION_REQUIRES' ELSE relation END AS type, count(*) AS n, count(DISTINCT source) AS sources, min(target) AS first_target FROM edges GROUP BY 1"""
)
def stored_edges(spark, d):
    """Edges through the sink, partitioned by type, and back."""
    rows = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.array(F.lit("Region")).alias("types"))
    edges = fk_edges(spark, d).select("source", "target", F.upper(F.trim("relation")).alias("type"))
    path = shared(spark, "graph")
    sinks.write_graph(rows, edges, path)
    return sinks.read_graph(spark, path)[1].groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("target").alias("first_target"))


@query(
    """WITH o AS (SELECT o_orderkey::VARCHAR AS id, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, o_orderpriority AS condition FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT o_orderkey::VARCHAR AS id, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, CASE WHEN o_totalprice > 100000 THEN 'high' END AS condition FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND c_acctbal > 0)
SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, 'ORDERED_BY' AS type, coalesce(o.id, n.id) AS id, coalesce(n.condition, o.condition) AS condition
FROM o FULL JOIN n ON o.id = n.id AND o.source = n.source AND o.target = n.target"""
)
def upsert_edges(spark, d):
    """New edges replace values that are not null; those of unknown ends are dropped."""
    e = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"), F.lit("ORDERED_BY").alias("type"), F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority", "o_totalprice", "o_orderstatus")
    old = e.where("o_orderstatus <> 'P'").select("source", "target", "type", "id", F.col("o_orderpriority").alias("condition"))
    new = e.where("o_orderstatus <> 'F'").select("source", "target", "type", "id", F.when(F.col("o_totalprice") > 100000, "high").alias("condition"))
    nodes = e.select(F.col("source").alias("id")).unionByName(table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")))
    return sinks.upsert_edges(old, new, nodes)


@query("SELECT p_type AS name, '' AS description, 'part,' || p_type AS inputs, '' AS outputs, count(*) AS n FROM part GROUP BY p_type")
def function_catalogue(spark, d):
    """A JSON array of functions, one a part type; missing keys are empty."""
    path = shared(spark, "functions")
    item = F.struct(F.col("p_type").alias("name"), F.array(F.lit("part"), "p_type").alias("inputs"))
    table(spark, d, "part").select("p_type").distinct().agg(F.to_json(F.array_sort(F.collect_list(item)))).write.text(path)
    f = D.read_functions(spark, path)
    n = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return f.join(n, "name").select("name", "description", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"), "n")


@query(
    """SELECT r_regionkey::BIGINT AS def_index, 'REL_' || r_regionkey AS type, x AS raw_term, 'S' || r_regionkey AS source_types, 'T,U' AS target_types FROM region, (VALUES ('has'), ('owns')) v(x)"""
)
def ontology_terms(spark, d):
    """An ontology as the first JSON value of a file that goes on with prose."""
    path = shared(spark, "ontology")
    c = F.col("r_regionkey")
    item = F.struct(c.alias("k"), F.concat(F.lit("REL_"), c).alias("type"), F.array(F.lit("has"), F.lit("owns")).alias("raw_terms"), F.array(F.concat(F.lit("S"), c)).alias("source_types"), F.array(F.lit("T"), F.lit("U")).alias("target_types"))
    whole = F.struct(F.lit("1").alias("version"), F.array_sort(F.collect_list(item)).alias("relationships"))
    table(spark, d, "region").agg(F.concat(F.to_json(whole), F.lit("\nThis ontology was written for regions."))).write.text(path)
    t = D.ontology_terms(D.read_first_json(spark, path, schemas.ONTOLOGY))
    return t.select(F.col("def_index").cast("long").alias("def_index"), "type", "raw_term", F.array_join("source_types", ",").alias("source_types"), F.array_join("target_types", ",").alias("target_types"))


@query(f"WITH {S_NODES} SELECT id, name, node_type AS type, description, brand AS alias FROM nodes")
def model_context(spark, d):
    """What a model is told about each concept."""
    c = G.domain_context(vector_nodes(spark, d)).select(F.to_json("context").alias("j"))
    j = lambda p: F.get_json_object("j", p)
    return c.select(j("$.id").alias("id"), j("$.name").alias("name"), j("$.type").alias("type"), j("$.description").alias("description"), j("$.aliases[0]").alias("alias"))


@query(
    """SELECT o_orderkey::VARCHAR AS id, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'ORDERED_BY' AS type, 0::BIGINT AS relationship_index,
'[{"id":"' || o_orderkey || '","name":"' || o_orderstatus || '"}]' AS raw_records_json FROM orders"""
)
def flat_properties(spark, d):
    """Node and edge properties as they are stored: raw records as JSON with sorted keys, without nulls."""
    o = table(spark, d, "orders")
    record = F.array(F.struct(F.lit(None).cast("string").alias("statement"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").cast("string").alias("id")))
    n = sinks.node_properties(o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("").alias("name"), F.expr(X.EMPTY).alias("types"), F.expr(X.EMPTY).alias("raw_categories"), record.alias("raw_records")))
    none = F.lit(None).cast("string")
    e = sinks.edge_properties(o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"), F.lit("ORDERED_BY").alias("type"), none.alias("condition"), none.alias("raw_type"), F.lit(0).cast("long").alias("relationship_index")))
    return e.join(n, "id").select("id", "source", "target", "type", "relationship_index", "raw_records_json")


@query(
    """WITH n AS (SELECT conv_id, turn, role, conv_id || ':' || turn AS wid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, role = 'user' AS found FROM conversations),
i AS (SELECT conv_id, string_agg(x, ',' ORDER BY p) AS inputs FROM (SELECT conv_id, role AS x, min(position) AS p FROM n WHERE found GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT conv_id, arg_min(wid, position) AS start FROM n GROUP BY 1),
t AS (SELECT *, lead(wid) OVER (PARTITION BY conv_id ORDER BY position) AS nxt FROM n)
SELECT t.conv_id AS prompt_id, position, wid, role AS name, 'CustomNode' AS type, found, CASE WHEN found THEN 'f' || role END AS function_name, CASE WHEN found THEN role ELSE '' END AS inputs, start,
coalesce(i.inputs, '') AS workflow_inputs, coalesce(nxt, 'Done') AS after, '1.0' AS version FROM t JOIN s USING (conv_id) LEFT JOIN i USING (conv_id)"""
)
def workflow_parts(spark, d):
    """Workflow documents taken apart again: nodes with function details, start, inputs, and what each node leads to."""
    c = F.col
    n = table(spark, d, "conversations").select(
        c("conv_id").alias("prompt_id"), F.concat_ws(":", "conv_id", "turn").alias("node_id"), F.concat_ws(":", "conv_id", "turn").alias("wid"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("position"),
        c("role").alias("name"), F.lit("").alias("description"), F.lit(False).alias("inferred"), (c("role") == "user").alias("found"), F.when(c("role") == "user", F.concat(F.lit("f"), "role")).alias("function_name"),
        F.lit("").alias("function_description"), F.array("role").alias("inputs"), F.array(F.lit("out")).alias("outputs"), F.lit(1.0).alias("score"), F.lit("FOUND").alias("status"), c("role").alias("semantic_text"),
    )
    none = spark.createDataFrame([], "prompt_id long, source string, target string, relation string, seq long")
    w = workflow.documents(n, none).select("prompt_id", "StartNodeId", "Inputs", "Connections", "Version", F.posexplode("Nodes").alias("at", "n"))
    return w.select(
        "prompt_id", (c("at") + 1).alias("position"), c("n.Id").alias("wid"), c("n.Name").alias("name"), c("n.Type").alias("type"), c("n.FunctionDetails.Found").alias("found"), c("n.FunctionDetails.FunctionName").alias("function_name"),
        F.array_join("n.Inputs", ",").alias("inputs"), c("StartNodeId").alias("start"), F.array_join("Inputs", ",").alias("workflow_inputs"), F.element_at(F.element_at("Connections", c("n.Id")), "success").alias("after"), c("Version").alias("version"),
    )


ADDED = [n for n, f in QUERIES.items() if f.__module__ == __name__]
