"""The operators as queries over the tables of one folder, with SQL beside them.

Graphs are derived from the tables: embeddings joined with part are nodes with vectors, foreign keys are edges, conversations are plans, events are walks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import relations as R
from ..functions import text as X
from ..functions import vectors as V
from ..operators import beam, candidates, context, mining, ontology, prompt_graph, ranking, subgraph, traverse, workflow
from ..sources import graph as G
from ..sources import sinks

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r9(c) -> Column:
    return F.round(c, 9)


# ---- fragments of SQL


def s_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''))"


def s_tokens_builder(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(trim(replace(lower(coalesce({x}, '')), '_', ' ')), '\\s+'), lambda t: t <> ''))"


def s_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def s_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def s_norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def s_cos01(a: str, b: str) -> str:
    return f"least(1.0, greatest(0.0, ({s_dot(a, b)} / ({s_norm(a)} * {s_norm(b)}) + 1.0) / 2.0))"


S_NODES = """
nodes AS (SELECT vec_id AS seq, 'v' || vec_id AS id, coalesce(p_name, 'v' || vec_id) AS name, CASE WHEN label % 2 = 0 THEN 'Operation' ELSE 'DomainEntity' END AS node_type,
          coalesce(p_type, '') AS description, coalesce(p_brand, '') AS brand, embedding::DOUBLE[] AS embedding FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
steps AS (SELECT seq AS step_id, name || ' ' || brand AS text, embedding AS query FROM nodes WHERE seq % 50 = 0)"""


def vector_nodes(spark, d) -> DataFrame:
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    kind = F.when(F.col("label") % 2 == 0, "Operation").otherwise("DomainEntity")
    id_ = F.concat(F.lit("v"), F.col("vec_id"))
    return e.join(p, F.col("p_partkey") == F.col("vec_id"), "left").select(
        F.col("vec_id").alias("seq"), id_.alias("id"), F.coalesce("p_name", id_).alias("name"), kind.alias("node_type"), F.coalesce("p_type", F.lit("")).alias("description"),
        F.array(F.coalesce("p_brand", F.lit(""))).alias("aliases"), F.array(kind).alias("types"), V.doubles(F.col("embedding")).alias("embedding"),
    )


def vector_steps(spark, d) -> DataFrame:
    """The stated query set: rows whose id is divisible by 50, against all rows."""
    return vector_nodes(spark, d).where("seq % 50 = 0").select(F.col("seq").alias("step_id"), F.concat("name", F.lit(" "), F.get("aliases", F.lit(0))).alias("text"), F.col("embedding").alias("query"))


S_FK = """
edges AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'ENTITY_LINKED_TO' AS relation FROM nation
          UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'ACTOR_PERFORMS' FROM supplier
          UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'PROMPT_CONDITION' FROM customer
          UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'OPERATION_PRECEDES' ELSE 'operation_requires ' END FROM orders)"""


def fk_edges(spark, d) -> DataFrame:
    t = lambda n: table(spark, d, n)
    e = lambda df, a, ak, b, bk, rel: df.select(F.concat(F.lit(a), F.col(ak)).alias("source"), F.concat(F.lit(b), F.col(bk)).alias("target"), rel.alias("relation"))
    status = F.when(F.col("o_orderstatus") == "F", "OPERATION_PRECEDES").otherwise("operation_requires ")
    return (
        e(t("nation"), "n", "n_nationkey", "r", "n_regionkey", F.lit("ENTITY_LINKED_TO"))
        .unionByName(e(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", F.lit("ACTOR_PERFORMS")))
        .unionByName(e(t("customer"), "c", "c_custkey", "n", "c_nationkey", F.lit("PROMPT_CONDITION")))
        .unionByName(e(t("orders"), "o", "o_orderkey", "c", "o_custkey", status))
    )


# ---- similarity search

S_LEX_CLIENT = f"list_max([{', '.join(s_jaccard(s_tokens('s.text'), s_tokens(x)) for x in ('n.name', 'n.id', 'n.description', 'n.brand', 'n.node_type'))}])"
S_CLIENT = f"""
WITH {S_NODES},
c AS (SELECT step_id, n.*, s.text, s.query, {s_cos01('s.query', 'n.embedding')} AS semantic, {S_LEX_CLIENT} AS lexical FROM steps s, nodes n),
t AS (SELECT *, 0.70 * semantic + 0.30 * lexical AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, seq) AS rank FROM t WHERE score > 0 QUALIFY rank <= 5)"""


@query(S_CLIENT + " SELECT step_id, rank, id, node_type, round(score, 9) AS score, round(lexical, 9) AS lexical_score, round(semantic, 9) AS semantic_score FROM k")
def hybrid_candidates(spark, d):
    found = candidates.candidate_nodes(vector_steps(spark, d), vector_nodes(spark, d), 5)
    return found.select("step_id", F.col("rank").cast("long").alias("rank"), "id", "node_type", r9("score").alias("score"), r9("lexical_score").alias("lexical_score"), r9("semantic_score").alias("semantic_score"))


S_LEX_BUILDER = f"list_max([{', '.join(s_jaccard(s_tokens_builder('text'), s_tokens_builder(x)) for x in ('name', 'brand', 'description'))}])"


@query(
    S_CLIENT
    + f""", b AS (SELECT *, {S_LEX_BUILDER} AS lex FROM k)
SELECT step_id AS prompt_id, id AS node_id, node_type, round(0.45 * semantic + 0.35 * lex + 0.20 * score, 9) AS score, round(lex, 9) AS lexical_score FROM b"""
)
def direct_candidates(spark, d):
    steps = vector_steps(spark, d).select(F.col("step_id").alias("prompt_id"), F.lit(0).alias("step_index"), "text", F.lit(True).alias("explicit"), "query")
    return context.direct_candidates(steps, vector_nodes(spark, d), 5).select("prompt_id", "node_id", "node_type", r9("score").alias("score"), r9("lexical_score").alias("lexical_score"))


S_RAW = f"""
WITH {S_NODES},
c AS (SELECT step_id, n.seq, n.id, n.name, {s_dot('s.query', 'n.embedding')} / ({s_norm('s.query')} * {s_norm('n.embedding')}) AS similarity FROM steps s, nodes n)"""


@query(S_RAW + ", k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY similarity DESC, seq) AS rank FROM c QUALIFY rank <= 10) SELECT step_id, rank, id, round(similarity, 9) AS similarity FROM k WHERE similarity >= 0.35")
def topk_then_threshold(spark, d):
    return candidates.top_then_threshold(vector_steps(spark, d), vector_nodes(spark, d), 10, 0.35).select("step_id", F.col("rank").cast("long").alias("rank"), "id", r9("similarity").alias("similarity"))


@query(
    S_RAW
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY similarity DESC, seq) AS rank FROM c WHERE seq <> step_id QUALIFY rank <= 3)
SELECT step_id AS text_id, rank, round(similarity, 9) AS score, similarity >= 0.70 AS found, CASE WHEN similarity >= 0.70 THEN name END AS function_name FROM k"""
)
def function_match(spark, d):
    """The best three other functions of each text, those below the threshold hidden."""
    f = vector_nodes(spark, d).select("seq", "name", "embedding")
    q = vector_steps(spark, d).select(F.col("step_id").alias("text_id"), "query")
    other = candidates.nearest(q, f, 4, "text_id", "seq", ("query", "embedding")).where("seq <> text_id")  # the best three others are among the best four
    best = ranking.top_k(other, ["text_id"], [F.col("score").desc(), F.col("seq")], 3)
    return best.select("text_id", F.col("rank").cast("long").alias("rank"), r9("score").alias("score"), (F.col("score") >= 0.70).alias("found"), F.when(F.col("score") >= 0.70, F.col("name")).alias("function_name"))


@query(
    S_RAW
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY similarity DESC, seq) AS rank FROM c QUALIFY rank <= 1)
SELECT step_id AS text_id, name AS function_name, 'FOUND' AS status FROM k"""
)
def function_argmax(spark, d):
    f = vector_nodes(spark, d).select("seq", "name", "description", F.array("name").alias("inputs"), F.array("description").alias("outputs"), "embedding")
    q = vector_steps(spark, d).select(F.col("step_id").alias("text_id"), "text", "query")
    return candidates.match_functions(q, f).select("text_id", "function_name", "status")


# ---- text


@query(
    f"""
WITH q AS (SELECT p_partkey AS qk, p_name || ' ' || p_type AS text FROM part WHERE p_partkey % 50 = 0),
c AS (SELECT qk, p_partkey, greatest({s_jaccard(s_tokens('text'), s_tokens('p_name'))}, {s_jaccard(s_tokens('text'), s_tokens('p_brand'))}) AS client,
             greatest({s_jaccard(s_tokens_builder('text'), s_tokens_builder('p_name'))}, {s_jaccard(s_tokens_builder('text'), s_tokens_builder('p_type'))}) AS builder FROM q, part),
r AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY client DESC, p_partkey) AS rank FROM c QUALIFY rank <= 5)
SELECT qk, rank, p_partkey, round(client, 9) AS client, round(builder, 9) AS builder FROM r"""
)
def lexical_scores(spark, d):
    """Rows of equal token sets score alike, so that the first five of them are all that can be among a text's best five; equal texts are asked once."""
    c = F.col
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", X.token_parts(F.array("p_name", "p_brand")).alias("nt"), X.token_parts(F.array("p_name", "p_type"), X.token_set_builder).alias("nb"))
    text = F.concat("p_name", F.lit(" "), "p_type")
    q = p.where("p_partkey % 50 = 0").select(c("p_partkey").alias("qk"), X.token_set(text).alias("qt"), X.token_set_builder(text).alias("qb"))
    asked = q.select(F.struct("qt", "qb").alias("said"), "qt").distinct()
    scanned = ranking.top_k(p.select("p_partkey", "nt", "nb"), ["nt"], ["p_partkey"], 5, "_first").drop("_first")
    best = candidates.nearest(asked, scanned, 5, "said", "p_partkey", words=("qt", "nt")).select("said.*", "rank", "p_partkey", c("score").alias("client"), X.best_jaccard(c("said.qb"), c("nb")).alias("builder"))
    return q.join(best, ["qt", "qb"]).select("qk", F.col("rank").cast("long").alias("rank"), "p_partkey", r9("client").alias("client"), r9("builder").alias("builder"))


@query("SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents)")
def tokenise(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


S_STEPS = r"""
t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
p AS (SELECT *, CASE WHEN contains(t, ', then ') THEN string_split(t, ', then ') WHEN contains(t, ' then ') THEN string_split(t, ' then ') WHEN contains(t, ';') THEN string_split(t, ';') END AS parts FROM t),
s AS (SELECT conv_id, turn, role, t, CASE WHEN parts IS NULL THEN [t] ELSE list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS steps FROM p WHERE t IS NOT NULL),
e AS (SELECT conv_id, turn, role, t, steps, unnest(range(1, len(steps) + 1)) AS i FROM s)"""


@query(f"WITH {S_STEPS} SELECT conv_id, turn, i - 1 AS pos, steps[i] AS step, steps[1] AS intent FROM e")
def split_steps(spark, d):
    c = table(spark, d, "conversations").withColumn("steps", X.explicit_steps(F.col("text")))
    c = c.withColumn("intent", X.intent(F.col("text"), F.col("steps")))
    return c.select("conv_id", "turn", "intent", F.posexplode("steps").alias("pos", "step")).withColumn("pos", F.col("pos").cast("long"))


@query(
    rf"""WITH {S_STEPS},
n AS (SELECT conv_id, turn * 100000 + i AS pos, role = 'user' AS explicit, steps[i] AS step, trim(regexp_replace(lower(steps[i]), '\s+', ' ', 'g')) AS n FROM e)
SELECT conv_id, pos, explicit, step FROM n WHERE n <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, n ORDER BY explicit DESC, pos) = 1"""
)
def dedup_steps(spark, d):
    s = split_steps(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    s = s.select(F.col("conv_id").alias("prompt_id"), (F.col("turn") * 100000 + F.col("pos") + 1).alias("pos"), (F.col("role") == "user").alias("explicit"), F.col("step").alias("text"))
    return ranking.dedup_steps(s, X.norm_step(F.col("text"))).select(F.col("prompt_id").alias("conv_id"), "pos", "explicit", F.col("text").alias("step"))


def s_contradicts(p: str, r: str) -> str:
    """p and r are lists of tokens; the prompt is in column low."""
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    opposite = " OR ".join(f"(list_contains({r}, '{k}') AND list_has_any({p}, [{quoted(v)}]))" for k, v in X.OPPOSITES.items())
    negated = " OR ".join(f"contains(low, {quoted([m])})" for m in X.NEGATION_MARKERS)
    return f"(({opposite}) OR (({negated}) AND len(list_filter(list_intersect({p}, {r}), lambda x: NOT list_contains([{quoted(X.GENERIC_WORDS)}], x))) > 0))"


S_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(
    f"""
WITH n AS (SELECT count(*) AS n FROM benchmark),
b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, text AS rule, {S_TOK.format('text')} AS r FROM benchmark),
p AS (SELECT conv_id, turn, lower(trim(text)) AS low, {S_TOK.format('text')} AS p, conv_id % n AS k FROM conversations, n),
j AS (SELECT conv_id, turn, list_sort(list_intersect(p, r)) AS overlap, {s_contradicts('p', 'r')} AS bad FROM p JOIN b USING (k))
SELECT conv_id, turn, len(overlap)::BIGINT AS n_overlap, array_to_string(overlap, ' ') AS overlap_terms, bad AND len(overlap) > 0 AS violated, CASE WHEN bad AND len(overlap) > 0 THEN 0.75 ELSE 0.0 END::DOUBLE AS penalty FROM j"""
)
def contradiction(spark, d):
    """Each conversation is constrained by one benchmark item as its rule."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("rule"))
    n = b.count()
    ids = b.select("item_id").withColumn("k", F.row_number().over(Window.orderBy("item_id")).cast("long") - 1)
    rules = b.join(ids, "item_id")
    c = table(spark, d, "conversations").withColumn("k", F.col("conv_id") % n).join(rules, "k")
    terms = X.overlap_terms(F.col("text"), F.col("rule"))
    c = c.select("conv_id", "turn", terms.alias("o"), X.contradicts(F.col("text"), F.col("rule")).alias("bad"))
    bad = F.col("bad") & (F.size("o") > 0)
    return c.select("conv_id", "turn", F.size("o").cast("long").alias("n_overlap"), F.array_join("o", " ").alias("overlap_terms"), bad.alias("violated"), F.when(bad, beam.RULE_PENALTY).otherwise(0.0).alias("penalty"))


@query(
    r"""SELECT trim(regexp_replace(lower(o_orderpriority || '__' || o_orderstatus), '[_\-\s]+', ' ', 'g')) AS term, count(*) AS n FROM orders GROUP BY 1"""
)
def normalise_terms(spark, d):
    return table(spark, d, "orders").groupBy(X.norm_term(F.concat("o_orderpriority", F.lit("__"), "o_orderstatus")).alias("term")).agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, p_name || chr(10) || p_type || chr(10) || 'Inputs: ' || p_brand || ', ' || p_name AS function_text, p_name || ' ' || p_type || ' p' || p_partkey || ' ' || p_brand || ' Part' AS client_text,
p_name || ' ' || p_type || ' ' || p_brand AS builder_text, p_name || '. ' || p_type AS match_text FROM part"""
)
def text_forms(spark, d):
    c = F.col
    none = F.expr(X.EMPTY)
    return table(spark, d, "part").select(
        "p_partkey", X.function_text(c("p_name"), c("p_type"), F.array("p_brand", "p_name"), none).alias("function_text"),
        X.node_text_client(c("p_name"), c("p_type"), F.concat(F.lit("p"), "p_partkey"), F.array("p_brand"), F.array(F.lit("Part"))).alias("client_text"),
        X.node_text_builder(c("p_name"), c("p_type"), F.array("p_brand")).alias("builder_text"), X.match_text(c("p_name"), F.lit(None), F.lit(None), c("p_type")).alias("match_text"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props AS recovered FROM events")
def json_recover(spark, d):
    """Event properties behind fences and prose, as a model would reply."""
    wrapped = F.concat(F.lit("```json\nHere you are: "), F.col("props"), F.lit("\n```"))
    e = table(spark, d, "events").select("event_id", X.recover_json(wrapped).alias("recovered"))
    return e.select("event_id", F.get_json_object("recovered", "$.k").cast("long").alias("k"), "recovered")


# ---- relations


def s_case(x: str, values: dict, default) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {q(default)} END"


def s_semantics(i: int) -> str:
    dom = s_case("relation", {r[0]: r[i] for r in R.DOMAIN_RELATIONS}, R.DOMAIN_DEFAULT[i - 1])
    pro = s_case("relation", {r[0]: r[i] for r in R.PROMPT_RELATIONS}, R.PROMPT_DEFAULT[i - 1])
    return f"CASE WHEN starts_with(relation, 'PROMPT_') THEN {pro} ELSE {dom} END"


S_RELEVANCE = s_case(s_case("relation", {r[0]: r[3] for r in R.DOMAIN_RELATIONS}, "OPTIONAL"), R.RELEVANCE, R.RELEVANCE_DEFAULT)
S_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(
    f"""WITH {S_FK}, a AS (SELECT *, {s_semantics(1)} AS edge_type, {s_semantics(2)}::DOUBLE AS weight, {s_semantics(3)} AS classification, {s_semantics(4)} AS ordering, {S_RELEVANCE}::DOUBLE AS relevance,
{s_case('upper(trim(relation))', {r[0]: r[1] for r in R.ROUTING_RELATIONS}, 'optional')} AS routing_type, {s_case('upper(trim(relation))', {r[0]: r[2] for r in R.ROUTING_RELATIONS}, 5)}::BIGINT AS routing_weight FROM edges)
SELECT source, target, relation, edge_type, weight, classification, ordering, relevance, routing_type, routing_weight,
CASE WHEN relation IN ({S_IN(R.ORDERING)}) THEN 0.25 WHEN relation IN ({S_IN(R.STRUCTURAL)}) THEN 0.12 ELSE {s_case('classification', R.CLASS_BONUS, 0.0)} END::DOUBLE AS compatibility FROM a"""
)
def relation_semantics(spark, d):
    e = R.annotate(fk_edges(spark, d)).withColumn("r", R.routing(F.col("relation")))
    return e.select(
        "source", "target", "relation", "edge_type", "weight", "classification", F.col("traverses_for_ordering").alias("ordering"), R.relevance(F.col("relation")).alias("relevance"),
        F.col("r.edge_type").alias("routing_type"), F.col("r.weight").cast("long").alias("routing_weight"), R.compatibility(F.col("relation"), F.col("classification")).alias("compatibility"),
    )


@query(
    f"""WITH c AS (SELECT event_id, CASE WHEN value > 50 THEN ' Deprecated ' WHEN value > 20 THEN 'OPTIONAL' ELSE event_type END AS transition FROM events),
t AS (SELECT event_id, transition, CASE WHEN lower(trim(transition)) IN ({S_IN([k for k, _ in R.EDGE_WEIGHTS])}) THEN lower(trim(transition)) ELSE 'mandatory' END AS migrated FROM c)
SELECT event_id, transition AS relation, 'mandatory' AS edge_type, 1::BIGINT AS weight, migrated, {s_case('migrated', dict(R.EDGE_WEIGHTS), 1)}::BIGINT AS migrated_weight FROM t"""
)
def edge_weights(spark, d):
    kind = F.when(F.col("value") > 50, " Deprecated ").when(F.col("value") > 20, "OPTIONAL").otherwise(F.col("event_type"))
    e = R.edge_attributes(table(spark, d, "events").select("event_id", kind.alias("transition")))
    none = F.lit(None).cast("string")
    e = e.withColumn("migrated", R.migrated_category(none, none, F.col("transition")))
    return e.select("event_id", "relation", "edge_type", F.col("weight").cast("long").alias("weight"), "migrated", R.category_weight(F.col("migrated")).cast("long").alias("migrated_weight"))


# ---- traversal

S_REGION_SEEDS = "seeds AS (SELECT 'r' || r_regionkey AS id FROM region)"


@query(f"WITH {S_FK}, {S_REGION_SEEDS} SELECT DISTINCT id AS seed, source, relation, target FROM seeds JOIN edges ON id IN (source, target)")
def neighbourhood_1(spark, d):
    seeds = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return traverse.neighbourhood(fk_edges(spark, d), seeds, 1)


S_UND = "und AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)"


@query(
    f"WITH {S_FK}, {S_REGION_SEEDS}, {S_UND}, near AS (SELECT id AS seed, id FROM seeds UNION SELECT seeds.id, b FROM seeds JOIN und ON a = id) "
    "SELECT DISTINCT seed, source, relation, target FROM (SELECT seed, source, relation, target FROM near JOIN edges ON id = source UNION ALL SELECT seed, source, relation, target FROM near JOIN edges ON id = target)"
)
def neighbourhood_2(spark, d):
    seeds = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return traverse.neighbourhood(fk_edges(spark, d), seeds, 2)


@query(
    f"WITH {S_FK}, {S_REGION_SEEDS}, {S_UND}, near AS (SELECT id FROM seeds UNION SELECT b FROM seeds JOIN und ON a = id), far AS (SELECT id FROM near UNION SELECT b FROM near JOIN und ON a = id) "
    "SELECT source, relation, target FROM edges WHERE source IN (SELECT id FROM far) AND target IN (SELECT id FROM far)"
)
def radius_induced(spark, d):
    seeds = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return traverse.induced(fk_edges(spark, d), seeds, 2)[1].select("source", "relation", "target")


S_TRANS = """
l AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
tr AS (SELECT source, target, count(*) AS n FROM l WHERE target IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {S_TRANS} SELECT source, target, n, source || ' -> ' || target AS path FROM tr")
def transitions(spark, d):
    return mining.event_transitions(table(spark, d, "events")).withColumn("path", X.path_text(F.array("source", "target")))


def transition_edges(spark, d) -> DataFrame:
    return mining.event_transitions(table(spark, d, "events")).where("source <> target").select("source", "target", F.lit("success").alias("relation"), (1 + F.col("n") % 7).alias("weight"))


def s_paths(weight: str) -> str:
    return f"""
WITH RECURSIVE {S_TRANS}, e AS (SELECT source, target, {weight} AS w FROM tr WHERE source <> target),
p AS (SELECT source, target, w AS cost, 1 AS hops, [source, target] AS path FROM e
      UNION ALL SELECT p.source, e.target, cost + w, hops + 1, list_append(path, e.target) FROM p JOIN e ON p.target = e.source WHERE NOT list_contains(path, e.target))
SELECT source, target, cost::DOUBLE AS cost, hops::BIGINT AS hops, array_to_string(path, ' -> ') AS path FROM p QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY cost, hops, path) = 1"""


def all_paths(spark, d, by):
    e = transition_edges(spark, d)
    found = traverse.shortest_paths(e, e.select(F.col("source").alias("id")), by)
    return found.select("source", "target", "cost", F.col("hops").cast("long").alias("hops"), X.path_text(F.col("path")).alias("path"))


@query(s_paths("1 + n % 7"))
def dijkstra_paths(spark, d):
    return all_paths(spark, d, "dijkstra")


@query(s_paths("1"))
def bfs_paths(spark, d):
    return all_paths(spark, d, "bfs")


@query(f"WITH {S_TRANS} SELECT CASE WHEN count(DISTINCT 1 + n % 7) <= 1 THEN 'bfs' ELSE 'dijkstra' END AS strategy, count(*) AS n_edges FROM tr WHERE source <> target")
def path_strategy(spark, d):
    e = transition_edges(spark, d)
    return e.agg(F.count("*").alias("n_edges")).select(F.lit(traverse.strategy(e)).alias("strategy"), "n_edges")


def conversation_plans(spark, d) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations")
    id_ = lambda c: F.concat(F.lit("t"), c)
    nodes = c.select(F.col("conv_id").alias("plan_id"), id_(F.col("turn")).alias("id"), F.col("turn").alias("seq")).distinct()
    have = nodes.select("plan_id", F.col("id").alias("target"))
    e = c.select(F.col("conv_id").alias("plan_id"), id_(F.col("turn")).alias("source"), "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    e = e.select("plan_id", "source", id_(F.col("turn") + F.col("step")).alias("target"), (2 * F.col("turn") + F.col("step")).alias("seq")).distinct()
    return nodes, e.join(have, ["plan_id", "target"], "left_semi")


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn AS s, b.turn AS t FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn - a.turn IN (1, 2)),
l AS (SELECT conv_id, turn, 0 AS level FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = n.conv_id AND t = turn) UNION SELECT e.conv_id, t, level + 1 FROM l JOIN e ON l.conv_id = e.conv_id AND turn = s),
m AS (SELECT conv_id, turn, max(level) AS level FROM l GROUP BY 1, 2)
SELECT conv_id AS plan_id, 't' || turn AS id, level::BIGINT AS level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) AS position FROM m"""
)
def topological_levels(spark, d):
    order = traverse.plan_order(*conversation_plans(spark, d))
    return order.select("plan_id", "id", F.col("level").cast("long").alias("level"), F.col("position").cast("long").alias("position"))


@query(
    """WITH RECURSIVE l AS (SELECT user_id, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
e AS (SELECT DISTINCT user_id, s, t FROM l WHERE t IS NOT NULL AND s < t OR (t IS NOT NULL AND user_id % 2 = 0 AND s <> t)),
r AS (SELECT user_id, s, t FROM e UNION SELECT r.user_id, r.s, e.t FROM r JOIN e ON r.user_id = e.user_id AND r.t = e.s),
c AS (SELECT user_id, s AS v FROM r WHERE s = t),
into_ AS (SELECT user_id, v FROM c UNION SELECT r.user_id, r.t FROM r JOIN c ON r.user_id = c.user_id AND r.s = c.v),
out_ AS (SELECT user_id, v FROM c UNION SELECT r.user_id, r.s FROM r JOIN c ON r.user_id = c.user_id AND r.t = c.v)
SELECT e.user_id AS plan_id, s AS source, t AS target FROM e JOIN into_ i ON i.user_id = e.user_id AND i.v = s JOIN out_ o ON o.user_id = e.user_id AND o.v = t"""
)
def cycle_edges(spark, d):
    ev = table(spark, d, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = ev.select("user_id", F.col("event_type").alias("source"), nxt.alias("target")).where("target IS NOT NULL")
    e = e.where("source < target OR (user_id % 2 = 0 AND source <> target)").distinct().select(F.col("user_id").alias("plan_id"), "source", "target", F.xxhash64("source", "target").alias("seq"))
    nodes = ev.select(F.col("user_id").alias("plan_id"), F.col("event_type").alias("id")).distinct().withColumn("seq", F.xxhash64("id"))
    return traverse.topological_order(nodes, e)[1]


@query("SELECT 'n' || n_nationkey AS id, 1::BIGINT AS out_degree, 'r' || n_regionkey || ':ENTITY_LINKED_TO' AS neighbours FROM nation UNION ALL SELECT 'r' || n_regionkey, count(*), string_agg('n' || n_nationkey || ':ENTITY_LINKED_TO', ',' ORDER BY n_nationkey) FROM nation GROUP BY 1")
def adjacency(spark, d):
    e = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("ENTITY_LINKED_TO").alias("relation"), F.col("n_nationkey").alias("seq"))
    both = traverse.adjacency(e).unionByName(traverse.adjacency(e, "target", "source"))
    return both.select("id", F.size("neighbours").cast("long").alias("out_degree"), F.array_join(F.transform("neighbours", lambda x: F.concat(x["id"], F.lit(":"), x["relation"])), ",").alias("neighbours"))


# ---- ontology and store

TERMS = [
    (0, "ACTOR_PERFORMS", ["performs", "carries out"], ["Actor"], ["Operation", "DomainEntity"]),
    (1, "ENTITY_OWNS", ["belongs_to", "owns"], ["Actor", "DomainEntity"], ["DomainEntity"]),
    (2, "OPERATION_REQUIRES", ["depends on", "requires"], ["Operation"], ["Rule"]),
    (3, "OPERATION_ACCEPTS", ["Depends-On", "accepts"], ["Operation"], ["DomainEntity"]),
    (4, "RULE_CONSTRAINS", ["governs"], ["Rule"], ["Operation"]),
]


def raw_graph(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, relationships and terms: suppliers are actors, orders operations, customers and nations entities; regions are left out, so nations' links are unresolved."""
    t = lambda n: table(spark, d, n)
    rec = lambda df, p, k, name, cat, typ: df.select(F.col(k).cast("long").alias("seq"), F.concat(F.lit(p), k).alias("id"), F.col(name).alias("name"), F.lit(None).cast("string").alias("statement"), F.lit(cat).alias("category"), F.lit(typ).alias("type"))
    records = rec(t("supplier"), "s", "s_suppkey", "s_name", "actors", "Actor").unionByName(rec(t("orders"), "o", "o_orderkey", "o_orderpriority", "operations", "Operation")).unionByName(rec(t("customer"), "c", "c_custkey", "c_name", "entities", "DomainEntity")).unionByName(rec(t("nation"), "n", "n_nationkey", "n_name", "entities", "DomainEntity"))
    word = F.when(F.col("source").startswith("o"), F.when(F.col("relation") == "OPERATION_PRECEDES", "depends_on").otherwise("Governs")).when(F.col("source").startswith("s"), "Performs").when(F.col("source").startswith("c"), "belongs-to").otherwise("is in")
    rels = fk_edges(spark, d).select(F.col("source").alias("relationship_index"), "source", "target", word.alias("raw_type"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("condition"))
    terms = spark.createDataFrame(TERMS, "def_index int, type string, terms array<string>, source_types array<string>, target_types array<string>").select("def_index", "type", F.explode("terms").alias("raw_term"), "source_types", "target_types")
    return records, rels, terms


@query(
    """SELECT 'o' || o_orderkey AS source, CASE WHEN o_orderstatus = 'F' THEN 'edge' ELSE 'invalid' END AS outcome, CASE WHEN o_orderstatus = 'F' THEN 'OPERATION_ACCEPTS' ELSE 'RULE_CONSTRAINS' END AS detail FROM orders
UNION ALL SELECT 's' || s_suppkey, 'edge', 'ACTOR_PERFORMS' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'edge', 'ENTITY_OWNS' FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'unresolved', 'r' || n_regionkey FROM nation"""
)
def ontology_map(spark, d):
    records, rels, terms = raw_graph(spark, d)
    out = ontology.map_relationships(rels, ontology.group_nodes(records), terms)
    rows = lambda k, detail: out[k].select("source", F.lit({"edges": "edge"}.get(k, k)).alias("outcome"), detail.alias("detail"))
    return rows("edges", F.col("type")).unionByName(rows("invalid", F.array_join("candidate_types", ","))).unionByName(rows("unresolved", F.array_join("missing_node_ids", ","))).unionByName(rows("unmapped", F.col("raw_type")))


@query(
    """SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS raw_node_count,
(SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS mapped_node_count,
(SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS raw_relationship_count,
(SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') + (SELECT count(*) FROM customer) AS mapped_relationship_count"""
)
def map_summary(spark, d):
    records, rels, terms = raw_graph(spark, d)
    nodes = ontology.group_nodes(records)
    return ontology.summary(records, rels, nodes, ontology.map_relationships(rels, nodes, terms)["edges"])


S_MULTI = """
r AS (SELECT c_custkey AS seq, c_custkey::VARCHAR AS id, c_name AS name, 'entities' AS category, 'DomainEntity' AS type FROM customer
      UNION ALL SELECT s_suppkey + 1000000000, s_suppkey::VARCHAR, s_name, 'actors', 'Actor' FROM supplier)"""


def multi_records(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("statement"), F.lit("entities").alias("category"), F.lit("DomainEntity").alias("type"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("seq"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("statement"), F.lit("actors").alias("category"), F.lit("Actor").alias("type"))
    return c.unionByName(s)


@query(f"WITH {S_MULTI} SELECT id, arg_min(name, seq) AS name, array_to_string(list_sort(list_distinct(list(type))), ',') AS types, count(*) AS raw_record_count FROM r GROUP BY id")
def group_by_id(spark, d):
    return ontology.group_nodes(multi_records(spark, d)).select("id", "name", F.array_join("types", ",").alias("types"), "raw_record_count")


@query(f"WITH {S_MULTI} SELECT id, array_to_string(list_sort(list_distinct(list(type))), ',') AS types, count(*) AS raw_record_count FROM r GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return ontology.duplicate_ids(ontology.group_nodes(multi_records(spark, d))).select("id", F.array_join("types", ",").alias("types"), "raw_record_count")


@query(f"WITH {S_MULTI}, g AS (SELECT id, array_to_string(list_sort(list_distinct(list(type))), ',') AS labels FROM r GROUP BY id) SELECT labels, count(*) AS n FROM g GROUP BY labels")
def label_sets(spark, d):
    return sinks.label_sets(ontology.group_nodes(multi_records(spark, d))).select(F.array_join("labels", ",").alias("labels"), "n")


@query("SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def upsert_nodes(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return sinks.upsert(old, new, ["id"])


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS node_type, c_mktsegment || ',Customer' AS types FROM customer")
def node_decode(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("types"), F.array(F.lit("GraphNode"), F.col("c_mktsegment"), F.lit("Customer")).alias("labels"))
    return G.decode_nodes(rows).select("id", "name", "node_type", F.array_join("types", ",").alias("types"))


@query(
    f"""WITH {S_FK}, known AS (SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation)
SELECT source, target, relation, {s_case('upper(trim(relation))', {r[0]: r[1] for r in R.ROUTING_RELATIONS}, 'optional')} AS edge_type, {s_case('upper(trim(relation))', {r[0]: r[2] for r in R.ROUTING_RELATIONS}, 5)}::BIGINT AS weight,
upper(trim(relation)) IN ({S_IN(R.ROUTING_CONTEXT)}) AS context, starts_with(source, 'o') AS from_operation FROM edges WHERE source IN (SELECT id FROM known) AND target IN (SELECT id FROM known)"""
)
def planner_graph(spark, d):
    t = lambda n, p, k, typ: table(spark, d, n).select(F.concat(F.lit(p), k).alias("id"), F.lit(None).cast("string").alias("name"), F.array(F.lit(typ)).alias("types"))
    rows = t("orders", "o", "o_orderkey", "Operation").unionByName(t("customer", "c", "c_custkey", "DomainEntity")).unionByName(t("nation", "n", "n_nationkey", "DomainEntity"))
    e = fk_edges(spark, d).select(F.concat_ws("|", "source", "target").alias("id"), "source", "target", F.col("relation").alias("type"), F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("raw_type"))
    nodes, edges = G.planner_graph(rows, e)
    out = edges.join(nodes.select(F.col("id").alias("source"), F.col("executable").alias("from_operation")), "source")
    return out.select("source", "target", "relation", "edge_type", F.col("weight").cast("long").alias("weight"), "context", "from_operation")


# ---- mining and prompts


@query("SELECT event_type AS name, count(*) AS count FROM events GROUP BY 1")
def node_counts(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("name"), F.lit("event").alias("type"), F.col("event_id").alias("seq"))
    return mining.node_counts(rows).select("name", "count")


@query(
    """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, min(CASE WHEN r = 2 THEN i END) AS stop FROM o GROUP BY 1),
p AS (SELECT o.user_id, string_agg(event_type, ' -> ' ORDER BY i) AS path FROM o JOIN s USING (user_id) WHERE stop IS NULL OR i < stop GROUP BY 1)
SELECT path, count(*) AS frequency FROM p GROUP BY 1"""
)
def path_frequency(spark, d):
    return mining.path_frequency(mining.event_paths(table(spark, d, "events")).select(X.path_text(F.col("path")).alias("path")))


@query(
    """WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), e AS (SELECT conv_id, turn FROM conversations WHERE role <> 'user')
SELECT e.conv_id AS prompt_id, e.turn AS entity, a.turn AS action, abs(a.turn - e.turn) AS distance FROM e JOIN a USING (conv_id) QUALIFY row_number() OVER (PARTITION BY e.conv_id, e.turn ORDER BY abs(a.turn - e.turn), a.turn) = 1"""
)
def nearest_token(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("ordinal"), F.col("turn").alias("token_index"), "role")
    return prompt_graph.nearest_actions(c.where("role <> 'user'"), c.where("role = 'user'"))


@query(
    "WITH l AS (SELECT user_id AS prompt_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events) SELECT DISTINCT prompt_id, source, target, 'sequence' AS relation FROM l WHERE target IS NOT NULL"
)
def sequence_relations(spark, d):
    return prompt_graph.sequence_relations(table(spark, d, "events").select(F.col("user_id").alias("prompt_id"), F.col("event_type").alias("lemma"), F.col("event_id").alias("token_index"))).drop("token_index")


# ---- planning

S_PLAN = """
c AS (SELECT vec_id // 10 AS prompt_id, ((vec_id % 10) // 5)::BIGINT AS step_index, vec_id % 5 + 1 AS rank, 'v' || vec_id AS node_id, vec_id, CASE WHEN label % 5 = 4 THEN 'DomainEntity' ELSE 'Operation' END AS node_type,
             round(abs(embedding[1]::DOUBLE) + vec_id % 7 / 10.0, 6) AS score, vec_id % 3 <> 0 AS explicit, CASE WHEN vec_id % 4 = 3 THEN 'neighborhood' ELSE 'direct' END AS source FROM embeddings),
e AS (SELECT a.prompt_id, a.node_id AS s, b.node_id AS t, a.node_type AS st, b.node_type AS tt, CASE (a.vec_id + b.vec_id) % 4 WHEN 0 THEN 'OPERATION_PRECEDES' WHEN 1 THEN 'OPERATION_INCLUDES' WHEN 2 THEN 'OPERATION_REQUIRES' ELSE 'ACTOR_PERFORMS' END AS relation
      FROM c a JOIN c b ON a.prompt_id = b.prompt_id AND a.step_index = 0 AND b.step_index = 1 AND (a.vec_id + b.vec_id) % 3 = 0)"""


def plan_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = F.col("vec_id")
    c = table(spark, d, "embeddings").select(
        F.floor(v / 10).alias("prompt_id"), F.floor((v % 10) / 5).alias("step_index"), (v % 5 + 1).alias("rank"), F.concat(F.lit("v"), v).alias("node_id"), F.concat(F.lit("v"), v).alias("name"), "vec_id",
        F.when(F.col("label") % 5 == 4, "DomainEntity").otherwise("Operation").alias("node_type"), F.round(F.abs(F.get(V.doubles(F.col("embedding")), F.lit(0))) + v % 7 / 10.0, 6).alias("score"),
        (v % 3 != 0).alias("explicit"), F.when(v % 4 == 3, "neighborhood").otherwise("direct").alias("source"), F.lit("do it").alias("prompt_text"),
    )
    nodes = c.select("prompt_id", "node_id", "name", "node_type", F.lit("").alias("description"), F.expr(X.EMPTY).alias("aliases"))
    a, b = c.where("step_index = 0").alias("a"), c.where("step_index = 1").alias("b")
    total = F.col("a.vec_id") + F.col("b.vec_id")
    rel = F.when(total % 4 == 0, "OPERATION_PRECEDES").when(total % 4 == 1, "OPERATION_INCLUDES").when(total % 4 == 2, "OPERATION_REQUIRES").otherwise("ACTOR_PERFORMS")
    e = a.join(b, F.col("a.prompt_id") == F.col("b.prompt_id")).where(total % 3 == 0).select(F.col("a.prompt_id").alias("prompt_id"), F.col("a.node_id").alias("source"), F.col("b.node_id").alias("target"), rel.alias("relation"))
    return c, nodes, R.annotate(e)


S_BEAM = f"""
WITH {S_PLAN},
x AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, step_index ORDER BY rank) AS cr, (CASE WHEN explicit AND source = 'direct' THEN 0.15 ELSE 0.0 END) AS bonus, (CASE WHEN source = 'neighborhood' THEN 0.03 ELSE 0.0 END) AS pen FROM c WHERE node_type = 'Operation'),
b1 AS (SELECT prompt_id, node_id AS n1, score + bonus - pen AS s1, row_number() OVER (PARTITION BY prompt_id ORDER BY score + bonus - pen DESC, cr) AS br FROM x WHERE step_index = 0 QUALIFY br <= 3),
r AS (SELECT prompt_id, s, t, max(CASE relation WHEN 'OPERATION_PRECEDES' THEN 0.25 WHEN 'OPERATION_INCLUDES' THEN 0.12 WHEN 'OPERATION_REQUIRES' THEN 0.25 ELSE 0.03 END) AS compat, max(CASE relation WHEN 'OPERATION_PRECEDES' THEN 0.2 WHEN 'OPERATION_INCLUDES' THEN 0.12 ELSE 0.1 END) AS conn FROM e GROUP BY 1, 2, 3),
g AS (SELECT b1.prompt_id, n1, x.node_id AS n2, br, cr, s1 + x.score + coalesce(compat, 0) + coalesce(conn, 0) + bonus - pen - CASE WHEN conn IS NULL THEN 0.15 ELSE 0.0 END AS s2
      FROM b1 JOIN x ON x.prompt_id = b1.prompt_id AND x.step_index = 1 LEFT JOIN r ON r.prompt_id = b1.prompt_id AND s = n1 AND t = x.node_id),
b2 AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY round(s2, 9) DESC, br, cr) AS k FROM g QUALIFY k <= 3)"""


@query(
    S_BEAM
    + """ SELECT prompt_id, k AS beam_rank, n1 || ',' || n2 AS selected, round(s2, 6) AS score FROM b2
UNION ALL SELECT prompt_id, br, n1, round(s1, 6) FROM b1 WHERE prompt_id NOT IN (SELECT prompt_id FROM b2)
UNION ALL SELECT x.prompt_id, row_number() OVER (PARTITION BY x.prompt_id ORDER BY score + bonus - pen DESC, cr), node_id, round(score + bonus - pen, 6) FROM x WHERE step_index = 1 AND prompt_id NOT IN (SELECT prompt_id FROM b1) QUALIFY row_number() OVER (PARTITION BY x.prompt_id ORDER BY score + bonus - pen DESC, cr) <= 3
UNION ALL SELECT DISTINCT prompt_id, 1, '', 0.0 FROM c WHERE prompt_id NOT IN (SELECT prompt_id FROM x)"""
)
def beam_search(spark, d):
    found = beam.search(*plan_tables(spark, d))
    return found.select("prompt_id", F.col("beam_rank").cast("long").alias("beam_rank"), F.array_join("selected_ids", ",").alias("selected"), F.round("score", 6).alias("score"))


@query(f"WITH {S_PLAN} SELECT prompt_id, step_index, node_id FROM c WHERE node_type = 'Operation'")
def executable_filter(spark, d):
    c, nodes, _ = plan_tables(spark, d)
    return beam.executable(c, nodes).select("prompt_id", "step_index", "node_id")


@query(S_BEAM + ", top AS (SELECT prompt_id, n1, n2 FROM b2 WHERE k = 1) SELECT e.prompt_id, s AS source, t AS target, relation FROM e JOIN top ON e.prompt_id = top.prompt_id AND s = n1 AND t = n2 WHERE relation = 'OPERATION_PRECEDES'")
def execution_edges(spark, d):
    c, nodes, edges = plan_tables(spark, d)
    return beam.expand(beam.search(c, nodes, edges), nodes, edges)[1].select("prompt_id", "source", "target", "relation")


@query(
    f"""WITH {S_NODES},
steps2 AS (SELECT seq // 10 AS prompt_id, (seq % 10)::BIGINT AS step_index, name AS text, 'v' || seq AS node_id, round(abs(embedding[2]), 6) AS score, 1 AS rank FROM nodes),
dep AS (SELECT seq // 10 AS prompt_id, seq, name AS said FROM nodes),
b AS (SELECT prompt_id, dep.seq, node_id, 0.65 * score + 0.35 * {s_jaccard(s_tokens_builder('said'), s_tokens_builder('text'))} AS s, step_index FROM dep JOIN steps2 USING (prompt_id)),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY prompt_id, seq ORDER BY s DESC, step_index) = 1),
j AS (SELECT x.prompt_id, x.seq, x.node_id AS source, y.node_id AS target FROM k x JOIN k y ON y.prompt_id = x.prompt_id AND y.seq = x.seq + 1)
SELECT * FROM j WHERE source <> target"""
)
def dependency_resolve(spark, d):
    n = vector_nodes(spark, d).withColumn("prompt_id", F.floor(F.col("seq") / 10))
    steps = n.select("prompt_id", (F.col("seq") % 10).alias("step_index"), F.col("name").alias("text"))
    cands = n.select("prompt_id", (F.col("seq") % 10).alias("step_index"), F.lit(1).alias("rank"), F.col("id").alias("node_id"), F.round(F.abs(F.get("embedding", F.lit(1))), 6).alias("score"))
    after = n.select("prompt_id", (F.col("seq") - 1).alias("seq"), F.col("name").alias("after"))
    deps = n.select("prompt_id", "seq", F.col("name").alias("before")).join(after, ["prompt_id", "seq"])
    return candidates.resolve_dependencies(deps, steps, cands)


@query(
    """WITH n AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS wid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations),
e AS (SELECT a.conv_id, a.wid AS source, b.role AS relation, b.wid AS target, b.turn AS seq FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 3 AND length(a.text) < length(b.text)),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, source, relation ORDER BY seq DESC) = 1),
f AS (SELECT a.conv_id, a.wid AS source, 'success' AS relation, b.wid AS target FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.position = a.position + 1 WHERE a.conv_id NOT IN (SELECT conv_id FROM l)),
m AS (SELECT conv_id, source, relation, target FROM l UNION ALL SELECT * FROM f)
SELECT conv_id AS prompt_id, source, relation, target FROM m UNION ALL SELECT conv_id, wid, 'success', 'Done' FROM n WHERE wid NOT IN (SELECT source FROM m)"""
)
def workflow_connections(spark, d):
    c = table(spark, d, "conversations")
    node = F.concat_ws(":", "conv_id", "turn")
    n = c.select(F.col("conv_id").alias("prompt_id"), node.alias("node_id"), node.alias("wid"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("position"), "turn", "role", "text")
    a, b = n.alias("a"), n.alias("b")
    e = a.join(b, (F.col("a.prompt_id") == F.col("b.prompt_id")) & (F.col("b.turn") > F.col("a.turn")) & (F.col("b.turn") <= F.col("a.turn") + 3) & (F.length("a.text") < F.length("b.text")))
    e = e.select(F.col("a.prompt_id").alias("prompt_id"), F.col("a.node_id").alias("source"), F.col("b.node_id").alias("target"), F.col("b.role").alias("relation"), F.col("b.turn").alias("seq"))
    return workflow.connections(n.drop("text"), e)


@query("WITH e AS (SELECT conv_id, role AS name, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id AS prompt_id, string_agg(name, ',' ORDER BY t) AS inputs FROM e GROUP BY 1")
def workflow_inputs(spark, d):
    n = table(spark, d, "conversations").select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("position"), F.lit(True).alias("found"), F.array("role", "role").alias("inputs"))
    return workflow.inputs(n).select("prompt_id", F.array_join("inputs", ",").alias("inputs"))


@query(
    f"""WITH {S_FK}, a AS (SELECT source, target, relation, 'domain' AS origin FROM edges WHERE NOT starts_with(source, 'c')),
p AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'PROMPT_DEPENDENCY' AS relation, 'prompt' AS origin FROM customer)
SELECT source, target, relation, origin, {s_semantics(1)} AS edge_type, {s_semantics(2)}::DOUBLE AS weight FROM (SELECT * FROM a UNION ALL SELECT * FROM p)"""
)
def context_edges(spark, d):
    """Customers' links come as domain edges first and as dependencies later; the later ones stay."""
    e = fk_edges(spark, d).select(F.lit(0).alias("prompt_id"), "source", "target", "relation", F.xxhash64("source").alias("seq"))
    deps = e.where(F.col("source").startswith("c")).select("prompt_id", "source", "target", "seq")
    return context.context_edges(e, deps).select("source", "target", "relation", "origin", "edge_type", "weight")


@query(
    f"""WITH RECURSIVE {S_TRANS}, e AS (SELECT source, target, 1 + n % 7 AS w FROM tr WHERE source <> target),
p AS (SELECT source, target, w AS cost, 1 AS hops, [source, target] AS path FROM e UNION ALL SELECT p.source, e.target, cost + w, hops + 1, list_append(path, e.target) FROM p JOIN e ON p.target = e.source WHERE NOT list_contains(path, e.target)),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY cost, hops, path) = 1),
walk AS (SELECT DISTINCT user_id, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events),
w AS (SELECT user_id, path FROM walk JOIN b ON s = source AND t = target WHERE s <> t),
h AS (SELECT DISTINCT user_id, unnest(list_zip(path[1:-2], path[2:])) AS e FROM w)
SELECT user_id AS prompt_id, e[1] AS source, e[2] AS target FROM h"""
)
def match_paths(spark, d):
    """Each user is a prompt whose consecutive events are mapped onto best paths of the transition graph."""
    ev = table(spark, d, "events")
    m = ev.select(F.col("user_id").alias("prompt_id"), F.col("event_type").alias("id"), F.col("event_type").alias("node_id"), F.lit(1.0).alias("score"), F.col("event_type").alias("text")).distinct()
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = ev.select(F.col("user_id").alias("prompt_id"), F.col("event_type").alias("source"), nxt.alias("target")).where("target IS NOT NULL").distinct()
    return subgraph.match_paths(m, e, transition_edges(spark, d))["edges"]


@query(
    """WITH f AS (SELECT o_custkey AS ordinal, list(o_orderstatus ORDER BY o_orderkey) AS c FROM orders GROUP BY 1),
s AS (SELECT ordinal, list_filter(c, lambda x: x <> 'F') AS ok, list_filter(c, lambda x: x = 'F') AS bad FROM f)
SELECT ordinal, len(ok)::BIGINT AS supported, len(bad)::BIGINT AS unsupported, len(bad) > 0 AND len(ok) = 0 AS invalid FROM s"""
)
def action_validation(spark, d):
    item = F.struct(F.col("o_orderstatus").alias("domain_node_id"), F.col("o_orderstatus").alias("domain_node_name"), F.lit(1.0).alias("similarity"))
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ordinal")).agg(F.collect_list(item).alias("candidates")).withColumn("prompt_node_id", F.col("ordinal").cast("string"))
    nodes = table(spark, d, "orders").select(F.col("o_orderstatus").alias("id")).distinct().withColumn("executable", F.when(F.col("id") == "F", False))
    return subgraph.split_actions(a, nodes).select("ordinal", F.size("supported").cast("long").alias("supported"), F.size("unsupported").cast("long").alias("unsupported"), "invalid")


@query()
def context_candidates(spark, d):
    """Direct and neighbourhood candidates of the stated steps, with edges between successive vectors."""
    nodes = vector_nodes(spark, d)
    steps = vector_steps(spark, d).select(F.col("step_id").alias("prompt_id"), F.lit(0).alias("step_index"), "text", F.lit(True).alias("explicit"), "query")
    e = nodes.select("seq", F.col("id").alias("source"), F.explode(F.array(F.lit(1), F.lit(7))).alias("k")).select((2 * F.col("seq") + (F.col("k") > 1).cast("int")).alias("seq"), "source", F.concat(F.lit("v"), F.col("seq") + F.col("k")).alias("target"), F.when(F.col("k") == 1, "OPERATION_PRECEDES").otherwise("ENTITY_OWNS").alias("relation"))
    none = spark.createDataFrame([], "prompt_id long, seq int, before string, after string")
    out = context.build(steps, none, nodes, e)["candidates"]
    return out.select("prompt_id", F.col("rank").cast("long").alias("rank"), "node_id", "source", r9("score").alias("score"), r9("relation_score").alias("relation_score"))


@query()
def workflow_documents(spark, d):
    """User turns as prompts through the whole pipeline, parts as operations and functions."""
    from .pipeline import Pipeline
    from .providers import HashEmbedding

    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq"))
    nodes = p.select("seq", F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.lit("Operation").alias("node_type"), F.lit("").alias("description"), F.expr(X.EMPTY).alias("aliases"), F.array(F.lit("Operation")).alias("types"), F.lit(None).cast("array<double>").alias("embedding"))
    order = p.select("seq", "p_name", F.split("p_name", " ").alias("w"))
    e = order.alias("a").join(order.alias("b"), (F.get(F.col("a.w"), F.lit(1)) == F.get(F.col("b.w"), F.lit(1))) & (F.col("a.p_name") < F.col("b.p_name"))).select(F.col("a.seq").alias("seq"), F.col("a.p_name").alias("source"), F.col("b.p_name").alias("target"), F.lit("OPERATION_INCLUDES").alias("relation"))
    functions = p.select("seq", F.col("p_name").alias("name"), F.lit("").alias("description"), F.array(F.lit("item")).alias("inputs"), F.array(F.lit("done")).alias("outputs"))
    prompts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("prompt_id"), F.concat(F.lit("red bolt then small gear of "), "s_name").alias("text"))
    out = Pipeline(nodes, e, functions, HashEmbedding()).run(prompts)
    return out.select("prompt_id", "Name", F.size("Nodes").alias("n_nodes"), F.to_json("Nodes").alias("nodes"), F.to_json("Connections").alias("connections"))


from . import more_queries  # noqa: E402, F401  (adds its queries to QUERIES and SQL)
