import pytest
from pyspark.sql import functions as F

from weftline.operators import beam, mining, ontology, prompt_graph, subgraph, traverse, workflow
from weftline.sources import documents as D
from weftline.sources import graph as G
from weftline.sources import schemas, sinks

EDGE = "source string, target string, relation string, edge_type string, weight int"


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_neighbourhood_and_induced(spark):
    e = spark.createDataFrame([("a", "b", "r", "mandatory", 1), ("b", "c", "r", "mandatory", 1), ("c", "d", "r", "mandatory", 1), ("b", "d", "r", "Deprecated", 1)], EDGE)
    assert rows(traverse.neighbourhood(e, ids(spark, "a"), 0), "source", "target") == {("a", "b")}
    assert rows(traverse.neighbourhood(e, ids(spark, "a"), 2), "source", "target") == {("a", "b"), ("b", "c"), ("b", "d")}
    nodes, kept = traverse.induced(e, ids(spark, "a"), 2)
    assert rows(nodes, "id") == {("a",), ("b",), ("c",), ("d",)} and rows(kept, "source", "target") == {("a", "b"), ("b", "c"), ("c", "d")}
    assert rows(traverse.induced(e, ids(spark, "a"), 0)[0], "id") == {("a",)}


def test_shortest_paths(spark):
    e = spark.createDataFrame([("create", "assign", "r", "deprecated", 100), ("create", "validate", "r", "mandatory", 1), ("validate", "assign", "r", "mandatory", 1)], EDGE)
    assert traverse.strategy(e) == "dijkstra" and traverse.strategy(e.withColumn("weight", F.lit(3))) == "bfs"
    best = {(r.source, r.target): (r.cost, r.path) for r in traverse.shortest_paths(e, ids(spark, "create")).collect()}
    assert best[("create", "assign")] == (2.0, ["create", "validate", "assign"])
    assert rows(traverse.shortest_paths(e, ids(spark, "create"), "bfs", ids(spark, "assign")), "target", "hops") == {("assign", 1)}


def test_topological_order_and_cycles(spark):
    n = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcd")], "plan_id int, id string, seq int")
    e = spark.createDataFrame([(1, "a", "d", 0), (1, "a", "c", 1), (1, "b", "c", 2)], "plan_id int, source string, target string, seq int")
    got = traverse.plan_order(n, e).orderBy("position").collect()
    assert [(r.id, r.level) for r in got] == [("a", 0), ("b", 0), ("d", 1), ("c", 1)]
    loop = e.union(spark.createDataFrame([(1, "c", "b", 3)], e.schema))
    with pytest.raises(traverse.PlanningError, match="c -> b"):
        traverse.plan_order(n, loop)


ONTOLOGY = """{"version": "1", "node_types": {"actors": "Actor", "operations": "Operation", "entities": "DomainEntity", "events": "Event"}, "relationships": [
{"type": "ACTOR_PERFORMS", "raw_terms": ["performs"], "source_types": ["Actor"], "target_types": ["Operation"]},
{"type": "OPERATION_PRODUCES_EVENT", "raw_terms": ["produces"], "source_types": ["Operation"], "target_types": ["Event"]},
{"type": "OPERATION_PRODUCES", "raw_terms": ["produces"], "source_types": ["Operation"], "target_types": ["DomainEntity"]},
{"type": "OPERATION_REQUIRES", "raw_terms": ["depends on"], "source_types": ["Operation"], "target_types": ["Operation"]}]}
trailing prose"""
RAW = """{"actors": [{"id": "clerk", "name": "Clerk"}, {"id": "both", "name": "First"}], "operations": [{"id": "pay", "name": "Pay"}, {"id": "log"}], "entities": [{"id": "bill", "name": "Bill"}, {"id": "both", "name": "Second"}],
"events": [{"id": "paid", "name": "Paid"}], "misc": [{"id": "zzz"}, {"name": "no id"}], "relationships": [
{"source": "clerk", "target": "pay", "type": "performs"}, {"source": "pay", "target": "bill", "raw_type": "produces"}, {"source": "pay", "target": "paid", "raw_type": "produces", "condition": "ok"},
{"source": "ghost", "target": "pay", "raw_type": "performs"}, {"source": "pay", "target": "log", "raw_type": "Depends-On"}, {"source": "pay", "target": "log", "raw_type": "sings"}, {"source": "pay", "target": "clerk", "raw_type": "performs"}]}"""


def test_mapping_job(spark, tmp_path):
    from weftline.plans import mapping

    (tmp_path / "raw.json").write_text(RAW)
    (tmp_path / "ontology.json").write_text(ONTOLOGY)
    kinds = ["actors", "operations", "entities", "events", "misc"]
    out = mapping.run(spark, str(tmp_path / "raw.json"), str(tmp_path / "ontology.json"), str(tmp_path / "out"), kinds)
    assert rows(out["edges"], "id", "type", "condition") == {("edge:0", "ACTOR_PERFORMS", None), ("edge:1", "OPERATION_PRODUCES", None), ("edge:2", "OPERATION_PRODUCES_EVENT", "ok"), ("edge:4", "OPERATION_REQUIRES", None)}
    assert [r.missing_node_ids for r in out["unresolved"].collect()] == [["ghost"]]
    assert [r.relationship_index for r in out["unmapped"].collect()] == [5]
    assert [(r.relationship_index, r.candidate_types) for r in out["invalid"].collect()] == [(6, ["ACTOR_PERFORMS"])]
    assert [(r.id, r.types) for r in out["duplicates"].collect()] == [("both", ["Actor", "DomainEntity"])]
    assert tuple(out["summary"].select("raw_node_count", "mapped_node_count", "raw_relationship_count", "mapped_relationship_count").first()) == (9, 6, 7, 4)
    names = {r.id: r.name for r in out["nodes"].collect()}
    assert names["both"] == "First" and names["log"] == "log"
    nodes, edges = sinks.read_graph(spark, str(tmp_path / "out/graph"))
    assert nodes.count() == 6 and rows(edges.where("type = 'ACTOR_PERFORMS'"), "source", "relationship_index") == {("clerk", 0)}
    sinks.migrate(spark, str(tmp_path / "out/graph"), str(tmp_path / "moved"))
    assert sinks.read_graph(spark, str(tmp_path / "moved"))[1].count() == 4


def test_first_json_must_be_an_object(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1]")
    with pytest.raises(Exception, match="must begin with a JSON object"):
        D.read_first_json(spark, str(tmp_path / "a.json"), "actors array<struct<id:string>>").collect()


def test_planner_graph(spark):
    n = spark.createDataFrame([("register_user", "Register User", ["Operation"], None), ("customer", "Customer", ["DomainEntity"], None), ("BR-001", "Age", ["Rule"], '[{"statement": "adults"}]'), (None, "x", ["Rule"], None)], "id string, name string, types array<string>, raw_records_json string")
    e = spark.createDataFrame([("edge:0", "register_user", "BR-001", "OPERATION_INCLUDES", None, None), ("edge:1", "customer", "register_user", "ACTOR_PERFORMS", "customer exists", None), ("edge:2", "customer", "nobody", "X", None, None)], "id string, source string, target string, type string, condition string, raw_type string")
    nodes, edges = G.planner_graph(n, e)
    assert rows(nodes, "id", "executable", "constraint") == {("register_user", True, False), ("customer", False, False), ("BR-001", False, True)}
    assert rows(edges, "id", "edge_type", "weight", "context", "condition") == {("edge:0", "mandatory", 2, False, None), ("edge:1", "alternative", 4, True, "customer exists")}


def test_decode_nodes(spark):
    r = spark.createDataFrame([("a", None, ["X", "X"], ["GraphNode", "Y"]), ("b", "B", None, None), (None, "c", None, None)], "id string, name string, types array<string>, labels array<string>")
    assert {x.id: (x.name, x.node_type, x.types) for x in G.decode_nodes(r).collect()} == {"a": ("a", "X", ["X", "Y"]), "b": ("B", "DomainEntity", [])}


def test_sinks(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("b", None, 3), ("c", "z", 4)], "id string, name string, n int")
    assert rows(sinks.upsert(old, new, ["id"]), "id", "name", "n") == {("a", "x", 1), ("b", "y", 3), ("c", "z", 4)}
    with pytest.raises(ValueError, match="not unique"):
        sinks.check_unique(old.union(old))
    with pytest.raises(Exception, match="not an identifier"):
        spark.createDataFrame([("a-b",)], "t string").select(sinks.identifier(F.col("t"))).collect()
    with pytest.raises(ValueError, match="batch_size"):
        sinks.write_graph(old, old, "/nowhere", 0)


def plan(spark, relation=None, rule=None, source="direct", types=("Operation", "Operation"), text="do b"):
    c = spark.createDataFrame(
        [(1, 0, 1, "a", "A", types[0], 0.677, True, "direct", "do a"), (1, 1, 1, "b", "B", types[1], 0.60, False, source, text)],
        "prompt_id int, step_index int, rank int, node_id string, name string, node_type string, score double, explicit boolean, source string, prompt_text string",
    )
    nodes = [(1, "a", "A", types[0], "", []), (1, "b", "B", types[1], "", []), (1, "r", rule or "", "Rule", "", [])]
    n = spark.createDataFrame(nodes, "prompt_id int, node_id string, name string, node_type string, description string, aliases array<string>")
    e = ([(1, "a", "b", relation)] if relation else []) + ([(1, "r", "b", "RULE_CONSTRAINS")] if rule else [])
    from weftline.functions.relations import annotate

    return c, n, annotate(spark.createDataFrame(e, "prompt_id int, source string, target string, relation string"))


@pytest.mark.parametrize(
    "gain,kw",
    [
        (1.05, {"relation": "PROMPT_DEPENDENCY"}), (1.05, {"relation": "OPERATION_PRECEDES"}), (0.84, {"relation": "OPERATION_INCLUDES"}), (0.95, {"relation": "OPERATION_REQUIRES"}),
        (0.45, {}), (0.42, {"source": "neighborhood"}), (-0.30, {"rule": "b must be active", "text": "do b inactive"}), (-0.30, {"rule": "check b", "text": "skip b"}),
    ],
)
def test_beam_worked_values(spark, gain, kw):
    top = beam.search(*plan(spark, **kw)).where("beam_rank = 1").first()
    assert top.selected_ids == ["a", "b"] and top.score == pytest.approx(0.827 + gain)
    assert len(top.violations) == (1 if "rule" in kw else 0)


def test_beam_skips_and_survives(spark):
    top = beam.search(*plan(spark, types=("Operation", "Actor"))).collect()
    assert [r.selected_ids for r in top] == [["a"]]
    c, n, e = plan(spark, relation="OPERATION_PRECEDES")
    again = c.withColumn("node_id", F.lit("a"))
    assert [r.selected_ids for r in beam.search(again, n, e).collect()] == [["a"]]
    ops, order = beam.expand(beam.search(c, n, e), n, e)
    assert rows(ops, "node_id") == {("a",), ("b",)} and rows(order, "source", "target") == {("a", "b")}
    assert beam.expand(beam.search(*plan(spark, relation="OPERATION_INCLUDES")), n, plan(spark, relation="OPERATION_INCLUDES")[2])[1].isEmpty()


CTX_EDGES = [("register", "validate", "OPERATION_INCLUDES", "mandatory", 2), ("validate", "notify", "OPERATION_PRECEDES", "mandatory", 1), ("customer", "register", "ACTOR_PERFORMS", "alternative", 4)]


def actions(spark, *names):
    item = "struct<domain_node_id:string,domain_node_name:string,similarity:double>"
    return spark.createDataFrame([(i, f"p{i}", n, [(n, n, 1.0)]) for i, n in enumerate(names)], f"ordinal int, prompt_node_id string, prompt_text string, candidates array<{item}>")


def ctx_nodes(spark, *more):
    return spark.createDataFrame([(n, n != "customer") for n in ("register", "validate", "notify", "customer", *more)], "id string, executable boolean")


def test_context_subgraph(spark):
    e = spark.createDataFrame(CTX_EDGES, EDGE)
    out = subgraph.build(actions(spark, "register", "notify"), ctx_nodes(spark), e)
    assert rows(out["nodes"], "id") == {("register",), ("validate",), ("notify",), ("customer",)} and ("customer", "register") in rows(out["edges"], "source", "target")
    assert out["strategy"] == "dijkstra"
    bad = subgraph.build(actions(spark, "customer", "notify"), ctx_nodes(spark), e)["invalid"].collect()
    assert len(bad) == 1 and bad[0].supported == []


def test_reconnection(spark):
    far = spark.createDataFrame([*CTX_EDGES, ("notify", "archive", "r", "mandatory", 1), ("archive", "report", "r", "mandatory", 1)], EDGE)
    acts, nodes = actions(spark, "register", "report"), ctx_nodes(spark, "archive", "report")
    got = subgraph.build(acts, nodes, far)["connections"]
    assert got[0]["path"] == ["register", "validate", "notify", "archive", "report"] and got[0]["reason"] is None
    assert "too long" in subgraph.build(acts, nodes, far, max_path=2)["connections"][0]["reason"]
    gone = spark.createDataFrame([("register", "notify", "r", "deprecated", 100)], EDGE)
    assert "deprecated" in subgraph.build(actions(spark, "register", "notify"), ctx_nodes(spark), gone, radius=0)["connections"][0]["reason"]


def test_paths_of_pairs(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "d", 0.0), ("a", "d", 2.0), ("d", "e", 9.0)], "source string, target string, weight double")
    every = {(r.source, r.target): (r.cost, r.path) for r in traverse.shortest_paths(e, e.select(F.col("source").alias("id"))).collect()}
    asked = spark.createDataFrame([("a", "c"), ("a", "d"), ("b", "d"), ("e", "a")], "source string, target string")
    got = {(r.source, r.target): (r.cost, r.path) for r in traverse.shortest_paths(e, None, pairs=asked).collect()}
    assert got == {p: every[p] for p in [("a", "c"), ("a", "d"), ("b", "d")]} and got["a", "d"] == (2.0, ["a", "d"])
    assert rows(traverse.reachable(e, spark.createDataFrame([("b",), ("e",)], "id string")), "source", "target") == {("b", "b"), ("b", "c"), ("b", "d"), ("b", "e"), ("e", "e")}


def test_merged_paths_connect_later_pairs(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "r", "mandatory", 1) for i in range(6)], EDGE)
    nodes = ctx_nodes(spark, *[f"n{i}" for i in range(7)])
    acts = actions(spark, "n0", "n3", "n0", "n2")
    got = subgraph.build(acts, nodes, chain, radius=0)["connections"]
    assert [(c["source"], c["target"], c["reason"]) for c in got] == [("n0", "n3", None), ("n3", "n0", "no path")]


def test_path_matching(spark):
    m = spark.createDataFrame([(1, "p0", "create", 1.0, "x"), (1, "p1", "assign", 1.0, "y")], "prompt_id int, id string, node_id string, score double, text string")
    want = spark.createDataFrame([(1, "p0", "p1")], "prompt_id int, source string, target string")
    e = spark.createDataFrame([("create", "validate", "r", "mandatory", 1), ("validate", "assign", "r", "mandatory", 1)], EDGE)
    out = subgraph.match_paths(m, want, e)
    assert rows(out["nodes"], "node_id", "inferred") == {("create", False), ("assign", False), ("validate", True)}
    assert rows(out["edges"], "source", "target") == {("create", "validate"), ("validate", "assign")} and out["unreachable"].isEmpty()
    assert subgraph.match_paths(m, want, e.where("false"))["unreachable"].count() == 1
    both = m.withColumn("node_id", F.lit("assign"))
    assert [r.texts for r in subgraph.match_paths(both, want, e)["duplicates"].collect()] == [["x", "y"]]


def test_workflow_walks(spark):
    cell = '{"Name": "w", "StartNodeId": "1", "Nodes": [{"Id": "1", "Name": "A", "Type": "t"}, {"Id": "2", "Name": "B", "Type": "t"}], "Connections": {"1": {"success": "2", "fail": "Done"}, "2": {"success": "%s"}}}'
    df = spark.createDataFrame([(1, cell % "1"), (2, cell % "Done"), (3, cell % "99"), (4, "oops")], "workflow_id int, WorkflowJson string")
    p = mining.parse_workflows(df)
    assert rows(mining.follow(p).select("workflow_id", F.array_join("path", ">").alias("p")), "workflow_id", "p") == {(1, "A>B"), (2, "A>B"), (3, "A>B")}
    assert rows(mining.path_frequency(mining.follow(p)), "frequency") == {(3,)}
    assert rows(mining.workflow_edges(p), "workflow_id", "source", "target") == {(1, "A", "B"), (2, "A", "B"), (3, "A", "B"), (1, "B", "A")}


def test_prompt_graph(spark):
    a = spark.createDataFrame([(1, 0, "open", "open", 0), (1, 1, "close", "close", 4)], "prompt_id int, ordinal long, text string, lemma string, token_index long")
    e = spark.createDataFrame([(1, 0, "door", "door", 2), (1, 1, "gate", "gate", 5)], "prompt_id int, ordinal long, text string, root string, token_index long")
    r = spark.createDataFrame([(1, 0, "open", "close", "sequence"), (1, 1, "open", "close", "before")], "prompt_id int, seq int, source string, target string, relation string")
    nodes, edges = prompt_graph.build(a, e, r)
    assert rows(edges, "source", "target", "relation") == {("action:0", "entity:0", "acts_on"), ("action:1", "entity:1", "acts_on"), ("action:0", "action:1", "before")}
    assert rows(prompt_graph.concepts(nodes, edges), "id", "text") == {("action:0", "open door"), ("action:1", "close gate")}


def test_group_nodes_keeps_order(spark):
    r = spark.createDataFrame([(2, "x", "second", None, "actors", "Actor"), (1, "x", None, "s", "rules", "Rule")], "seq long, id string, name string, statement string, category string, type string")
    n = ontology.group_nodes(r).first()
    assert (n.name, n.types, [x.statement for x in n.raw_records]) == ("x", ["Actor", "Rule"], ["s", None])


def test_schemas_parse(spark):
    for s in (schemas.NODE, schemas.EDGE, schemas.STEP, schemas.CANDIDATE, schemas.CONTEXT_EDGE, schemas.FUNCTION, schemas.ONTOLOGY, schemas.INTERPRETATION):
        assert spark.createDataFrame([], s).columns


def test_connections_fall_back_to_order(spark):
    n = spark.createDataFrame([(1, "a", "A", 1), (1, "b", "B", 2)], "prompt_id int, node_id string, wid string, position int")
    e = spark.createDataFrame([], "prompt_id int, source string, target string, relation string, seq int")
    assert rows(workflow.connections(n, e), "source", "relation", "target") == {("A", "success", "B"), ("B", "success", "Done")}
