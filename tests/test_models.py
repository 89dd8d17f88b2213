import json

import pytest
from pyspark.sql import functions as F

from weftline.plans import cli, training
from weftline.plans.models import ModelEmbedding, ModelTagger, RelationExtractor, embedding_of, read_text
from weftline.plans.config import Config
from weftline.plans.pipeline import Pipeline
from weftline.plans.providers import HashEmbedding
from weftline.plans.shell import converse
from weftline.sources import documents as D
from weftline.sources import graph as G
from weftline.sources import report, schemas, shapes, sinks
from weftline.sources.client import GraphClient, TableGraph


class Token:
    def __init__(self, i, text, pos):
        self.i, self.text, self.pos_, self.lemma_ = i, text, pos, text.lower()
        self.head, self.subtree, self.ancestors = self, [], []


class Span(list):
    @property
    def text(self):
        return " ".join(t.text for t in self)


class Doc(list):
    """A stand-in parser's document: word classes from a list, chunks of single nouns, `before x` and `after x` hang under x's verb."""

    def __init__(self, text):
        verbs, nouns = {"check", "notify", "approve"}, {"transfer", "funds", "teacher", "balance"}
        words = text.split()
        pos = lambda i, w: "VERB" if w in verbs or (w == "transfer" and i and words[i - 1] == "Please") else "NOUN" if w.lower() in nouns else "X"
        super().__init__(Token(i, w, pos(i, w)) for i, w in enumerate(words))
        for t in self:
            if t.text in ("before", "after"):
                t.head = next((u for u in self[t.i + 1 :] if u.pos_ == "VERB"), t)
                t.head.subtree = [t.head]
                t.ancestors = [t.head, *[u for u in self[: t.i] if u.pos_ == "VERB"]]
                t.ancestors = t.ancestors[1:]
        self.sents = [Span(self)] if self else []

    @property
    def noun_chunks(self):
        for t in self:
            if t.pos_ == "NOUN":
                chunk = Span([t])
                chunk.root = t
                yield chunk


def test_reading_a_parse():
    got = read_text(Doc, "transfer funds after that teacher")
    assert [a[1] for a in got["actions"]] == ["transfer", "teacher"] and got["actions"][0][2] == 0
    assert got["relations"] == [("transfer", "teacher", "sequence")]
    got = read_text(Doc, "check balance before notify teacher")
    assert got["relations"] == [("check", "notify", "before"), ("check", "notify", "sequence")]
    assert read_text(Doc, "check balance after notify teacher")["relations"][0] == ("notify", "check", "before")
    assert [e[0] for e in got["entities"]] == ["balance", "teacher"]
    assert read_text(Doc, "funds check")["actions"] == [("check", "check", 1)]
    assert read_text(Doc, None) == {"actions": [], "entities": [], "relations": []}


def test_models_run_where_the_rows_are(spark):
    def load_encoder():
        return lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    df = spark.createDataFrame([("ab",), ("",), (None,)], "text string")
    assert [r.v for r in df.select(ModelEmbedding(load_encoder).encode(F.col("text")).alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0]]
    assert isinstance(embedding_of("hash-16"), HashEmbedding) and isinstance(embedding_of("all-MiniLM-L6-v2"), ModelEmbedding)

    def load_generator():
        return lambda text: f"<s><triplet> {text} <subj> b <obj> likes</s>"

    p = spark.createDataFrame([(1, "a"), (2, "  "), (3, None)], "prompt_id int, text string")
    assert [tuple(r) for r in RelationExtractor(load_generator).extract(p).collect()] == [(1, 0, "a", "likes", "b")]
    assert RelationExtractor(None).extract(p).count() == 0


def test_tagger_over_a_parser(spark):
    def load():
        class T:
            def __init__(self, i, text):
                self.i, self.text, self.lemma_, self.pos_ = i, text, text, "VERB" if text == "go" else "NOUN"

        class D(list):
            sents, noun_chunks = (), ()

        return lambda text: D(T(i, w) for i, w in enumerate(text.split()))

    p = spark.createDataFrame([(1, "go home go"), (2, None)], "prompt_id int, text string")
    actions, entities, relations = ModelTagger(load).analyse(p)
    assert [tuple(r) for r in actions.orderBy("ordinal").collect()] == [(1, 0, "go", "go", 0), (1, 1, "go", "go", 2)]
    assert [tuple(r) for r in relations.collect()] == [(1, 0, "go", "go", "sequence")] and entities.isEmpty()


def small_graph(spark):
    node = lambda i, t="Operation": (i.replace(" ", "_"), i, t, "", [], [t], [1.0, 0.0])
    return G.memory_graph(spark, [node("transfer funds"), node("check balance"), node("account", "DomainEntity")], [("transfer_funds", "account", "OPERATION_MODIFIES")])


def test_graph_client(spark):
    client = TableGraph(*small_graph(spark))
    assert isinstance(client, GraphClient) and client.all_nodes().count() == 3
    steps = spark.createDataFrame([(1, "transfer funds", [1.0, 0.0])], "step_id int, text string, query array<double>")
    assert [r.id for r in client.candidate_nodes(steps, ["Operation"], 1).collect()] == ["transfer_funds"]
    near = client.neighbourhood(spark.createDataFrame([("account",)], "id string"))
    assert [tuple(r) for r in near.collect()] == [("account", "transfer_funds", "OPERATION_MODIFIES", "account")]
    assert client.get_node("account").first().name == "account" and client.get_node("gone").isEmpty()


def test_shapes(spark):
    class Held:
        class nodes:  # noqa: N801
            def __new__(cls, data):
                return [("a", {"name": "A"})]

        class edges:  # noqa: N801
            def __new__(cls, data):
                return [("a", "a", {"weight": 3})]

    assert shapes.node_items(Held()) == [("a", {"name": "A"})] and shapes.edge_items(Held()) == [("a", "a", {"weight": 3})]
    assert shapes.node_items({"nodes": [{"id": "x"}, {"name": "y"}]}) == [("x", {"id": "x"}), (1, {"name": "y"})]
    assert shapes.edge_items(None) == [] and shapes.edge_items({"adjacency": {"a": [{"target": "b"}]}}) == [("a", "b", {"target": "b"})]
    with pytest.raises(TypeError):
        shapes.node_items([1])
    nodes, edges = shapes.tables_of(spark, {"nodes": {"a": {"types": "T"}, "b": {}}, "edges": [("a", "b", {"transition": "optional"}), {"source": "b", "target": "a"}, ("a",)]})
    assert [(r.id, r.name, r.types) for r in nodes.orderBy("seq").collect()] == [("a", "a", ["T"]), ("b", "b", None)]
    assert [(r.source, r.relation, r.confidence) for r in edges.orderBy("seq").collect()] == [("a", "optional", 1.0), ("b", "success", 1.0)]
    more = shapes.add_nodes(nodes, [{"id": "b", "name": "new"}, {"id": "c"}])
    assert sorted((r.id, r.name) for r in more.collect()) == [("a", "a"), ("b", "new"), ("c", None)]
    assert shapes.add_edges(edges, [{"source": "b", "target": "a", "relation": "success", "weight": 9.0}]).where("weight = 9").count() == 1


def test_training(spark, tmp_path):
    cell = {"Name": "w", "StartNodeId": "1", "Nodes": [{"Id": "1", "Name": "A", "Type": "t"}, {"Id": "2", "Name": "B"}], "Connections": {"1": {"optional": "2"}, "2": {"success": "Done"}}}
    quoted = json.dumps(cell).replace('"', '""')
    (tmp_path / "w.csv").write_text(f'workflow_id,WorkflowJson\n1,"{quoted}"\n2,"{quoted}"\n')
    counts = training.run(spark, str(tmp_path / "w.csv"), str(tmp_path / "out"), HashEmbedding(8))
    assert counts == {"nodes": 2, "edges": 2, "adjacency": 1, "reverse_adjacency": 1, "paths": 1, "workflows": 1}
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    assert sorted((r.name, r.type, r["count"]) for r in read("nodes").collect()) == [("A", "t", 2), ("B", "Custom", 2)]
    assert [(r.path, r.frequency, len(r.embedding)) for r in read("paths").collect()] == [(["A", "B"], 2, 8)]
    assert {r.edge_type for r in read("edges").collect()} == {"optional"} and len(read("adjacency").first().neighbours) == 2
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in D.read_json(spark, str(tmp_path / "j.json"), "a int").collect()) == [1, 2]


def test_store(spark, tmp_path):
    uri = f"jdbc:derby:{tmp_path}/db;create=true"
    nodes = spark.createDataFrame([("a", "A", ["T"]), ("b", "B", None)], "id string, name string, types array<string>")
    edges = spark.createDataFrame([("e", "a", "b", "R"), ("f", "a", "gone", "R")], "id string, source string, target string, type string")
    sinks.store_graph(nodes, edges, uri, batch_size=1)
    sinks.store_graph(spark.createDataFrame([("b", "B2", ["U"]), ("c", "C", None)], nodes.schema), edges, uri)
    back = lambda t: spark.read.format("jdbc").options(url=uri, dbtable=t).load()
    assert sorted((r.id, r.name, r.types) for r in back("nodes").collect()) == [("a", "A", '["T"]'), ("b", "B2", '["U"]'), ("c", "C", None)]
    assert [(r.source, r.target, r.type) for r in back("edges").collect()] == [("a", "b", "R")]
    with pytest.raises(ValueError):
        sinks.store_graph(nodes, edges, uri, batch_size=0)
    with pytest.raises(SystemExit):
        cli.main(["store", "g", "--uri", "x", "--batch-size", "0"])


def test_conversation(spark):
    nodes, edges = small_graph(spark)
    functions = spark.createDataFrame([(0, "transfer funds", "", ["amount"], ["receipt"])], "seq int, " + schemas.FUNCTION)
    plans = Pipeline(nodes.withColumn("embedding", F.lit(None).cast("array<double>")), edges, functions, HashEmbedding(), config=Config(match_threshold=0.5))
    lines, typed = [], iter(["", "debug", "transfer funds", "debug", "transfer funds", "fail", "Q"])

    def plan(prompts):
        if prompts.first().text == "fail":
            raise RuntimeError("no such thing")
        return plans.run(prompts)

    assert converse(plan, spark, lambda _: next(typed), lines.append) == 2
    assert lines[:2] == ["type a prompt, or exit", "debug on"] and json.loads(lines[2])["Name"] and lines[3] == "debug off"
    assert "transfer funds = transfer funds" in lines[4:] and lines[-1] == "failed: no such thing"


def test_lines(spark):
    beams = spark.createDataFrame([(1, 1, [(0, "a", "A")])], "prompt_id int, beam_rank int, selection array<struct<step_index:int,node_id:string,name:string>>")
    cands = spark.createDataFrame([(1, 0, "a", "do a", "direct")], "prompt_id int, step_index int, node_id string, prompt_text string, source string")
    assert report.selection_lines(beams, cands).first().line == "do a -> A (source direct)"
    edge = spark.createDataFrame([(1, "a", "b", "r", "x", 2.0, "REQUIRED")], "prompt_id int, source string, target string, relation string, edge_type string, weight double, classification string")
    assert report.weighted_edge_lines(edge).first().line == "a -r-> b (x, weight 2.0, REQUIRED)"
    order = spark.createDataFrame([(1, "a", 1), (1, "z", 2)], "prompt_id int, node_id string, position int")
    named = spark.createDataFrame([(1, "a", "A")], "prompt_id int, node_id string, name string")
    assert [r.line for r in report.order_lines(order, named).orderBy("at").collect()] == ["A", "z"]
