import pytest
from pyspark.sql import functions as F

from weftline.plans.config import Config
from weftline.plans.pipeline import Pipeline, interpret
from weftline.plans.providers import CannedModel, HashEmbedding, HostedModel
from weftline.sources import graph as G
from weftline.sources import schemas
from weftline.streaming import prompts as stream

REPLY = 'Here: ```json {"intent": "move money", "explicit_steps": [], "inferred_steps": [{"text": "check balance", "reason": "r"}], "dependencies": [{"before": "check balance", "after": "transfer funds"}]} ```'


@pytest.fixture(scope="module")
def parts(spark):
    node = lambda i, t="Operation": (i.replace(" ", "_"), i, t, "", [], [t], None)
    nodes, edges = G.memory_graph(spark, [node("transfer funds"), node("check balance"), node("account", "DomainEntity")], [("transfer_funds", "account", "OPERATION_MODIFIES")])
    f = spark.createDataFrame([(0, "transfer funds", "", ["amount"], ["receipt"])], "seq int, " + schemas.FUNCTION)
    return nodes, edges, f


def test_interpretation(spark, parts):
    p = spark.createDataFrame([(1, "transfer funds")], "prompt_id int, text string")
    model = CannedModel(spark.createDataFrame([("transfer funds", REPLY)], "text string, reply string"))
    intents, steps, deps = interpret(p, model)
    assert intents.first()["intent"] == "move money"
    assert [(r.step_index, r.text, r.explicit) for r in steps.orderBy("step_index").collect()] == [(0, "transfer funds", True), (1, "check balance", False)]
    assert [(r.before, r.after) for r in deps.collect()] == [("check balance", "transfer funds")]


def test_prompt_to_workflow(spark, parts):
    p = spark.createDataFrame([(1, "transfer funds")], "prompt_id int, text string")
    model = CannedModel(spark.createDataFrame([("transfer funds", REPLY)], "text string, reply string"))
    w = Pipeline(*parts, HashEmbedding(), model, Config(match_threshold=0.5)).run(p).first()
    assert [n.Name for n in w.Nodes] == ["check balance", "transfer funds"]
    first, second = (n.Id for n in w.Nodes)
    assert w.StartNodeId == first and w.Connections == {first: {"PROMPT_DEPENDENCY": second}, second: {"success": "Done"}}
    assert w.Inputs == ["amount"] and [n.FunctionDetails.Found for n in w.Nodes] == [False, True]


def test_nothing_selected_is_an_error(spark, parts):
    nodes, edges, f = parts
    p = spark.createDataFrame([(1, "transfer funds")], "prompt_id int, text string")
    with pytest.raises(RuntimeError, match="no operation"):
        Pipeline(nodes.where("node_type <> 'Operation'"), edges, f, HashEmbedding()).run(p)


def test_stream_of_prompts(spark, parts, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("transfer funds, then check balance\n\n")
    q = stream.plan(stream.read(spark, str(tmp_path / "in")), Pipeline(*parts, HashEmbedding()), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select(F.size("Nodes").alias("n")).collect()
    assert [r.n for r in got] == [2]


def test_config():
    c = Config.from_env({"WEFTLINE_BEAM": "5", "WEFTLINE_GRAPH": "g"})
    assert (c.beam_width, c.graph_path, c.top_k) == (5, "g", 5)


def test_hosted_model(spark):
    with pytest.raises(RuntimeError, match="token"):
        HostedModel(lambda *a: "", None)
    p = spark.createDataFrame([(1, "transfer funds")], "prompt_id int, text string")
    intents, steps, _ = interpret(p, HostedModel(lambda system, user, n, t: '{"intent": "%s", "inferred_steps": [{"text": "check"}]}' % user, "t"))
    assert intents.first()["intent"] == "transfer funds" and [r.text for r in steps.orderBy("step_index").collect()] == ["transfer funds", "check"]
