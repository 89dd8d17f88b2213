from pyspark.sql import functions as F

from weftline.functions.triplets import triplets
from weftline.operators import prompt_graph
from weftline.plans.tagger import LexiconTagger
from weftline.sources import documents as D
from weftline.sources import report


def test_triplets(spark):
    said = "<s> noise <triplet> Paris <subj> France <obj> capital of <triplet> broken <subj> x <triplet> A b <subj> C <obj> d e </s><pad>"
    got = spark.range(1).select(triplets(F.lit(said)).alias("t")).first()["t"]
    assert [tuple(x) for x in got] == [("Paris", "capital of", "France"), ("A b", "d e", "C")]
    assert spark.range(1).select(triplets(F.lit(None).cast("string")).alias("t")).first()["t"] == []


def test_tagger(spark):
    p = spark.createDataFrame([(1, "Transfer funds. Verify the account after that notify teacher"), (2, "check balance before pay bill")], "prompt_id int, text string")
    a, e, r = LexiconTagger(["verify", "check", "pay"], ["transfer", "notify"]).analyse(p)
    acts = {(x.prompt_id, x.ordinal, x.lemma) for x in a.collect()}
    assert acts == {(1, 0, "transfer"), (1, 1, "verify"), (1, 2, "notify"), (2, 0, "check"), (2, 1, "pay")}
    assert {(x.prompt_id, x.text, x.root) for x in e.collect()} == {(1, "funds", "funds"), (1, "account", "account"), (1, "teacher", "teacher"), (2, "balance", "balance"), (2, "bill", "bill")}
    assert {(x.source, x.target, x.relation) for x in r.where("prompt_id = 2").collect()} == {("check", "pay", "before"), ("check", "pay", "sequence")}
    nodes, edges = prompt_graph.build(a, e, r)
    assert nodes.count() == 10 and edges.where("relation = 'acts_on'").count() == 5


def test_catalogue_and_tables(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"name": "a", "inputs": ["x"]}, {"description": "d"}]')
    assert [(r.name, r.description, r.inputs, r.outputs) for r in D.read_functions(spark, str(tmp_path / "f.json")).collect()] == [("a", "", ["x"], []), ("", "d", [], [])]
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert D.read_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "p.txt").write_text("one\n\n two \n")
    assert sorted(r.text for r in D.read_prompts(spark, str(tmp_path / "p.txt")).collect()) == ["one", "two"]
    try:
        D.read_table(spark, "x.doc")
        raise AssertionError
    except ValueError as e:
        assert "unsupported" in str(e)


def test_reports(spark):
    order = spark.createDataFrame([(1, "a", 1)], "plan_id int, id string, position long")
    assert report.plan_lines(order).first().line == "1. a"
    n = spark.createDataFrame([("Op",)], "node_type string")
    e = spark.createDataFrame([(1, "a", "b", "r")], "prompt_id int, source string, target string, relation string")
    assert {r.line for r in report.summary_lines(n, e).collect()} == {"nodes Op: 1", "edges r: 1"} and report.edge_lines(e).first().line == "a -r-> b"
