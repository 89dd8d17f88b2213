import pytest
from pyspark.sql import functions as F

from weftline.functions import relations as R
from weftline.functions import text as X
from weftline.functions import vectors as V


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,steps",
    [("a, then b", ["a", "b"]), ("a then b", ["a", "b"]), ("a; b", ["a", "b"]), ("a; b then c", ["a; b", "c"]), (";", []), ("", [""]), ("\ta\n", ["a"])],
)
def test_explicit_steps(spark, text, steps):
    assert one(spark, X.explicit_steps(F.lit(text))) == steps


def test_normalisers_differ(spark):
    assert one(spark, X.norm(F.lit("Re-set_PIN!  now"))) == "re set pin now"
    assert one(spark, X.norm_builder(F.lit(" Re-set_PIN!"))) == "re-set pin!"
    assert one(spark, X.norm_term(F.lit("Depends-On"))) == "depends on"
    assert one(spark, X.token_set(F.lit(None).cast("string"))) == []


def test_lexical(spark):
    names = F.array(F.lit("transfer funds"), F.lit(None), F.lit("x"))
    assert one(spark, X.lexical(F.lit("transfer money"), names)) == pytest.approx(1 / 3)
    assert one(spark, X.lexical(F.lit(""), names)) == 0.0


def test_contradiction(spark):
    c = lambda p, r: one(spark, X.contradicts(F.lit(p), F.lit(r)))
    assert c("use an inactive account", "account must be active")
    assert c("skip the verification", "verification must be done")
    assert c("you cannot verify", "verify it")
    assert not c("not the", "the rule")
    assert not c("check the account", "account must be active")


@pytest.mark.parametrize(
    "raw,ok", [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('Sure: {"a": 1} bye', True), ("none", False), ("[1]", False), ("{broken", False)]
)
def test_recover_json(spark, raw, ok):
    assert (one(spark, X.recover_json(F.lit(raw))) is not None) == ok


def test_record_text(spark):
    raw = '[{"statement": "must be 18", "summary": "age"}, {"description": "d"}]'
    a = X.node_text_records(F.lit("Rule"), F.lit("r"), F.array(F.lit("Rule")), F.lit(raw))
    b = X.node_text_records(F.lit(None).cast("string"), F.lit("r"), F.array(F.lit("Rule")), F.lit("oops"))
    assert one(spark, a) == "Rule Rule must be 18 age d" and one(spark, b) == "r Rule"


def test_cosines(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    none = F.lit(None).cast("array<double>")
    assert one(spark, V.cosine_client(a(1, 0), a(0, 1))) == 0.5
    assert one(spark, V.cosine_client(a(1, 0), a(1, 0, 0))) == 0.0
    assert one(spark, V.cosine_builder(a(1, 0), a(1, 0, 0))) == 1.0
    assert one(spark, V.cosine_client(a(0, 0), a(1, 0))) == 0.0
    assert one(spark, V.cosine_client(none, a(1, 0))) == 0.0
    assert one(spark, V.cosine_raw(a(1, 0), a(-2, 0))) == -1.0


def test_blends(spark):
    assert one(spark, V.blend_direct(F.lit(0.80), F.lit(0.50), F.lit(0.71))) == pytest.approx(0.677)
    assert one(spark, V.blend_neighbour(F.lit(0.5), F.lit(0.0), F.lit(0.2))) == pytest.approx(0.30)


def test_relations(spark):
    s = lambda r: tuple(one(spark, R.semantics(F.lit(r))))
    assert s("OPERATION_INCLUDES") == ("mandatory", 2.0, "REQUIRED", True)
    assert s("PROMPT_OR") == ("alternative", 2.0, "POSSIBLE", False)
    assert s("PROMPT_X") == ("optional", 5.0, "OPTIONAL", False) and s("?") == ("optional", 8.0, "OPTIONAL", False)
    assert tuple(one(spark, R.routing(F.lit(" event_triggers ")))) == ("mandatory", 2)
    assert one(spark, R.relevance(F.lit("PROMPT_DEPENDENCY"))) == 0.2
    op, ent = F.lit("Operation"), F.lit("Entity")
    k = lambda a, b, r: one(spark, R.connectivity(a, b, F.lit(r)))
    assert (k(op, op, "PROMPT_PRECEDES"), k(op, op, "OPERATION_INCLUDES"), k(op, op, "x"), k(op, ent, "ENTITY_OWNS"), k(op, ent, "RULE_CONSTRAINS")) == (0.2, 0.12, 0.1, 0.03, 0.0)
    assert one(spark, R.compatibility(F.lit("OPERATION_INCLUDES"), F.lit("REQUIRED"))) == 0.12


def test_edge_attributes(spark):
    rows = spark.createDataFrame([("success", None, None), (None, " Deprecated", None), (None, "odd", 7)], "transition string, edge_type string, weight int")
    assert [(r.relation, r.edge_type, r.weight, r.confidence) for r in R.edge_attributes(rows).collect()] == [("success", "mandatory", 1, 1.0), ("success", "deprecated", 100, 1.0), ("success", "mandatory", 7, 1.0)]
    none = F.lit(None).cast("string")
    got = [one(spark, F.struct(R.migrated_category(none, none, F.lit(t)).alias("c"), R.category_weight(R.migrated_category(none, none, F.lit(t))).alias("w"))) for t in ("success", "optional", "deprecated")]
    assert [tuple(g) for g in got] == [("mandatory", 1), ("optional", 5), ("deprecated", 100)]
