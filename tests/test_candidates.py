import pytest
from pyspark.sql import functions as F

from weftline.operators import candidates as C
from weftline.operators import subgraph


def vectors(spark, n, *names):
    at = spark.range(n).select(F.col("id").alias("n"), F.array(F.sin(F.col("id") * 3.0), F.cos(F.col("id") * 3.0), F.lit(0.5)).alias("v"))
    return at.select([{"seq": F.col("n"), "v": F.col("v")}.get(x, F.concat(F.lit("t"), F.col("n"))).alias(y) for x, y in names])


@pytest.mark.parametrize("block", [1, 3])
def test_sets_beyond_a_block(spark, monkeypatch, block):
    steps = vectors(spark, 7, ("seq", "step_id"), ("", "text"), ("v", "query"))
    nodes = vectors(spark, 9, ("seq", "seq"), ("", "id"), ("", "name"), ("", "node_type"), ("", "description"), ("v", "embedding"))
    nodes = nodes.withColumn("aliases", F.array("name")).withColumn("types", F.array("name"))
    texts = steps.withColumnRenamed("step_id", "text_id")
    functions = nodes.withColumn("inputs", F.array("name")).withColumn("outputs", F.array("name"))
    concepts = steps.select(F.col("step_id").alias("prompt_id"), F.col("text").alias("id"), "text", "query")

    def found():
        out = [C.candidate_nodes(steps, nodes, 3), C.top_then_threshold(steps, nodes, 4, 0.1), C.match_functions(texts, functions, 0.5, 3), *subgraph.best_matches(concepts, nodes)]
        return [sorted(map(str, d.collect())) for d in out]

    want = found()
    monkeypatch.setattr(C, "BLOCK", block)
    assert found() == want and [len(x) for x in want[:3]] != [0, 0, 0]


def test_scores_equal_folds(spark):
    from weftline.functions import text as X
    from weftline.functions import vectors as V

    v = [[0.1 * i, 0.3, -1.7 / (i + 1)] for i in range(5)] + [[1e-300, 1e300, 3.0], [], None, [1.0], [1.0, None, 2.0]]
    w = [["a", "b"], ["b"], [], ["zz"], ["a", "b", "c"], ["c"], ["a"], ["b"], ["c", "a"], []]
    steps = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(v, w))], "step_id int, query array<double>, _qt array<string>")
    nodes = spark.createDataFrame([(i, x, [y, w[i - 1]] if i else None) for i, (x, y) in enumerate(zip(v[::-1], w))], "seq int, embedding array<double>, _nt array<array<string>>").repartition(3)
    both = C.scored(steps, nodes, ("query", "embedding"), ("_qt", "_nt"))
    q, e = F.col("query"), F.col("embedding")
    same = both.select(*[f(q, e, V.norm(q), V.norm(e), *p).alias(f"{f.__name__}{len(p)}") for f in (V.cosine_raw, V.cosine_client) for p in ((), (F.col("product"),))], "overlap", X.best_jaccard(F.col("_qt"), F.col("_nt")).alias("jaccard"))
    rows = same.collect()
    assert len(rows) == 100 and all(repr(r.cosine_raw0) == repr(r.cosine_raw1) and r.cosine_client0 == r.cosine_client1 and r.overlap == r.jaccard for r in rows)
    assert C.scored(steps.limit(0), nodes, ("query", "embedding"), ("_qt", "_nt")).count() == 0
