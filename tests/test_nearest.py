import os

import pytest
from oracle import TABLES, same
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.operators import candidates as C
from weftline.operators.ranking import top_k
from weftline.plans.queries import QUERIES, SQL

ODD = [[0.1 * i, 0.3, -1.7 / (i + 1)] for i in range(5)] + [[1e-300, 1e300, 3.0], [], None, [1.0], [1.0, None, 2.0], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0]]
WORDS = [["a", "b"], ["b"], [], ["zz"], ["a", "b", "c"], ["c"], ["a"], ["b"], ["c", "a"], [], ["b", "a"], ["zz", "c"]]


def refuse(*_):
    raise AssertionError("a row for each pair")


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("k", [1, 4, 50])
def test_best_of_odd_rows(spark, monkeypatch, block, k):
    steps = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(ODD, WORDS))], "step_id int, query array<double>, _qt array<string>")
    rows = [(100 - i, x, [y, WORDS[i % 12 - 1]] if i else None) for i, (x, y) in enumerate(zip(ODD[::-1] + ODD, WORDS + WORDS))]
    nodes = spark.createDataFrame(rows, "seq int, embedding array<double>, _nt array<array<string>>").repartition(3)
    q, e, both = F.col("query"), F.col("embedding"), steps.crossJoin(nodes)
    best = lambda score: sorted(map(str, top_k(both.select("step_id", "seq", score.alias("score")), ["step_id"], [F.col("score").desc(), F.col("seq")], k).collect()))
    shown = lambda df: sorted(map(str, df.select("step_id", "seq", "score", "rank").collect()))
    monkeypatch.setattr(C, "SCORED", block)
    monkeypatch.setattr(C, "BESIDE", 2 * block + 1)
    vectors, words = ("query", "embedding"), ("_qt", "_nt")
    jaccard = X.best_jaccard(F.col("_qt"), F.col("_nt"))
    assert shown(C.nearest(steps, nodes, k, "step_id", "seq", vectors)) == best(V.cosine_raw(q, e))
    assert shown(C.nearest(steps, nodes, k, "step_id", "seq", vectors, words, C.client, V.blend_client)) == best(V.blend_client(V.cosine_client(q, e), jaccard))
    assert shown(C.nearest(steps, nodes, k, "step_id", "seq", words=words)) == best(jaccard)
    assert C.nearest(steps.limit(0), nodes, k, "step_id", "seq", vectors).count() == 0 == C.nearest(steps, nodes.limit(0), k, "step_id", "seq", vectors).count()


@pytest.mark.parametrize("name", ["function_match", "lexical_scores", "workflow_documents"])
def test_searches_list_no_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(C, "pairs", refuse)
    monkeypatch.setattr(C, "scored", refuse)
    assert QUERIES[name](spark, data).count() > 0


def test_lexical_scores_of_odd_parts(spark, data, tmp_path):
    """Copies beyond five, equal sets in another order, null and empty names; no name may be lost and no group left out."""
    names = ["red bolt", "bolt red", "Red  Bolt", "", None, "hot_gear", "zz", "!!", "gear gear"]
    rows = [(i, names[i % 7 if i < 140 else i % 9], f"Brand#{i % 2}", "LARGE" if i % 3 else "SMALL") for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    for t in set(TABLES) - {"part"}:
        os.symlink(f"{data}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    assert QUERIES["lexical_scores"](spark, str(tmp_path)).count() == 30
    same(spark, str(tmp_path), QUERIES["lexical_scores"], SQL["lexical_scores"])
