import random

from pyspark.sql import functions as F
from test_methods import plain_removal

from weftline.llm import substring_dedup as B


def test_equal_texts_are_spread(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(400))
    docs = spark.createDataFrame([(i, text) for i in range(600)], "doc_id long, text string")
    again = B.recurring(B.keyed(docs, "doc_id", "text"), 100, 16, 30).select("id", "k", F.explode("at").alias("e")).select("id", "k", "e.*")
    n = again.count()
    rows = [x["count"] for x in again.groupBy(B.bucket(-(-n // 30)).alias("b")).count().collect()]
    assert n >= 600 and max(rows) < 300
    got = B.remove_repeats(docs, digest=True, task_rows=30)
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == plain_removal([(i, text) for i in range(600)])
