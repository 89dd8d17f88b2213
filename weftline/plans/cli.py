"""Jobs, by `python -m weftline.plans.cli`:

map RAW ONTOLOGY OUT [--batch-size N]; plan GRAPH FUNCTIONS PROMPTS OUT; ask GRAPH FUNCTIONS; train WORKFLOWS OUT;
store GRAPH --uri URI [--user U] [--password P] [--database D] [--batch-size N]. plan, ask and train take --embedding NAME (a model, or hash-N)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import documents as D
from ..sources import graph as G
from ..sources.sinks import read_graph, store_graph, write_json
from . import mapping, training
from .config import Config
from .models import embedding_of
from .pipeline import Pipeline
from .shell import converse


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("1 or more")
    return n


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="job", required=True)
    m = sub.add_parser("map")
    for a in ("raw", "ontology", "out"):
        m.add_argument(a)
    m.add_argument("--batch-size", type=positive, default=500)
    p = sub.add_parser("plan")
    for a in ("graph", "functions", "prompts", "out"):
        p.add_argument(a)
    q = sub.add_parser("ask")
    t = sub.add_parser("train")
    for job, names in ((q, ("graph", "functions")), (t, ("workflows", "out"))):
        for n in names:
            job.add_argument(n)
    config = Config.from_env()
    for job in (p, q, t):
        job.add_argument("--embedding", default=config.embedding_model)
    s = sub.add_parser("store")
    s.add_argument("graph")
    s.add_argument("--uri", required=True)
    for n in ("--user", "--password", "--database"):
        s.add_argument(n, default="")
    s.add_argument("--batch-size", type=positive, default=500)
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if a.job == "map":
        mapping.run(spark, a.raw, a.ontology, a.out, batch_size=a.batch_size)
        return
    if a.job == "train":
        print(training.run(spark, a.workflows, a.out, embedding_of(a.embedding)))
        return
    nodes, edges = read_graph(spark, a.graph)
    if a.job == "store":
        store_graph(nodes, edges, a.uri, a.user, a.password, a.database, a.batch_size)
        return
    nodes = G.decode_nodes(nodes).withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("seq", F.xxhash64("id"))
    edges = edges.select("source", "target", F.col("type").alias("relation"), F.col("relationship_index").cast("long").alias("seq"))
    functions = D.read_functions(spark, a.functions).withColumn("seq", F.xxhash64("name"))
    plans = Pipeline(nodes, edges, functions, embedding_of(a.embedding), None, config)
    if a.job == "ask":
        converse(plans.run, spark)
        return
    write_json(plans.run(D.read_prompts(spark, a.prompts)), a.out)


if __name__ == "__main__":
    main()
