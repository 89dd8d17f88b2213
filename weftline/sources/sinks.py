"""Sinks: keyed upserts, flattened properties, reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

IDENTIFIER = "^[A-Za-z][A-Za-z0-9_]*$"


def identifier(c):
    """The column, or an error for values that are no plain identifier."""
    return F.when(c.rlike(IDENTIFIER), c).otherwise(F.raise_error(F.concat(F.lit("not an identifier: "), F.coalesce(c, F.lit("null")))))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a new value that is not null replaces the old one."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") if c not in keys else F.col(c) for c in new.columns])
    merged = old.join(n, keys, "full_outer")
    return merged.select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c not in keys])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """As upsert, by (source, type, id, target); edges without both ends are dropped."""
    known = nodes.select("id").distinct()
    ok = new.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return upsert(old, ok, ["source", "type", "id", "target"])


def check_unique(df: DataFrame, key: str = "id") -> None:
    twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {[r[0] for r in twice]}")


def node_properties(nodes: DataFrame) -> DataFrame:
    """Flat node properties; raw records as JSON with sorted keys."""
    record = F.transform("raw_records", lambda r: F.struct(r["id"].alias("id"), r["name"].alias("name"), r["statement"].alias("statement")))
    return nodes.select("id", "name", "types", "raw_categories", F.to_json(record).alias("raw_records_json"))


def edge_properties(edges: DataFrame) -> DataFrame:
    return edges.select("id", "source", "target", "type", "condition", "raw_type", "relationship_index")


def label_sets(nodes: DataFrame) -> DataFrame:
    """(labels, n): nodes grouped by their whole set of labels."""
    return nodes.groupBy(F.array_sort(F.array_distinct("types")).alias("labels")).agg(F.count("*").alias("n"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, batch_size: int | None = None) -> None:
    """Nodes, and edges partitioned by type; with batch_size in files of at most so many rows, else in files as large as the tasks'."""
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be 1 or more")
    check_unique(nodes)
    most = batch_size or 0
    nodes.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{path}/nodes")
    edges.withColumn("type", identifier(F.col("type"))).write.mode("overwrite").option("maxRecordsPerFile", most).partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def store_graph(nodes: DataFrame, edges: DataFrame, uri: str, user: str = "", password: str = "", database: str = "", batch_size: int = 500) -> None:
    """Upsert a graph into the tables `nodes` and `edges` of a database by JDBC, in batches of `batch_size` rows; lists are stored as JSON.

    nodes: id and properties; edges: source, type, id, target and properties; those without both ends are dropped. Old and new rows are united before anything is written."""
    if batch_size < 1:
        raise ValueError("batch_size must be 1 or more")
    spark, url = nodes.sparkSession, f"{uri.rstrip('/')}/{database}" if database else uri
    login = {k: v for k, v in (("user", user), ("password", password)) if v}
    flat = lambda df: df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])

    def stored(name, columns):
        try:
            old = spark.read.format("jdbc").options(url=url, dbtable=name, **login).load()
        except Exception as missing:  # the first import: databases name an absent table in their own ways
            if not any(w in str(missing).lower() for w in ("not exist", "not found", "no such table", "unknown table", "invalid object")):
                raise
            return None
        return old.select(*[F.col(c).alias(next((n for n in columns if n.lower() == c.lower()), c)) for c in old.columns])

    def put(name, df):
        df.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch_size, **login).mode("overwrite").save()

    check_unique(nodes)
    nodes, edges = flat(nodes), flat(edges.withColumn("type", identifier(F.col("type"))))
    old_nodes, old_edges = stored("nodes", nodes.columns), stored("edges", edges.columns)
    nodes = cut(nodes if old_nodes is None else upsert(old_nodes, nodes, ["id"]))
    edges = cut(upsert_edges(edges.limit(0) if old_edges is None else old_edges, edges, nodes))
    put("nodes", nodes)
    put("edges", edges)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def migrate(spark: SparkSession, source: str, target: str) -> None:
    """Edges of a stored graph with categories and weights, written to a new place."""
    from ..functions.relations import edge_attributes

    nodes, edges = read_graph(spark, source)
    nodes.write.mode("overwrite").parquet(f"{target}/nodes")
    edge_attributes(edges).write.mode("overwrite").parquet(f"{target}/edges")


def log_stage(title: str, df: DataFrame, verbose: bool = True, rows: int = 20) -> None:
    """The first rows of a stage as JSON, to the log."""
    if verbose:
        for line in df.limit(rows).toJSON().collect():
            logging.getLogger("weftline").info("%s %s", title, line)
