"""JSON documents, catalogues and tables of files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EMPTY
from . import schemas


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of functions; what is missing is empty."""
    rows = spark.read.schema(schemas.FUNCTION).option("multiLine", True).json(path)
    return rows.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), *[F.coalesce(c, F.expr(EMPTY)).alias(c) for c in ("inputs", "outputs")])


def read_first_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first JSON value of a text file, whatever follows it; a value that is no object is an error."""
    text = spark.read.text(path, wholetext=True)
    value = F.when(F.substring(F.ltrim("value"), 1, 1) == "{", F.from_json("value", schema)).otherwise(F.raise_error(F.lit("the input must begin with a JSON object")))
    return text.select(value.alias("v")).select("v.*")


def raw_schema(categories: list[str]) -> str:
    return ", ".join([f"{c} array<{schemas.RAW_RECORD}>" for c in categories] + [f"relationships array<{schemas.RAW_RELATIONSHIP}>"])


def raw_records(raw: DataFrame, node_types: dict[str, str]) -> DataFrame:
    """seq, id, name, statement, category, type: categories in the ontology's order, then unknown ones (type null)."""
    known = [c for c in node_types if c in raw.columns]
    rest = [c for c in raw.columns if c not in node_types and c != "relationships" and dict(raw.dtypes)[c].startswith("array")]
    out = None
    for k, c in enumerate(known + rest):
        part = raw.select(F.posexplode(c).alias("p", "r")).select((F.lit(k) * (1 << 32) + F.col("p")).cast("long").alias("seq"), "r.id", "r.name", "r.statement", F.lit(c).alias("category"), F.lit(node_types.get(c)).cast("string").alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def raw_relationships(raw: DataFrame) -> DataFrame:
    return raw.select(F.posexplode("relationships").alias("relationship_index", "r")).select("relationship_index", "r.*")


def ontology_terms(ontology: DataFrame) -> DataFrame:
    """def_index (the precedence), type, raw_term, source_types, target_types."""
    return ontology.select(F.posexplode("relationships").alias("def_index", "d")).select("def_index", "d.type", F.explode("d.raw_terms").alias("raw_term"), "d.source_types", "d.target_types")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole JSON files, one document or an array of rows each; the schema is inferred if none is given."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_table(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """.csv by Spark, quotes doubled, .xlsx by pandas; anything else is an error. Without line breaks within cells a large .csv is read in splits."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        return spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks).csv(path)
    if kind == ".xlsx":
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"unsupported file type {kind!r}")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt a line; blank lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.sha2("value", 256).alias("prompt_id"), F.trim("value").alias("text"))
