"""Top-k, argmax and first- or last-wins, all with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def first_wins(df: DataFrame, by: list, order: list) -> DataFrame:
    return top_k(df, by, order, 1, "_first").drop("_first")


def last_wins(df: DataFrame, by: list, seq: str = "seq") -> DataFrame:
    """Parallel rows of a key: the last one written stays."""
    return first_wins(df, by, [F.col(seq).desc()])


def dedup_steps(steps: DataFrame, norm: Column) -> DataFrame:
    """One step for each prompt and normalised text: explicit ones first, then the earliest."""
    return first_wins(steps.withColumn("_n", norm).where("_n <> ''"), ["prompt_id", "_n"], [F.col("explicit").desc(), F.col("pos")]).drop("_n")
