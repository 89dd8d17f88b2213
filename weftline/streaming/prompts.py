"""A stream of prompts through the pipeline, one micro-batch at a time; the batch id in the path makes a replay overwrite its own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.format("text").load(folder).where(F.trim("value") != "")
    return rows.select(F.sha2("value", 256).alias("prompt_id"), F.trim("value").alias("text"))


def plan(prompts: DataFrame, pipeline, out: str, checkpoint: str):
    """Start the stream; returns the query."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.dropDuplicates(["prompt_id"])
        if not rows.isEmpty():
            pipeline.run(rows).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return prompts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
