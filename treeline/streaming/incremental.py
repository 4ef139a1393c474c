"""A minimum spanning forest kept over a stream of edges.

The forest of old and new edges is the forest of the old forest and the new edges, so the state is a
forest, whatever the order of arrival; edges need no time and no watermark. Every batch writes the next
forest beside the last one, under the batch's number, so a batch that is repeated writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.forest import EDGE, minimum_spanning_forest
from ..plans.shared import drop


def forest_at(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.schema(EDGE).parquet(f"{path}/batch={batch}") if batch >= 0 else spark.createDataFrame([], EDGE)


def latest_forest(spark: SparkSession, path: str) -> DataFrame:
    """The forest after the last batch."""
    kept = spark.read.parquet(path)
    last = kept.select("batch").agg({"batch": "max"}).first()[0]
    return kept.filter(kept["batch"] == last).select("src", "dst", "weight")


def maintain_forest(edges: DataFrame, path: str, checkpoint: str, strategy: str = "two_level", **trigger: object) -> StreamingQuery:
    """Keeps the forest of all edges seen in ``path``; ``forest_at`` reads it after a batch."""

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = forest_at(spark, path, number - 1).union(batch.select("src", "dst", "weight"))
        minimum_spanning_forest(both, strategy).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number >= 2:  # the last but one is kept for a batch that is repeated
            drop(spark, f"{path}/batch={number - 2}")

    return edges.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
