"""Documents as a stream: late and repeated documents, windowed counts and a refreshed graph.

The reference computes in batches only; this is an addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioweave.sources.sinks import upserted


def stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(rows: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than that is dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts(rows: DataFrame, by: str, at: str = "ts", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and sums per window and kind; a window is final once the watermark passes it."""
    return rows.withWatermark(at, late).groupBy(F.window(at, every), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def refreshed_edges(rows: DataFrame, folder: str, checkpoint: str, edges: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A table of the edges inside each batch, upserted: `postings` has the graph across batches. Version N+1 is written beside version N, so a failed batch leaves the old one whole."""

    def step(batch: DataFrame, number: int) -> None:
        new = edges(batch)
        if number:
            new = upserted(batch.sparkSession.read.parquet(f"{folder}/v{number - 1}"), new)
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
