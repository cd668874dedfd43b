"""Structured Streaming over completion files: stateless scoring and appends that add each completion once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score_completions
from ..sources.commits import KeyedTable

COMPLETIONS = "run_key string, id string, completion string, stop_reason string, created timestamp"


def stream_scored(spark: SparkSession, path: str, samples: DataFrame, style: str = "clean", schema: str = COMPLETIONS, delay: str = "1 hour") -> DataFrame:
    """New completion files joined to the samples and scored; a completion that arrives twice within ``delay`` counts once."""
    new = spark.readStream.schema(schema).parquet(path).withWatermark("created", delay).dropDuplicatesWithinWatermark(["run_key", "id"])
    return score_completions(new.join(samples, "id"), style)


def append_scored(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch into its own folder, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_table(spark: SparkSession, path: str, rows: DataFrame, key: tuple[str, ...] = ("run_key", "id"), order: str = "id") -> KeyedTable:
    """A table for the rows of a stream, one for each key for as long as the table lasts."""
    columns = [f for f in rows.schema if f.name != "line_no"]
    return KeyedTable(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), list(key), order, "parquet")


def append_keyed(rows: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Append each batch to ``table`` under its number and the checkpoint's name: a batch that runs again is known by its
    number, and a completion that comes again after any watermark by its key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, writer=checkpoint, number=batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
