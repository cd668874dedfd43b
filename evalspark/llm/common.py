"""Helpers that several operators share: scratch checkpoints, table readers, Arrow batch bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import free_prefix
from ..functions.numbering import prefix_sums as ordered_sums
from ..runtime import cut, ensure_checkpoint_dir, ship_package

__all__ = ["TEXT_BATCH_BYTES", "WORD", "bound_batches", "cut", "ensure_checkpoint_dir", "free_prefix", "ordered_sums", "parts_for", "read", "ship_package", "word_count"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one Arrow batch may carry; a larger text is a batch by itself.
TEXT_BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, most: int = TEXT_BATCH_BYTES) -> None:
    """Keep Arrow batches of whole texts small. Plans read the setting when they run, so it stays for the session; narrow
    rows still come 10,000 at a time."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def word_count(text: Column) -> Column:
    """Number of words; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-rows // per_part))
