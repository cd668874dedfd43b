"""Prefix sums and row numbers in order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def free_prefix(df: DataFrame, stem: str) -> str:
    """A prefix that no column of ``df`` begins with."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums over the rows before each row, of its ``keys`` and in its ``order``, under the names of ``sums``.

    Two passes: rows are dealt by ranges of keys, order and place, so that neither one key, nor one order value, nor sparse
    values, nor one repeated row make one task; the ranges' totals, at most one row a range and key, are summed, and each
    range goes on from what lies before it. Null keys are one key; null orders come first; of wholly equal rows any may
    come first. ``df`` must give the same rows in the same places whenever it is read.
    """
    p = free_prefix(df, "_sum_")
    part, place = f"{p}-part", f"{p}-place"
    named = {n: f"{p}{n}" for n in sums}
    rows = df.withColumns({named[n]: c for n, c in sums.items()} | {place: F.monotonically_increasing_id()})
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(ranges, *keys, *order, place).withColumn(part, F.spark_partition_id()))
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, part).agg(*[F.sum(c).alias(c) for c in named.values()])
    totals = totals.select(*[F.col(k).alias(f"{p}-key-{k}") for k in keys], F.col(part).alias(f"{p}-range"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in named.values()])
    same = F.col(f"`{part}`") == F.col(f"{p}-range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{p}-key-{k}"))
    inner = Window.partitionBy(*keys, part).orderBy(*order, place).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(totals, same).withColumns({n: F.col(f"{c}_ahead") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in named.items()})
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *sums)


def numbered(df: DataFrame, key: str | list[str], order: str | list[str], out: str = "position") -> DataFrame:
    """``df`` with numbers from 1 within ``key`` in the order of ``order``; both may be several columns, ``key`` none."""
    keys, by = ([x] if isinstance(x, str) else x for x in (key, order))
    return prefix_sums(df, keys, by, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) + 1)
