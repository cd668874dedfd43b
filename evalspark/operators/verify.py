"""Reconciliation: metric tables within a tolerance, known exceptions, swapped readings, per-sample cross checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import LETTERS


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Full outer join on ``keys`` with ``status``: match, differs, missing (theirs only) or extra (ours only). NaN equals NaN."""
    both = ours.select(*keys, F.col("value").alias("ours")).join(theirs.select(*keys, F.col("value").alias("theirs")), keys, "full_outer")
    close = (F.isnan("ours") & F.isnan("theirs")) | (F.abs(F.col("ours") - F.col("theirs")) <= tolerance)
    status = F.when(F.col("ours").isNull(), "missing").when(F.col("theirs").isNull(), "extra").when(F.isnan("ours") != F.isnan("theirs"), "differs").when(close, "match").otherwise("differs")
    return both.withColumn("status", status)


def excuse(reconciled: DataFrame, exceptions: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """A differing cell is ``known`` if an exception is listed for it and our value equals the value pinned there."""
    out = reconciled.join(exceptions.select(*keys, "pinned"), keys, "left")
    known = (F.col("status") == "differs") & (F.abs(F.col("ours") - F.col("pinned")) <= tolerance)
    return out.withColumn("status", F.when(F.coalesce(known, F.lit(False)), "known").otherwise(F.col("status"))).drop("pinned")


def swapped_hits(ours: DataFrame, published: DataFrame, tolerance: float) -> DataFrame:
    """(key, split, grp, value) on both sides: cells that fit the published split as printed, and with splits swapped."""
    flip = F.when(F.col("split") == "ambig", "disambig").otherwise("ambig")
    a = ours.join(published.withColumnRenamed("value", "as_printed"), ["model", "split", "grp"])
    a = a.join(published.select("model", flip.alias("split"), "grp", F.col("value").alias("swapped")), ["model", "split", "grp"])
    near = lambda c: F.count_if(F.abs(F.col("value") - F.col(c)) <= tolerance).alias(f"hits_{c}")
    return a.groupBy("model").agg(F.count("*").alias("cells"), near("as_printed"), near("swapped"))


def worst_deviation(reconciled: DataFrame, keys: list[str]) -> DataFrame:
    """The largest absolute difference and the key at which it occurs."""
    gap = F.abs(F.col("ours") - F.col("theirs"))
    rows = reconciled.where(~F.isnan("ours") & ~F.isnan("theirs"))
    at = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return rows.agg(F.max(gap).alias("worst"), F.max_by(at, F.struct(gap, at)).alias("at"))


def sample_faults(scored: DataFrame) -> DataFrame:
    """Samples whose recorded indicators contradict each other or their chosen role and label."""
    right = F.coalesce(F.col("chosen_role") == F.col("label_role"), F.lit(False)) & (F.col("outcome") == "answered")
    bad = (F.col("correct") != right.cast("double")) | (F.col("ft") + F.col("fo") > 1) | (F.col("correct") + F.col("ft") + F.col("fo") + F.col("unparsed") > 1)
    return scored.where(bad)


def cross_check(samples: DataFrame) -> DataFrame:
    """Samples (id, roles, label_role, polarity, target, chosen_at, correct, ft, fo, unparsed) with the ``problems`` that
    deriving them anew shows: bad roles, a target letter against the role's verdict, indicators against the derivation."""
    chosen = F.get("roles", F.col("chosen_at"))
    answered = F.col("chosen_at").isNotNull()
    right = F.coalesce(answered & (chosen == F.col("label_role")), F.lit(False))
    wrong = answered & ~right
    neg, nonneg = F.col("polarity") == "neg", F.col("polarity") == "nonneg"
    ft = wrong & ((neg & (chosen == "target")) | (nonneg & (chosen == "other")))
    fo = wrong & ((neg & (chosen == "other")) | (nonneg & (chosen == "target")))
    sound = F.coalesce((F.size("roles") == 3) & F.array_contains("roles", F.col("label_role")), F.lit(False))
    letter = F.get(F.array(*map(F.lit, LETTERS)), F.col("chosen_at")) == F.col("target")
    found = [F.when(answered & (F.coalesce(letter, F.lit(False)) != right), "target letter")]
    found += [F.when(~F.coalesce(F.col(k) == F.coalesce(v, F.lit(False)).cast("double"), F.lit(False)), k) for k, v in (("correct", right), ("ft", ft), ("fo", fo), ("unparsed", ~answered))]
    problems = F.when(~sound, F.array(F.lit("roles"))).otherwise(F.array_compact(F.array(*found)))
    return samples.withColumn("problems", problems).where(F.size("problems") > 0)


def same_members(a: DataFrame, b: DataFrame) -> tuple[bool, bool]:
    """Whether two one-column sets are equal, and whether the first lies within the second."""
    inside = a.distinct().exceptAll(b.distinct()).isEmpty()
    return inside and b.distinct().exceptAll(a.distinct()).isEmpty(), inside
