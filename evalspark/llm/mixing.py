"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key ``-ln(u) / quality``; the smaller the key, the earlier it is drawn. A source
that shall give ``target`` words gives every document ``floor(target / size)`` times (complete epochs) and draws the
rest of its budget in key order. Keys are cut into fixed buckets; a bucket of a source is taken, left, or holds the place
where the source's budget ends. Only buckets of the last kind are ordered row by row, over ranges of their rows, so no
source and no repeated row has to fit into one task.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, ordered last; an
empty table gives an empty mix; repeated rows are separate documents (their keys tie, and any of equal rows may be the
one that is drawn); a document is drawn for the rest of a budget only if there is a rest, so none comes more often than
``MOST_EPOCHS`` times; a source without words is left out; a very long text counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_prefix, ordered_sums, word_count

KEY_BUCKETS = 4096
MOST_EPOCHS = 3
#: Rows of the plan (one a source and bucket) that may be broadcast; a larger plan is joined by a shuffle.
BROADCAST_ROWS = 200_000
WEIGHT_CYCLE = (1, 2, 3)
SEED = "mix-1"


def text_quality(text: Column) -> Column:
    """Quality weight in [0.25, 1]: the share of letters and white space, squared, so that junk is drawn late."""
    junk = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    share = F.lit(1.0) - junk / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * share * share, F.lit(0.25))


def exponential_key(doc_id: Column, quality: Column, seed: str = SEED) -> Column:
    """``-ln(u) / quality`` with ``u`` in (0, 1) from 52 bits of md5(seed:doc_id), equal on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(2.0**52)
    return -F.log(u) / quality


def key_bucket(key: Column, buckets: int = KEY_BUCKETS) -> Column:
    """Monotone bucket of a key; two scales, so that neither high nor low qualities crowd a few buckets."""
    x = F.lit(1.0) - F.exp(-key) / F.lit(2.0) - F.exp(-key / F.lit(4.0)) / F.lit(2.0)
    return F.least(F.floor(x * F.lit(float(buckets))), F.lit(buckets - 1)).cast("int")


def source_targets(sizes: DataFrame, most: int = MOST_EPOCHS, cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """(source, source_size) -> + target. Weighted shares of the total; none above ``most`` times its size.

    The capped shares are found in closed form: with sources in order of cap / weight, the water level is the largest
    of (total - caps before) / (weights from here on).
    """
    named = cut(sizes.select(F.col("source").isNull().alias("unnamed"), "source", "source_size"))
    named = ordered_sums(named, [], ["unnamed", "source"], {"place": F.lit(1).cast("long")})
    ranked = named.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod("place", F.lit(len(cycle))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("turn", F.col("cap") / F.col("weight"))
    ranked = ordered_sums(cut(ranked), [], ["turn", "unnamed", "source"], {"caps": F.col("cap"), "weights": F.col("weight")})
    every = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = F.max((F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("weights"))).alias("level")
    ranked = cut(ranked)
    level = ranked.join(F.broadcast(every)).agg(level)  # one row
    return ranked.join(F.broadcast(level)).select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _sized(docs: DataFrame, p: str, quality: Column | None, seed: str) -> dict[str, Column]:
    text = docs["text"]
    key = exponential_key(docs["doc_id"], text_quality(text) if quality is None else quality, seed)
    return {f"{p}size": word_count(text), f"{p}key": key, f"{p}bucket": key_bucket(key)}


def plan_buckets(rows: DataFrame) -> DataFrame:
    """(source, bucket, size) -> a row for every source and bucket: source_size, weight, target, epochs, rest, first
    (words of the buckets before) and state: 1 if the rest of the budget takes the bucket, 0 if not, 2 if it ends there."""
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most KEY_BUCKETS rows
    plan = sums.withColumn("first", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    t = targets.withColumnRenamed("source", "t_source")
    plan = plan.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    full, none = F.col("first") + F.col("bucket_size") <= F.col("rest"), (F.col("rest") <= 0) | (F.col("first") >= F.col("rest"))
    return cut(plan.withColumn("state", F.when(none, 0).when(full, 1).otherwise(2)).drop("bucket_size"))


def _join_plan(rows: DataFrame, plan: DataFrame, p: str) -> DataFrame:
    """Adds the plan's columns, with ``p`` in front, to rows that have <p>bucket."""
    plan = plan.select(*[F.col(c).alias(f"{p}of_{c}" if c in ("source", "bucket") else f"{p}{c}") for c in plan.columns])
    same = rows["source"].eqNullSafe(F.col(f"{p}of_source")) & (rows[f"{p}bucket"] == F.col(f"{p}of_bucket"))
    return rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, same).drop(f"{p}of_source", f"{p}of_bucket")


def _pick(rows: DataFrame, p: str) -> DataFrame:
    """Adds <p>picked: whether the rest of the source's budget takes the row."""
    clear = rows.where(F.col(f"{p}state") != 2).withColumn(f"{p}picked", F.col(f"{p}state") == 1)
    edge = cut(rows.where(F.col(f"{p}state") == 2))
    edge = ordered_sums(edge, ["source", f"{p}bucket"], [f"{p}key", "doc_id", f"{p}size"], {f"{p}ahead": F.col(f"{p}size")})
    ahead = F.col(f"{p}first") + F.col(f"{p}ahead")
    edge = edge.withColumn(f"{p}picked", ahead + F.col(f"{p}size") / F.lit(2.0) <= F.col(f"{p}rest")).drop(f"{p}ahead")
    return clear.unionByName(edge)


def mix(docs: DataFrame, quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, weight, target, epochs, picked, taken.

    ``docs`` needs doc_id, source and text. The text is read once; what follows works on some 50 bytes a row.
    """
    sized = _sized(docs, "", quality, seed)
    rows = cut(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), *[c.alias(n) for n, c in sized.items()]))
    taken = F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))
    return _pick(_join_plan(rows, plan_buckets(rows), ""), "").withColumn("taken", taken).drop("key", "bucket", "state", "first", "rest")


def apply_mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as the mix takes it.

    The plan of buckets comes to the rows; only rows of a bucket in which a budget ends are shuffled.
    """
    p = free_prefix(docs, "_mix_")
    sized = docs.withColumns(_sized(docs, p, None, seed))
    plan = plan_buckets(sized.select("source", F.col(f"{p}bucket").alias("bucket"), F.col(f"{p}size").alias("size")))
    rows = _pick(_join_plan(sized, plan, p), p)
    times = (F.col(f"{p}epochs") + F.col(f"{p}picked").cast("long")).cast("int")
    return rows.withColumn(f"{p}copy", F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
