"""How filters interact: for every order of the filters what each step removes, from one count of failure masks.

Each document is judged once by every filter; the filters that it fails make a mask. Documents are counted by part and
mask, and a subset-zeta transform turns the 32 counts of a part into the number of documents that survive any set of
filters. What a step of an order removes is then the difference between two neighbouring sets, likewise for labels, and
the sum over all orders (the Shapley count) weighs each such difference by the number of orders that pass it.

The text is read once, for its failures and its digest; copies are told apart by digest, and rows of equal digest are
counted before they meet, so a text that a third of all rows share is a few rows a task.

Defined cases: a null text is an empty one and a null source the empty string; a null doc_id has no label, is no copy
and makes none; repeated rows count each, and are not copies of each other, since none has the smaller id; labels that
repeat a doc_id count as 1 if one of them is; very long texts are judged whole; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
#: The filters by their letters; the one for copies is judged against the whole table, the others on the text alone.
TEXT_FILTERS, COPY_FILTER = "ABCD", "E"
FILTERS = TEXT_FILTERS + COPY_FILTER


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text without nulls fails each of the text filters; ``words`` are its words."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITAL_PERCENT,
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask (of the text filters) of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"))
    mask = sum((F.when(fails, _bit(f)).otherwise(0) for f, fails in text_failures(F.col("text"), F.col("words")).items()), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask -> n, good, toxic: documents that fail exactly the filters of the mask, and how many of them are labelled so."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    rows = judged(docs)
    none = [F.lit(0).alias("good"), F.lit(0).alias("toxic")]
    named = rows.where("doc_id is not null").join(flags, F.col("doc_id") == F.col("labelled"), "left")
    kind = ["digest", "part", "mask", "good", "toxic"]
    named = named.select("doc_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # rows of one id, then rows of one text: what is left of a text is at most four rows a part
    by_id = named.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    texts = by_id.groupBy(*kind).agg(F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.sum("n").alias("n"))
    original = F.when(F.col("first") == F.min("first").over(Window.partitionBy("digest")), F.col("at_first")).otherwise(0)
    halves = F.array(F.struct("mask", F.col("original").alias("n")), F.struct((F.col("mask") + _bit(COPY_FILTER)).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    split = texts.withColumn("original", original).select("part", "good", "toxic", F.explode(halves).alias("x")).select("part", "x.mask", "x.n", "good", "toxic")
    unnamed = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", *none)
    n = F.col("n")
    return split.unionByName(unnamed).groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def subset_sums(values: Column, bits: int) -> Column:
    """The zeta transform: at every mask the sum of ``values`` over all masks within it."""
    steps = F.array(*[F.lit(1 << b) for b in range(bits)])
    places = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    within = lambda acc, bit: F.transform(places, lambda i: F.get(acc, i) + F.when(i.bitwiseAND(bit) != 0, F.get(acc, i - bit)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(steps, values, within)


def survivors(counts: DataFrame, values: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """part -> for each of ``values`` an array: at every set of filters what passes all filters of the set."""
    every = (1 << len(FILTERS)) - 1
    at_each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(every)), f)
    count_of = lambda v: at_each(lambda i: F.coalesce(F.element_at(F.col(v), i), F.lit(0).cast("long")))
    passing = lambda v: at_each(lambda i: F.get(F.col(v), F.lit(every) - i))
    maps = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", v))).alias(v) for v in values])  # at most 32 entries
    dense = maps.select("part", *[count_of(v).alias(v) for v in values])
    sums = dense.select("part", *[subset_sums(F.col(v), len(FILTERS)).alias(v) for v in values])
    # who passes a set fails at most the others
    return sums.select("part", *[passing(v).alias(v) for v in values])


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    every = (1 << len(FILTERS)) - 1
    bit_of = lambda letter: F.element_at(F.array(*[F.lit(_bit(f)) for f in FILTERS]), F.instr(F.lit(FILTERS), letter))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = survivors(mask_counts(docs, labels)).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda acc, f: acc + F.coalesce(F.when(f != "", bit_of(f)), F.lit(0)))
    rows = rows.withColumn("bit", bit_of(letter)).withColumn("before", earlier)
    at = lambda v, s: F.get(F.col(v), s)
    after = F.col("before") + F.col("bit")
    lost = lambda v: at(v, F.col("before")) - at(v, after)
    m = len(FILTERS)
    orders_through = F.array(*[F.lit(factorial(k) * factorial(m - 1 - k)).cast("long") for k in range(m)])
    gain = lambda s: F.get(orders_through, F.bit_count(s)) * (at("n", s) - at("n", s + F.col("bit")))
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(every)), F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(F.col("bit")) == 0, gain(s)).otherwise(F.lit(0).cast("long")))
    failing = at("n", F.lit(0)) - at("n", F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        (at("n", F.lit(every) - F.col("bit")) - at("n", F.lit(every))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )
