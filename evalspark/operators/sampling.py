"""Items to samples: conversion, stratified top-k, option permutation."""

from __future__ import annotations

import ast
import hashlib
import random
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..domain import CATEGORIES, LETTERS, ROLES, resolve_categories
from ..functions.numbering import numbered
from ..functions.text import strip
from ..functions.twister import shuffles
from ..runtime import ship_package


@F.pandas_udf(MapType(StringType(), StringType()))
def _literal_map(text: pd.Series) -> pd.Series:
    """Python dict literals; anything else is null."""

    def read(s: str | None) -> dict | None:
        if s is None:
            return None
        try:
            d = ast.literal_eval(s.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return {str(k): None if v is None else str(v) for k, v in d.items()} if isinstance(d, dict) else None

    return text.map(read)


def parse_answer_info(text: Column) -> Column:
    """The three option texts of a dict literal, stripped; null if one is missing or blank.

    Most literals are JSON to Spark's lenient reader; only those that are not (escapes, joined strings) reach Python.
    """
    plain = F.from_json(text, "map<string,string>")
    m = F.coalesce(plain, _literal_map(F.when(plain.isNull(), text)))
    texts = F.transform(F.array(*[F.try_element_at(m, F.lit(f"ans{i}")) for i in range(3)]), lambda x: strip(x))
    return F.when(F.forall(texts, lambda x: x.isNotNull() & (x != "")), texts)


def as_int(text: Column) -> Column:
    """A whole number written plainly ('1.0' and booleans are none)."""
    t = strip(text.cast("string"))
    return F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("int"))


def as_bool(text: Column) -> Column:
    """true/false in any case, or 0/1; anything else is null."""
    t = F.lower(strip(text.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def option_roles(target: Column, other: Column) -> Column:
    """Roles of options 0..2 from the places of target and other; null if they are out of range or equal."""
    ok = target.between(0, 2) & other.between(0, 2) & (target != other)
    return F.when(ok, F.array(*[F.when(target == i, "target").when(other == i, "other").otherwise("unknown") for i in range(3)]))


def convert_items(rows: DataFrame, unknown_text: str, drop_bbq: bool = False) -> DataFrame:
    """Raw rows (category, language, source_row, context_condition, question_polarity, context, question, answer_info,
    target, other, label, bbq as strings) -> items with id and a ``fault`` text, null where the row is sound.

    Kept rows are numbered from 1 within their category in source order; source_row counts all rows.
    """
    df = rows.withColumns({"is_bbq": as_bool(F.col("bbq")), "texts": parse_answer_info(F.col("answer_info")), "roles": option_roles(as_int(F.col("target")), as_int(F.col("other"))), "label_at": as_int(F.col("label"))})
    df = df.withColumns({k: strip(F.col(k)) for k in ("context", "question", "context_condition", "question_polarity")})
    if drop_bbq:
        df = df.where(~F.col("is_bbq"))
    df = numbered(df, "category", "source_row")
    df = df.withColumn("label_role", F.get("roles", F.col("label_at")))
    unknown = F.get("texts", F.array_position("roles", "unknown").cast("int") - 1)
    fault = (
        F.when(F.coalesce(F.col("context"), F.lit("")) == "", "context").when(F.coalesce(F.col("question"), F.lit("")) == "", "question")
        .when(F.col("texts").isNull(), "answer_info").when(F.col("roles").isNull(), "target/other").when(~F.coalesce(F.col("label_at").between(0, 2), F.lit(False)), "label")
        .when(F.col("is_bbq").isNull(), "bbq").when(~F.coalesce(F.col("question_polarity").isin("neg", "nonneg"), F.lit(False)), "question_polarity")
        .when(unknown != unknown_text, "unknown text")
        .when((F.col("context_condition") == "ambig") != (F.col("label_role") == "unknown"), "label/condition")
    )
    options = F.when(F.col("texts").isNotNull() & F.col("roles").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.get("texts", i).alias("text"), F.get("roles", i).alias("role"))))
    return df.select(F.format_string("%s-%s-%04d", "category", "language", "position").alias("id"), "category", "language", "source_row", "context_condition", "question_polarity", "context", "question", options.alias("options"), "label_role", F.col("is_bbq").alias("bbq"), fault.alias("fault"))


def all_categories(converted: list[DataFrame]) -> DataFrame:
    """The conversions of several files as one table, columns by name."""
    out = converted[0]
    for df in converted[1:]:
        out = out.unionByName(df)
    return out


def where_categories(items: DataFrame, requested: str | list[str] | None, canonical: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Items of the named categories; the filter reaches the scan."""
    return items if requested is None else items.where(F.col("category").isin(*resolve_categories(requested, canonical)))


def source_pairs(available: DataFrame, versions: tuple[str, ...], languages: tuple[str, ...]) -> DataFrame:
    """Every (version, language) pair and whether ``available`` has it; a literal grid of a few rows."""
    grid = available.sparkSession.createDataFrame([(v, x) for v in versions for x in languages], "version string, language string")
    return grid.join(available.select("version", "language").distinct().withColumn("hit", F.lit(True)), ["version", "language"], "left").select("version", "language", F.coalesce("hit", F.lit(False)).alias("available"))


def missing_names(wanted: list[str], df: DataFrame, column: str) -> list[str]:
    """Names of a short list that no row of ``df`` has, in their order."""
    have = {r[0] for r in df.where(F.col(column).isin(*wanted)).select(column).distinct().collect()} if wanted else set()
    return [x for x in wanted if x not in have]


def stratified_top_k(items: DataFrame, k: int, stratum: str = "category", cells: tuple[str, ...] = ("split", "polarity"), id_col: str = "id") -> DataFrame:
    """At most ``k`` items a stratum, dealt round-robin over its cells, each cell in order of sha256(id).

    Two windows; within a cell ``row_number() <= k`` is pushed below the second one, so at most k rows a cell move.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    digest = F.sha2(F.col(id_col).cast("binary"), 256)
    inner = items.withColumn("_pos", F.row_number().over(Window.partitionBy(stratum, *cells).orderBy(digest, id_col))).where(F.col("_pos") <= k)
    dealt = inner.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_pos", *cells)))
    return dealt.where(F.col("_rank") <= k).drop("_pos", "_rank")


def seeded_order(item_id: str) -> list[int]:
    """The option order of an item: a shuffle of three seeded by the first 8 bytes of sha256(id)."""
    seed = int.from_bytes(hashlib.sha256(item_id.encode()).digest()[:8], "big")
    return random.Random(seed).sample(range(3), 3)


def permute_options(items: DataFrame, id_col: str = "id", native: bool = False) -> DataFrame:
    """Adds ``order`` (array of option places), that of ``seeded_order`` for whole batches at once; null for a null id.

    ``native`` picks one of the six orders by hash without Python."""
    if native:
        orders = F.array(*[F.array(*map(F.lit, p)) for p in permutations(range(3))])
        place = F.conv(F.substring(F.sha2(F.col(id_col).cast("binary"), 256), 1, 8), 16, 10).cast("long") % 6
        return items.withColumn("order", F.get(orders, place.cast("int")))

    @F.pandas_udf("array<int>")
    def order(heads: pd.Series, ids: pd.Series) -> pd.Series:
        seeds = np.frombuffer(b"".join(heads), dtype=">u8").astype(np.uint64)
        found, enough = shuffles(seeds, 3)
        out = pd.Series(list(found), index=ids.index, dtype=object)
        for i in np.flatnonzero(~enough).tolist():
            out.iloc[i] = seeded_order(ids.iloc[i])
        return out

    ship_package(items.sparkSession)
    text = F.coalesce(F.col(id_col), F.lit(""))
    head = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 16))
    return items.withColumn("order", F.when(F.col(id_col).isNotNull(), order(head, text)))


def to_samples(items: DataFrame, shuffled: bool = True) -> DataFrame:
    """Items with options (struct text, role) and order -> input, choices, roles, target letter, category_split."""
    order = F.col("order") if shuffled else F.array(*map(F.lit, range(3)))
    df = items.withColumn("choices", F.transform(order, lambda i: F.get("options", i)["text"])).withColumn("roles", F.transform(order, lambda i: F.get("options", i)["role"]))
    letter = F.get(F.array(*map(F.lit, LETTERS)), (F.array_position("roles", F.col("label_role")) - 1).cast("int"))
    return df.withColumns({"input": F.concat("context", F.lit("\n\n"), "question"), "target": letter, "category_split": F.concat_ws("/", "category", "split")})


def role_faults(items: DataFrame) -> DataFrame:
    """Items that do not have exactly one option of every role."""

    def times(role: str) -> Column:
        return F.size(F.filter("options", lambda o: o["role"].eqNullSafe(F.lit(role))))

    bad = F.lit(False)
    for role in ROLES:
        bad = bad | (times(role) != 1)
    return items.where(F.col("options").isNull() | bad)
