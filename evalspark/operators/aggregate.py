"""Grouping sets over indicators, the completeness grid, metric tables in long and wide form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import ALL, CATEGORY_METRICS, COUNTED, GROUP_METRICS, HEADLINE_METRICS, VIEW_FIRST
from ..functions.metrics import group_metrics, null_if_not_finite, ratio
from ..functions.text import strip


def group_counts(scored: DataFrame) -> DataFrame:
    """Counts per (run_key, split, grp): all categories pooled as grp 'all', and each category; splits never mix.

    Partial sums run before the one shuffle, whose size depends on the number of groups alone.
    """
    sets = [[F.col("run_key"), F.col("split")], [F.col("run_key"), F.col("split"), F.col("category")]]
    g = scored.groupingSets(sets, F.col("run_key"), F.col("split"), F.col("category"))
    sums = [F.sum(k).alias(k) for k in COUNTED]
    out = g.agg(F.when(F.grouping("category") == 1, F.lit(ALL)).otherwise(F.col("category")).alias("grp"), F.count("*").cast("double").alias("n"), *sums)
    return out.select("run_key", "split", "grp", "n", *COUNTED)


def complete_grid(counts: DataFrame) -> DataFrame:
    """Every split a run has, times 'all' and every category the run has in any split; absent groups count 0.

    The few counts of a run are gathered and laid out again, so the input is read once and nothing is joined.
    """
    cell = F.struct(F.struct("split", "grp").alias("key"), F.struct("n", *COUNTED).alias("value"))
    runs = counts.groupBy("run_key").agg(F.collect_set("split").alias("splits"), F.collect_set("grp").alias("groups"), F.map_from_entries(F.collect_list(cell)).alias("cells"))
    full = runs.withColumn("split", F.explode("splits")).withColumn("grp", F.explode("groups"))
    got = full.withColumn("c", F.try_element_at("cells", F.struct("split", "grp")))
    return got.select("run_key", "split", "grp", *[F.coalesce(F.col("c")[k], F.lit(0.0)).alias(k) for k in ("n", *COUNTED)])


def wide_metrics(counts: DataFrame, tie_sign: int = 1) -> DataFrame:
    """One row a group with every metric; an empty group has n 0 and NaN elsewhere."""
    m = group_metrics(tie_sign)
    return counts.select("run_key", "split", "grp", *[v.alias(k) for k, v in m.items()])


def long_metrics(wide: DataFrame) -> DataFrame:
    """(run_key, split, grp, name, value): all metrics of 'all', the short list for a category."""
    long = wide.unpivot(["run_key", "split", "grp"], list(GROUP_METRICS), "name", "value")
    return long.where((F.col("grp") == ALL) | F.col("name").isin(*CATEGORY_METRICS))


def summarize(scored: DataFrame, tie_sign: int = 1) -> DataFrame:
    return long_metrics(wide_metrics(complete_grid(group_counts(scored)), tie_sign))


def headline(long: DataFrame) -> DataFrame:
    return long.where(F.col("name").isin(*HEADLINE_METRICS))


def view_order(long: DataFrame) -> DataFrame:
    """Adds ``place``: the three leading metrics of each split's 'all' come first, everything else follows in its own order."""
    first = F.array(*map(F.lit, VIEW_FIRST))
    names = F.array(*map(F.lit, GROUP_METRICS))
    lead = F.when((F.col("grp") == ALL) & F.col("name").isin(*VIEW_FIRST), F.array_position(first, F.col("name"))).otherwise(F.lit(99))
    from pyspark.sql import Window

    order = Window.partitionBy("run_key").orderBy(lead, "split", F.col("grp") != ALL, "grp", F.array_position(names, F.col("name")))
    return long.withColumn("place", F.row_number().over(order).cast("long"))


def analytic_se(wide: DataFrame) -> DataFrame:
    """Adds the closed-form standard error of ft - fo of a multinomial sample."""
    d = F.col("ft") - F.col("fo")
    return wide.withColumn("se", F.sqrt(F.greatest((F.col("ft") + F.col("fo") - d * d) / F.col("n"), F.lit(0.0))))


def to_maps(long: DataFrame, digits: int = 6) -> DataFrame:
    """One row a run with its metrics as a map for the JSON sink: NaN becomes null, values are rounded half even."""
    key = F.concat_ws("/", "split", "grp", "name")
    entry = F.struct(key.alias("key"), F.bround(null_if_not_finite(F.col("value")), digits).alias("value"))
    return long.groupBy("run_key").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("metrics"))


def manifest_counts(items: DataFrame, categories: list[str], splits: list[str]) -> DataFrame:
    """(kind, name, n): per category and per split with zeros, per category/split only where present."""
    spark = items.sparkSession
    full = lambda kind, names: spark.createDataFrame([(kind, x) for x in names], "kind string, name string")
    one = items.groupBy("category").count().select(F.lit("category").alias("kind"), F.col("category").alias("name"), "count")
    two = items.groupBy("split").count().select(F.lit("split").alias("kind"), F.col("split").alias("name"), "count")
    both = items.groupBy("category", "split").count().select(F.lit("category/split").alias("kind"), F.concat_ws("/", "category", "split").alias("name"), F.col("count").alias("n"))
    grid = full("category", categories).unionByName(full("split", splits)).join(one.unionByName(two), ["kind", "name"], "left")
    return grid.select("kind", "name", F.coalesce("count", F.lit(0)).alias("n")).unionByName(both)


def duplicates(items: DataFrame, id_col: str, content: list[str]) -> DataFrame:
    """One row: how many ids and how many contents repeat an earlier one."""
    # contents are grouped by a digest, so that whole texts do not move
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    items = items.select(F.col(id_col).alias("_id"), digest.alias("_content"))
    extra = lambda cols: items.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("x"))
    return extra(["_id"]).withColumnRenamed("x", "duplicate_ids").crossJoin(extra(["_content"]).withColumnRenamed("x", "duplicate_contents"))  # one row each


def unknown_balance(samples: DataFrame, low: float = 0.30, high: float = 0.37) -> DataFrame:
    """Share of each position of the unknown option, and whether it lies in the fair range."""
    at = samples.select((F.array_position("roles", "unknown") - 1).cast("int").alias("position"))
    counts = at.groupBy("position").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = counts.crossJoin(F.broadcast(total)).withColumn("share", ratio(F.col("n"), F.col("total")))  # three rows and one
    return share.select("position", "n", "share", F.col("share").between(low, high).alias("fair"))


def unpivot_sheet(sheet: DataFrame, ids: list[str], models: list[str], strict: bool = True) -> DataFrame:
    """Wide published answers -> (ids, model, answer, choice). 0, 1 and 2 are choices; null, NaN and "Rev" are no answer;
    anything else is an error that names it, or with ``strict`` off no answer either."""
    long = sheet.unpivot(ids, models, "model", "answer")
    number = F.col("answer").try_cast("double")
    choice = F.when(number.isin(0.0, 1.0, 2.0), number.cast("int"))
    if strict:
        none = F.col("answer").isNull() | F.isnan(number) | (strip(F.col("answer")) == "Rev")
        choice = F.when(number.isin(0.0, 1.0, 2.0), number.cast("int")).when(~F.coalesce(none, F.lit(False)), F.raise_error(F.concat(F.lit("not an answer: "), F.col("answer"))).cast("int"))
    return long.withColumn("choice", choice)


def sheet_outcomes(long: DataFrame) -> DataFrame:
    """Choices of a sheet (with roles) as outcomes that ``score_indicators`` takes; no choice is an invalid answer."""
    answered = F.col("choice").isNotNull()
    return long.withColumns({
        "run_key": F.col("model"), "chosen_role": F.get("roles", F.col("choice")), "outcome": F.when(answered, "answered").otherwise("invalid_response_format"),
        "parse_stage": F.when(answered, "strict").otherwise("none"), "truncated": F.lit(False),
    })


def sheet_sanity(sheet: DataFrame, wanted: dict[str, list], required: list[str], rows: int | None = None, rules: dict[str, str] | None = None, equal: dict[str, list] | None = None, counts: tuple[str, ...] = (), answers: dict[str, str] | None = None, unparsed: tuple[str, ...] = ()) -> DataFrame:
    """(check, ok, detail) of a wide sheet in one pass: required columns, number of rows, values within their sets, and
    predicates that hold on every row (``rules``: name -> SQL).

    ``equal``: columns whose values are exactly these; the detail says what is missing or too much. ``counts``: columns
    whose rows by value are the detail of a check that always holds. ``answers`` (name -> column): every cell is null, one
    of ``unparsed`` or a place 0, 1, 2, also written 1.0; the detail has the unparsed cells of each name, or the first bad one.
    """
    lacking = [c for c in required if c not in sheet.columns]
    checks = [F.struct(F.lit("columns").alias("check"), F.lit(not lacking).alias("ok"), F.lit(", ".join(lacking)).alias("detail"))]
    own = lambda xs: {c: v for c, v in xs.items() if c in sheet.columns}
    present, exact, cells = own(wanted), own(equal or {}), {n: c for n, c in (answers or {}).items() if c in sheet.columns}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    listed = lambda x: F.array_join(F.sort_array(x), ", ")
    outside = {c: listed(F.collect_set(F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), text(c)))) for c, v in present.items()}
    aggs = {"rows": F.count("*"), **{f"set:{c}": x for c, x in outside.items()}, **{f"rule:{n}": F.count_if(~F.coalesce(F.expr(e), F.lit(False))) for n, e in (rules or {}).items()}}
    aggs |= {f"equal:{c}": F.collect_set(text(c)) for c in exact}
    # rows by value are counted apart and come in as one row of maps, so that no cell of a large sheet is listed
    shown = [c for c in counts if c in sheet.columns]
    aggs |= {f"unparsed:{n}": F.count_if(F.col(c).isNull() | F.col(c).cast("string").isin("NaN", *unparsed)) for n, c in cells.items()}
    good = lambda c: F.col(c).isNull() | F.col(c).cast("string").isin("NaN", *unparsed) | F.coalesce(F.trim(F.col(c).cast("string")).rlike(r"\A[012](\.0+)?\z"), F.lit(False))
    aggs |= {f"bad:{n}": F.min(F.when(~good(c), F.col(c).cast("string"))) for n, c in cells.items()}
    one = sheet.agg(*[v.alias(k) for k, v in aggs.items()])
    for c in shown:
        by = sheet.groupBy(text(c).alias("_value")).count().agg(F.array_join(F.sort_array(F.collect_list(F.concat("_value", F.lit(": "), "count"))), ", ").alias(f"counts:{c}"))
        one = one.crossJoin(by)  # one row each
    if rows is not None:
        checks.append(F.struct(F.lit("rows").alias("check"), (F.col("rows") == rows).alias("ok"), F.col("rows").cast("string").alias("detail")))
    checks += [F.struct(F.lit(f"values of {c}").alias("check"), (F.col(f"`set:{c}`") == "").alias("ok"), F.col(f"`set:{c}`").alias("detail")) for c in present]
    checks += [F.struct(F.lit(n).alias("check"), (F.col(f"`rule:{n}`") == 0).alias("ok"), F.col(f"`rule:{n}`").cast("string").alias("detail")) for n in rules or {}]
    for c, v in exact.items():
        full = F.array(*[F.lit(str(x)) for x in v])
        less, more = listed(F.array_except(full, f"equal:{c}")), listed(F.array_except(F.col(f"`equal:{c}`"), full))
        checks.append(F.struct(F.lit(f"exactly {c}").alias("check"), ((less == "") & (more == "")).alias("ok"), F.concat(F.lit("missing: "), less, F.lit("; too much: "), more).alias("detail")))
    checks += [F.struct(F.lit(f"rows by {c}").alias("check"), F.lit(True).alias("ok"), F.coalesce(F.col(f"`counts:{c}`"), F.lit("")).alias("detail")) for c in shown]
    for n in cells:
        bad = F.col(f"`bad:{n}`")
        checks.append(F.struct(F.lit(f"answers of {n}").alias("check"), bad.isNull().alias("ok"), F.coalesce(F.concat(F.lit("no answer: "), bad), F.concat(F.lit("unparsed: "), F.col(f"`unparsed:{n}`").cast("string"))).alias("detail")))
    return one.select(F.inline(F.array(*checks)))


def counts_from_rates(wide: DataFrame, slack: float = 0.02) -> DataFrame:
    """Whole counts from stored rates, with a flag where a rate is not a count over n; ft and fo only where identified.

    In an ambiguous group the wrong answers split into ft and fo, so sum and difference must have equal parity.
    """
    n = F.col("n")
    whole = lambda x: F.bround(x).cast("long")
    c, u, d = whole(F.col("accuracy") * n), whole(F.col("unparsed_rate") * n), whole(F.col("ft_minus_fo") * n)
    off = F.greatest(F.abs(F.col("accuracy") * n - c), F.abs(F.col("unparsed_rate") * n - u), F.abs(F.col("ft_minus_fo") * n - d))
    rest = whole(n) - c - u
    known = F.col("split") == "ambig"
    odd = known & (F.pmod(rest + d, F.lit(2)) != 0)
    ft = F.when(known & ~odd, ((rest + d) / 2).cast("long"))
    fo = F.when(known & ~odd, ((rest - d) / 2).cast("long"))
    return wide.select("run_key", "split", "grp", c.alias("correct"), u.alias("unparsed"), ft.alias("ft"), fo.alias("fo"), ((off > slack) | odd).alias("fault"))
