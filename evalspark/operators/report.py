"""Report tables: summary, anchors, reasoning pairs, rates, order of runs, CSV form, Markdown."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import ANCHORS, GROUP_METRICS, UNPARSED_FLAG
from ..functions.metrics import sign_is_decided
from ..functions.numbering import numbered


def report_order(group: Column) -> Column:
    return F.when(group == "anchor", 0).when(group == "modern", 1).when(group == "unknown", 2).otherwise(3)


def anchor_table(long: DataFrame, published: DataFrame, anchors: dict[str, str] = ANCHORS) -> DataFrame:
    """(config, style, split, name, value) against (ref_model, split, name, published): both styles as columns.

    port = ours in the published style - published; protocol = clean - published style; a missing style is NaN.
    """
    pairs = F.create_map(*[F.lit(x) for kv in anchors.items() for x in kv])
    own = long.withColumn("ref_model", F.try_element_at(pairs, F.element_at(F.split("config", "/"), -1))).where("ref_model is not null")
    nan = F.lit(float("nan"))
    pivot = own.groupBy("config", "ref_model", "split", "name").agg(*[F.coalesce(F.max(F.when(F.col("style") == s, F.col("value"))), nan).alias(f"ours_{s}") for s in ("paper", "clean")])
    out = pivot.join(F.broadcast(published), ["ref_model", "split", "name"])  # published tables are fixed, 36 rows
    return out.select("config", "ref_model", "split", "name", "published", "ours_paper", "ours_clean", (F.col("ours_paper") - F.col("published")).alias("port"), (F.col("ours_clean") - F.col("ours_paper")).alias("protocol"))


def reasoning_pairs(runs: DataFrame) -> DataFrame:
    """(config, reasoning, split, accuracy, bias_score, reasoning_tokens, samples): off and low of one base config joined."""
    base = F.regexp_replace("config", "-low$", "")
    side = lambda r: runs.where(F.col("reasoning") == r).select(base.alias("base"), "split", F.col("accuracy").alias(f"accuracy_{r}"), F.col("bias_score").alias(f"bias_{r}"), *([F.try_divide(F.col("reasoning_tokens").cast("double"), F.col("samples").cast("double")).alias("tokens_per_sample")] if r == "low" else []))
    both = side("off").join(side("low"), ["base", "split"])
    return both.withColumn("d_accuracy", F.col("accuracy_low") - F.col("accuracy_off")).withColumn("d_bias", F.col("bias_low") - F.col("bias_off"))


def unpaired(runs: DataFrame) -> DataFrame:
    """Base configs that lack one of the two reasoning variants, with the variants they have."""
    base = F.regexp_replace("config", "-low$", "").alias("base")
    return runs.groupBy(base).agg(F.array_join(F.sort_array(F.collect_set("reasoning")), "/").alias("have"), F.countDistinct("reasoning").alias("k")).where("k < 2").select("base", "have")


def overlap_flags(wide: DataFrame, line: str = "run_key", style: str = "clean") -> DataFrame:
    """Adjacent runs in order of bias score whose lower run's band is wider than the gap to the next.

    Where rows have a ``style``, runs of ``style`` are ranked among themselves, and others are left out: scores of two
    prompt styles have no common order. The rows are one a run and split; a split is ranked over ranges of its rows.
    """
    ranked = wide.where((F.col("grp") == "all") & ~F.isnan("bias_score"))
    if "style" in wide.columns:
        ranked = ranked.where(F.col("style") == style)
    ranked = numbered(ranked.select("split", line, "bias_score", "bias_score_lo", "bias_score_hi"), "split", ["bias_score", line], "_place")
    after = ranked.select(F.col("split").alias("_split"), (F.col("_place") - 1).alias("_before"), F.col(line).alias("next_run"), F.col("bias_score").alias("_next"))
    pairs = ranked.join(after, (F.col("split") == F.col("_split")) & (F.col("_place") == F.col("_before")))
    pairs = pairs.withColumns({"gap": F.col("_next") - F.col("bias_score"), "width": F.col("bias_score_hi") - F.col("bias_score_lo")})
    return pairs.select("split", line, "next_run", "gap", "width", F.coalesce(~F.isnan("width") & ~F.isnan("gap") & (F.col("width") > F.col("gap")), F.lit(False)).alias("undecided"))


def bias_by_category(wide: DataFrame) -> DataFrame:
    """One row a run and split with the bias score of each category as a column; a category that is missing is null."""
    by = wide.where("grp <> 'all'").groupBy("config", "style", "split").pivot("grp").agg(F.first("bias_score"))
    return by.orderBy("config", "style", "split")


def rate_flags(wide: DataFrame, limit: float = UNPARSED_FLAG) -> DataFrame:
    cols = ("unparsed_rate", "invalid_rate", "refusal_rate", "no_response_rate", "truncation_rate", "parse_strict_rate", "bias_score_lo", "bias_score_hi")
    return wide.where((F.col("grp") == "all") & (F.col("n") > 0)).select("run_key", "split", *cols, (~F.isnan("unparsed_rate") & (F.col("unparsed_rate") > limit)).alias("flagged"))


def mark_signs(long_se: DataFrame) -> DataFrame:
    """(.., ft_minus_fo, se, bias_score) -> ``cell``: value with three digits, error, and * where the sign is open."""
    v = F.format_string("%.3f", "bias_score")
    open_sign = (F.col("bias_score") != 0) & ~sign_is_decided(F.col("ft_minus_fo"), F.col("se"))
    return long_se.withColumn("cell", F.when(F.isnan("bias_score"), "—").otherwise(F.concat(v, F.when(F.isnan("se"), "").otherwise(F.concat(F.lit(" ± "), F.format_string("%.3f", "se"))), F.when(open_sign, " *").otherwise(""))))


def csv_table(wide: DataFrame, keys: list[str], names: tuple[str, ...] = GROUP_METRICS) -> DataFrame:
    """Text columns for the CSV sink: six decimals, blank for NaN."""
    cell = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "").otherwise(F.format_string("%.6f", c)).alias(c)
    return wide.select(*keys, *[cell(c) for c in names])


def run_labels(runs: DataFrame) -> DataFrame:
    """A label a run by the axis on which it has a sibling: reasoning if its base config has both settings, else the style."""
    base = F.regexp_replace("config", "-low$", "")
    both = F.size(F.collect_set("reasoning").over(Window.partitionBy(base))) > 1
    by_reasoning = F.concat(base, F.lit(" · reasoning "), "reasoning")
    by_style = F.concat(base, F.lit(" · "), F.when(F.col("style") == "paper", "paper prompt").otherwise("default prompt"))
    return runs.withColumn("label", F.when((F.col("reasoning") == "low") | both, by_reasoning).otherwise(by_style))


def check_unique(df: DataFrame, column: str = "label") -> DataFrame:
    """``df`` itself, or an error that names values of ``column`` which repeat."""
    again = [r[0] for r in df.groupBy(column).count().where("count > 1").orderBy(column).limit(5).collect()]
    if again:
        raise ValueError(f"{column} repeats: {again}")
    return df


def by_accuracy(runs: DataFrame) -> DataFrame:
    """Runs (config, split, accuracy, ..) by their accuracy on the ambiguous split, best first, then by config."""
    ambig = F.max(F.when(F.col("split") == "ambig", F.col("accuracy"))).over(Window.partitionBy("config", *(["style"] if "style" in runs.columns else [])))
    return runs.withColumn("_ambig", ambig).orderBy(F.desc_nulls_last("_ambig"), "config", "split").drop("_ambig")


def pairs_by_accuracy(pairs: DataFrame) -> DataFrame:
    """Reasoning pairs by the accuracy without reasoning, best first."""
    return pairs.orderBy(F.desc_nulls_last("accuracy_off"), "base", "split")


#: The columns of the results file, in order.
RESULT_COLUMNS = (
    "run", "config", "model", "prompt_style", "reasoning", "temperature", "tie_sign", "split", "category", "n", "n_correct", "n_target_error", "n_other_error", "n_unparsed", "n_other_outcome",
    "accuracy", "accuracy_ci_lo", "accuracy_ci_hi", "ft", "fo", "ft_minus_fo", "bias_score_signed", "bias_magnitude", "bias_magnitude_ci_lo", "bias_magnitude_ci_hi", "bias_signed_se_history",
    "sign_decided", "unparsed_rate", "interval_method",
)


def results_table(runs: DataFrame, wide: DataFrame, counts: DataFrame, intervals: DataFrame, ses: DataFrame, method: str) -> DataFrame:
    """The results file as text columns: one row a run, split and group. Blank cells stand for what is not known.

    runs: run_key, label, config, reasoning, style, temperature, tie_sign. counts: run_key, split, grp, correct, ft, fo,
    unparsed (null where aggregates do not identify them). intervals and ses: as the bootstrap gives them.
    """
    key = ["run_key", "split", "grp"]
    ci = intervals.groupBy(*key).agg(*[F.max(F.when(F.col("name") == n, F.col(e))).alias(f"{n}_{e}") for n in ("accuracy", "abs_bias_score") for e in ("lo", "hi")])
    se = ses.where("name = 'ft_minus_fo'").select(*key, "se")
    c = counts.select(*key, *[F.col(k).cast("long").alias(f"c_{k}") for k in ("correct", "ft", "fo", "unparsed")])
    df = wide.where("n > 0").join(runs, "run_key").join(c, key, "left").join(ci, key, "left").join(se, key, "left")
    known = F.col("c_ft").isNotNull() & F.col("c_fo").isNotNull()
    blank = lambda x: F.when(x.isNull() | F.isnan(x), "").otherwise(F.format_string("%.6f", x))
    whole = lambda x: F.when(known, F.coalesce(x.cast("string"), F.lit(""))).otherwise("")
    part = lambda x: F.when(known, blank(x)).otherwise("")
    n = F.col("n").cast("long")
    values = {
        "run": F.col("label"), "config": F.col("config"), "model": F.regexp_replace("config", "-low$", ""), "prompt_style": F.col("style"), "reasoning": F.col("reasoning"), "temperature": F.regexp_replace(F.col("temperature").cast("string"), r"\.0$", ""), "tie_sign": F.col("tie_sign").cast("string"),
        "split": F.col("split"), "category": F.col("grp"), "n": n.cast("string"), "n_correct": whole(F.col("c_correct")), "n_target_error": whole(F.col("c_ft")), "n_other_error": whole(F.col("c_fo")), "n_unparsed": whole(F.col("c_unparsed")),
        "n_other_outcome": whole(n - F.col("c_correct") - F.col("c_ft") - F.col("c_fo") - F.col("c_unparsed")), "accuracy": blank(F.col("accuracy")), "accuracy_ci_lo": part(F.col("accuracy_lo")), "accuracy_ci_hi": part(F.col("accuracy_hi")),
        "ft": part(F.col("c_ft") / F.col("n")), "fo": part(F.col("c_fo") / F.col("n")), "ft_minus_fo": blank(F.col("ft_minus_fo")), "bias_score_signed": blank(F.col("bias_score")), "bias_magnitude": blank(F.abs("bias_score")),
        "bias_magnitude_ci_lo": part(F.col("abs_bias_score_lo")), "bias_magnitude_ci_hi": part(F.col("abs_bias_score_hi")), "bias_signed_se_history": blank(F.col("se")),
        "sign_decided": F.when(F.coalesce(sign_is_decided(F.col("ft_minus_fo"), F.col("se")), F.lit(False)), "yes").otherwise("no"), "unparsed_rate": blank(F.col("unparsed_rate")),
        "interval_method": F.when(known, method).otherwise("none: the counts behind Ft and Fo are not known"),
    }
    return df.select(*[values[c].alias(c) for c in RESULT_COLUMNS])


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small result as one CSV file with a header under ``path``; blanks stay blank."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("lineSep", "\n").csv(path)


def markdown_table(df: DataFrame, digits: int = 3) -> str:
    """A small result as a Markdown table; numbers are formatted on the driver."""
    show = lambda x: "—" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.collect()])


def build_report(sections: list[tuple[str, DataFrame | str]]) -> str:
    body = lambda x: x if isinstance(x, str) else markdown_table(x)
    return "\n\n".join(f"## {k}. {title}\n\n{body(x)}" for k, (title, x) in enumerate(sections, 1)) + "\n"


def monitoring_report(runs: DataFrame, wide: DataFrame, ses: DataFrame, published: DataFrame, ledger: DataFrame, logs: str, notes: tuple[str, ...] = ()) -> str:
    """The report of a set of runs (run_key, config, group, reasoning, style, samples, reasoning_tokens) in seven sections."""
    from .history import ledger_sums, ledger_table

    named = wide.join(runs, "run_key")
    pooled = named.where("grp = 'all'")
    error = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("se"))), F.lit(float("nan")))
    se = ses.where("grp = 'all'").groupBy("run_key", "split").agg(error("bias_score").alias("se"), error("accuracy").alias("accuracy_se"))
    cells = mark_signs(pooled.join(se, ["run_key", "split"], "left").withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("se", "accuracy_se")}))
    cells = cells.withColumn("open", F.endswith("cell", F.lit("*")))
    summary = cells.orderBy(report_order(F.col("group")), "config", "style", "split").select("config", "style", "split", "n", "accuracy", "accuracy_se", F.col("cell").alias("bias"))
    unstable = [f"{r['config']} ({r['style']}, {r['split']})" for r in cells.where("open").orderBy("config", "style", "split").collect()]  # runs of a report
    overview = "\n\n".join([markdown_table(summary), "Bias by category:", markdown_table(bias_by_category(named)), "The data leave the sign open (*) for: " + (", ".join(unstable) or "none") + "."])
    long = pooled.unpivot(["run_key", "config", "style", "split"], ["accuracy", "ft_minus_fo", "bias_score"], "name", "value")
    anchors = anchor_table(long, published.where("grp = 'all'").select("ref_model", "split", "name", "published")).orderBy("config", "split", "name")
    pairs = pairs_by_accuracy(reasoning_pairs(pooled.where(F.col("group") == "modern")))
    rates = rate_flags(wide).join(runs.select("run_key", "config", "style"), "run_key").drop("run_key").orderBy("config", "style", "split")
    ranks = overlap_flags(named, "config").where("undecided").orderBy("split", "gap").select("split", "config", F.col("next_run").alias("next_config"), "gap", "width")
    order = "Neighbours whose order the data leave open (band wider than the gap, clean prompts):\n\n" + markdown_table(ranks)
    versions = [c for c in ("parser_version", "refusal_version", "task_version", "dataset_version") if c in runs.columns]
    design = runs.orderBy("config", "style").select("config", "group", "reasoning", "style", *versions)
    cost = markdown_table(ledger_sums(ledger), 6) + "\n\n" + markdown_table(ledger_table(ledger), 6)
    commands = f"```\npython -m evalspark.cli report SCORED OUT\npython -m evalspark.cli ledger LEDGER\n```\n\nLogs: `{logs}`"
    sections = [("Summary", overview), ("Anchors", anchors), ("Reasoning", pairs), ("Rates", markdown_table(rates) + "\n\n" + order), ("Cost", cost), ("Design", design), ("Commands", commands)]
    head = "# Monitoring report\n\n" + "".join(f"- {n}\n" for n in notes) + ("\n" if notes else "")
    return head + build_report(sections)
