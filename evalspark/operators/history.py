"""Run history and cost ledger: idempotent append, latest records, two-tier matches, running sums, budget plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import BUDGET_CAP, CREDITS_RESERVE, DEFAULT_OUTPUT_TOKENS
from ..functions.metrics import spend
from ..functions.numbering import numbered, prefix_sums


def new_records(existing: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of ``batch`` to append: unknown keys only, and of several with one key the first by ``order``."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def append_counts(existing: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row: how many rows an append would add and skip."""
    added = new_records(existing, batch, key, order).agg(F.count("*").alias("added"))
    total = batch.agg(F.count("*").alias("total"))
    return added.crossJoin(total).select("added", (F.col("total") - F.col("added")).alias("skipped"))  # one row each


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in ``new``."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def latest_records(history: DataFrame, key: list[str], created: str = "created", line: str = "line_no") -> DataFrame:
    """The newest row of every key (ties: the later line) with ``place``, the first line at which its key appears."""
    best = F.max_by(F.struct(*[F.col(c) for c in history.columns if c not in key]), F.struct(created, line)).alias("r")
    out = history.groupBy(*key).agg(best, F.min(line).alias("place"))
    return out.select(*key, "r.*", "place")


def ledger_totals(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, spend, interrupted spend, whether a line ended ok, and credits per token cost."""
    s = spend(F.col("cost_tokens"), F.col("cost_credits"))
    tokens = F.sum(F.when(F.col("cost_credits").isNotNull(), F.col("cost_tokens")))
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("lines"), F.sum(s).alias("spent"), F.coalesce(F.sum(F.when(F.col("status") == "interrupted", s)), F.lit(0.0)).alias("prepaid"),
        F.bool_or(F.col("status") == "ok").alias("done"), F.try_divide(F.sum("cost_credits"), tokens).alias("credits_per_token_cost"),
    )


def match_ledger(logs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cost of each log: the newest line with its log_file, else the newest ok line of its config and style."""
    pick = lambda where: F.max_by(F.struct("cost_tokens", "cost_credits", "line_no"), "line_no")
    by_file = ledger.where(F.col("log_file") != "").groupBy("log_file").agg(pick(None).alias("by_file"))
    by_unit = ledger.where(F.col("status") == "ok").groupBy("config", "style").agg(pick(None).alias("by_unit"))
    out = logs.join(by_file, "log_file", "left").join(by_unit, ["config", "style"], "left")
    hit = F.when(F.col("by_file").isNotNull(), F.col("by_file")).otherwise(F.col("by_unit"))
    tier = F.when(F.col("by_file").isNotNull(), "log_file").when(F.col("by_unit").isNotNull(), "config/style").otherwise("none")
    return out.select(*[F.col(c) for c in logs.columns], tier.alias("matched_by"), hit["line_no"].alias("line_no"), hit["cost_tokens"].alias("cost_tokens"), hit["cost_credits"].alias("cost_credits"))


def measured_tokens(units: DataFrame, ledger: DataFrame) -> DataFrame:
    """Output tokens a sample of each (config, style): newest sound ok line of the same style, else of any style."""
    sound = ledger.where((F.col("status") == "ok") & (F.col("samples") > 0) & (F.col("output_tokens") > 0))
    mean = F.max_by(F.col("output_tokens") / F.col("samples"), "line_no")
    same = sound.groupBy("config", "style").agg(mean.alias("same"))
    any_style = sound.groupBy("config").agg(mean.alias("any"))
    return units.join(same, ["config", "style"], "left").join(any_style, "config", "left").select(*[F.col(c) for c in units.columns], F.coalesce("same", "any").alias("tokens_per_sample"))


def estimate_units(units: DataFrame, prices: DataFrame) -> DataFrame:
    """Units (config, style, reasoning, price_model, samples, input_tokens, tokens_per_sample) with a price -> usd."""
    default = F.when(F.col("reasoning") == "low", float(DEFAULT_OUTPUT_TOKENS["low"])).otherwise(float(DEFAULT_OUTPUT_TOKENS["off"]))
    out = F.bround(F.coalesce("tokens_per_sample", default) * F.col("samples")).cast("long")
    priced = units.join(F.broadcast(prices) if _small(prices) else prices, "price_model").withColumn("est_output_tokens", out)
    return priced.withColumn("usd", F.col("input_tokens") * F.col("price_in") + F.col("est_output_tokens") * F.col("price_out"))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a price list is short enough to broadcast; longer ones join by a shuffle."""
    return df.limit(rows + 1).count() <= rows


def unpriced(units: DataFrame, prices: DataFrame) -> DataFrame:
    return units.join(prices, "price_model", "left_anti")


def running_cost(estimates: DataFrame, usd: str = "usd", key: str = "key") -> DataFrame:
    """Cheapest first with the running sum of the estimates and the place, both over ranges of the rows."""
    before = prefix_sums(estimates, [], [usd, key], {"cum_usd": F.coalesce(F.col(usd), F.lit(0.0)), "place": F.lit(1).cast("long")})
    return before.withColumns({"cum_usd": F.col("cum_usd") + F.coalesce(F.col(usd), F.lit(0.0)), "place": F.col("place") + 1})


def _until_stop(units: DataFrame, stops: Column) -> DataFrame:
    """``units`` with ``runs``: false from the first unit in order of ``place`` on for which ``stops`` holds."""
    marked = prefix_sums(units, [], ["place"], {"runs": stops.cast("long")})
    return marked.withColumn("runs", (F.col("runs") == 0) & ~stops)


def budget_plan(estimates: DataFrame, done: DataFrame, limit: float, usd: str = "usd", key: str = "key") -> DataFrame:
    """Units not done, cheapest first, with ``runs``: false from the first unit whose running sum passes ``limit``."""
    return _until_stop(running_cost(estimates.join(done, key, "left_anti"), usd, key), F.col("cum_usd") > F.lit(float(limit)))


def resolve_budget(explicit: float | None, spent: float, remaining: float) -> float:
    """The limit of a run: as given, or what is spent and left less a reserve, under the cap."""
    return explicit if explicit is not None else min(BUDGET_CAP, spent + remaining - CREDITS_RESERVE)


def net_cost(gross: Column, prepaid: Column) -> Column:
    return F.greatest(gross - prepaid, F.lit(0.0))


def settle_threshold(gross: Column) -> Column:
    """Least credit movement that counts as settled; from the gross cost, whatever was prepaid."""
    return F.greatest(gross * F.lit(0.25), F.lit(1e-6))


def interrupted_cost(now: Column, before: Column) -> Column:
    return F.bround(F.greatest(now - before, F.lit(0.0)), 8)


def next_line_numbers(existing: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """``batch`` with line_no that goes on after ``existing``; order is semantic, so it is fixed when written."""
    last = existing.agg(F.coalesce(F.max("line_no"), F.lit(0))).first()[0]
    return numbered(batch, [], order, "line_no").withColumn("line_no", F.col("line_no") + F.lit(last))


def latest_ok(ledger: DataFrame, panel: DataFrame, stage: str = "smoke") -> DataFrame:
    """Every panel config with the verdict on its newest ok line of ``stage``: off means no reasoning tokens, low some."""
    last = ledger.where((F.col("stage") == stage) & (F.col("status") == "ok")).groupBy("config").agg(F.max_by("reasoning_tokens", "line_no").alias("reasoning_tokens"), F.max("line_no").alias("line_no"))
    t = F.coalesce("reasoning_tokens", F.lit(0))
    verdict = F.when(F.col("line_no").isNull(), "SKIP").when((F.col("reasoning") == "off") == (t == 0), "OK").otherwise("FAIL")
    return panel.join(last, "config", "left").withColumn("verdict", verdict)


def label_logs(logs: DataFrame, panel: DataFrame) -> DataFrame:
    """Logs with ``group`` and ``reasoning`` of their config in the panel (config, group, reasoning); 'unknown' without an entry.

    Names of a panel are unique; should one repeat, its least entry counts, so that no log multiplies.
    """
    one = panel.groupBy("config").agg(F.min(F.struct("group", "reasoning")).alias("p"))
    out = logs.join(F.broadcast(one) if _small(one) else one, "config", "left")
    return out.select(*[F.col(f"`{c}`") for c in logs.columns], F.coalesce("p.group", F.lit("unknown")).alias("group"), F.coalesce("p.reasoning", F.lit("unknown")).alias("reasoning"))


def full_stage_runs(history: DataFrame) -> DataFrame:
    """The full-stage records in order of config and style; a history without one is an error."""
    runs = history.where(F.col("stage") == "full")
    if runs.isEmpty():
        raise ValueError("the history has no record of stage 'full'")
    return runs.orderBy("config", "style")


def budget_gate(units: DataFrame, spent: float, limit: float) -> DataFrame:
    """Replay of a run over units (key, place, usd, actual, done): ``runs`` is false for done units and from the first unit
    on whose estimate passes the limit on top of what was really spent before."""
    todo = prefix_sums(units.where(~F.col("done")), [], ["place"], {"spent_before": F.coalesce(F.col("actual"), F.lit(0.0))})
    todo = todo.withColumn("spent_before", F.col("spent_before") + F.lit(float(spent)))
    todo = _until_stop(todo, F.col("spent_before") + F.col("usd") > F.lit(float(limit)))
    skipped = units.where("done").withColumns({"spent_before": F.lit(None).cast("double"), "runs": F.lit(False)})
    return todo.unionByName(skipped)


def run_units(units: list[dict], done: set[str], spent: float, limit: float, run: Callable[[dict], dict]) -> tuple[list[dict], str | None]:
    """Run the units (key, usd) that are not done, in order, each through ``run``, which returns its ledger line.

    The real spend of every line is carried forward. Returns the lines and the key before which the budget stopped it.
    """
    lines: list[dict] = []
    for unit in units:
        if unit["key"] in done:
            continue
        if spent + unit["usd"] > limit:
            return lines, unit["key"]
        line = run(unit)
        spent += max(line.get("cost_tokens") or 0.0, line.get("cost_credits") or 0.0)
        lines.append(line)
    return lines, None


def ledger_table(ledger: DataFrame) -> DataFrame:
    """The ledger as it is printed: when, unit, status, samples, costs by tokens and by credits, and what is billed."""
    unit = F.coalesce(F.col("key"), F.concat_ws("/", "stage", F.concat_ws("__", "config", "style")))
    costs = [F.coalesce("cost_tokens", F.lit(0.0)).alias("tokens_usd"), F.col("cost_credits").alias("credits_usd"), spend(F.col("cost_tokens"), F.col("cost_credits")).alias("billed_usd")]
    return ledger.orderBy("line_no").select(F.col("created").alias("timestamp"), unit.alias("unit"), "status", F.coalesce("samples", F.lit(0)).alias("samples"), *costs)


def ledger_sums(ledger: DataFrame) -> DataFrame:
    """One row: lines, billed, token and credit costs, and their ratio (null without token costs)."""
    tokens, credits = F.coalesce(F.sum("cost_tokens"), F.lit(0.0)), F.coalesce(F.sum("cost_credits"), F.lit(0.0))
    billed = F.coalesce(F.sum(spend(F.col("cost_tokens"), F.col("cost_credits"))), F.lit(0.0))
    return ledger.agg(F.count("*").alias("lines"), billed.alias("billed_usd"), tokens.alias("tokens_usd"), credits.alias("credits_usd"), F.try_divide(credits, tokens).alias("credits_per_token_cost"))
