"""Every registered query of the evaluation engine with its DuckDB twin: name -> (function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import ANCHORS, HEADLINE_METRICS, INDICATORS, PUBLISHED_POOLED
from ..functions import metrics as M
from ..functions.answers import is_refusal
from ..functions.numbering import numbered
from ..functions.text import strip_reasoning
from ..operators import aggregate as A
from ..operators import bootstrap as B
from ..operators import history as H
from ..operators import report as R
from ..operators import sampling as S
from ..operators import scoring as P
from ..operators import verify as V
from ..runtime import ship_package
from ..sources import reference as ref
from . import adapters as T
from . import parse_sql as Q
from .sql import NAN, counts_sql, grid_sql, long_sql, metrics_sql, wide_sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        REGISTRY[f.__name__] = (run, sql)
        return f

    return add


def _wide(spark: SparkSession, sf: str, tie_sign: int = 1, geo: bool = False) -> DataFrame:
    return A.wide_metrics(A.complete_grid(A.group_counts(T.scored(spark, sf, geo))), tie_sign)


_GROUP = "run_key, split, grp"
_IND = ", ".join(INDICATORS)

# --- scoring and aggregation ---------------------------------------------------------------------------------------


@query(f"WITH {T.scored_sql()} SELECT id, category, split, outcome, chosen_role, {_IND} FROM scored")
def score_indicators(spark, sf):
    return T.scored(spark, sf).select("id", "category", "split", "outcome", "chosen_role", *INDICATORS)


@query(f"WITH {T.scored_sql()}, {counts_sql()} SELECT * FROM counts")
def group_metrics(spark, sf):
    return A.group_counts(T.scored(spark, sf))


@query(f"WITH {metrics_sql()} SELECT * FROM long")
def summarize_long(spark, sf):
    return A.long_metrics(_wide(spark, sf))


@query(f"WITH {metrics_sql()} SELECT * FROM wide")
def summarize_wide(spark, sf):
    return _wide(spark, sf)


@query(f"WITH {metrics_sql(tie_sign=0, geo=True)} SELECT * FROM wide")
def summarize_geo(spark, sf):
    return _wide(spark, sf, tie_sign=0, geo=True)


@query(f"WITH {metrics_sql()} SELECT {_GROUP}, bias_score_lo, bias_score, bias_score_hi, bias_score_hi - bias_score_lo AS width, (bias_score_lo <= bias_score AND bias_score <= bias_score_hi) AS ordered FROM wide")
def bounds(spark, sf):
    w = _wide(spark, sf)
    return w.select("run_key", "split", "grp", "bias_score_lo", "bias_score", "bias_score_hi", (F.col("bias_score_hi") - F.col("bias_score_lo")).alias("width"), ((F.col("bias_score_lo") <= F.col("bias_score")) & (F.col("bias_score") <= F.col("bias_score_hi"))).alias("ordered"))


@query(f"WITH {metrics_sql(tie_sign=-1)} SELECT {_GROUP}, valid_accuracy, valid_ft_minus_fo, valid_bias_score, coverage FROM wide")
def valid_only(spark, sf):
    return _wide(spark, sf, tie_sign=-1).select("run_key", "split", "grp", "valid_accuracy", "valid_ft_minus_fo", "valid_bias_score", "coverage")


_GAPS = "gaps AS (SELECT * FROM scored WHERE NOT (split = 'disambig' AND category = '1-URGENT') AND NOT (category = '2-HIGH' AND split = 'ambig' AND outcome = 'answered'))"


@query(f"WITH {T.scored_sql()}, {_GAPS}, {counts_sql('gaps')}, {grid_sql()}, {wide_sql('grid')} SELECT * FROM wide")
def completeness_grid(spark, sf):
    s = T.scored(spark, sf)
    s = s.where("NOT (split = 'disambig' AND category = '1-URGENT') AND NOT (category = '2-HIGH' AND split = 'ambig' AND outcome = 'answered')")
    return A.wide_metrics(A.complete_grid(A.group_counts(s)))


@query(f"WITH {metrics_sql()} SELECT * FROM long WHERE name IN ('accuracy', 'ft_minus_fo', 'bias_score')")
def headline(spark, sf):
    return A.headline(A.long_metrics(_wide(spark, sf)))


_PLACE = "CASE WHEN grp = 'all' AND name IN ('bias_score', 'accuracy', 'unparsed_rate') THEN list_position(['bias_score', 'accuracy', 'unparsed_rate'], name) ELSE 99 END"
_NAMES = "['n', 'accuracy', 'ft', 'fo', 'ft_minus_fo', 'bias_score', 'bias_score_lo', 'bias_score_hi', 'unparsed_rate', 'invalid_rate', 'refusal_rate', 'no_response_rate', 'truncation_rate', 'parse_strict_rate', 'parse_lenient_rate', 'valid_accuracy', 'valid_ft_minus_fo', 'valid_bias_score', 'coverage']"


@query(f"WITH {metrics_sql()} SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY {_PLACE}, split, grp <> 'all', grp, list_position({_NAMES}, name)) AS place FROM long")
def view_order(spark, sf):
    return A.view_order(A.long_metrics(_wide(spark, sf)))


@query(f"WITH {metrics_sql()} SELECT run_key, concat_ws('/', split, grp, name) AS key, split, grp, name, CASE WHEN isnan(value) THEN NULL ELSE round_even(value, 6) END AS value FROM long")
def metric_keys(spark, sf):
    long = A.long_metrics(_wide(spark, sf)).withColumn("key", M.metric_key(F.col("split"), F.col("grp"), F.col("name")))
    back = M.split_metric_key(F.col("key"))
    return long.select("run_key", "key", back["split"].alias("split"), back["grp"].alias("grp"), back["name"].alias("name"), F.bround(M.null_if_not_finite(F.col("value")), 6).alias("value"))


_SE = "sqrt(greatest((ft + fo - (ft - fo) * (ft - fo)) / n, 0.0::DOUBLE))"


@query(f"WITH {metrics_sql()} SELECT {_GROUP}, ft_minus_fo, {_SE} AS se, coalesce(ft_minus_fo <> 0 AND abs(ft_minus_fo) > 1.96::DOUBLE * {_SE}, false) AS decided FROM wide")
def sign_decided(spark, sf):
    w = A.analytic_se(_wide(spark, sf))
    return w.select("run_key", "split", "grp", "ft_minus_fo", "se", M.sign_is_decided(F.col("ft_minus_fo"), F.col("se")).alias("decided"))


@query(f"WITH {metrics_sql()}, w AS (SELECT * FROM wide WHERE grp = 'all'), r AS (SELECT *, lead(run_key) OVER x AS next_run, lead(bias_score) OVER x - bias_score AS gap, bias_score_hi - bias_score_lo AS width FROM w WINDOW x AS (PARTITION BY split ORDER BY bias_score, run_key)) SELECT split, run_key, next_run, gap, width, width > gap AS undecided FROM r WHERE next_run IS NOT NULL")
def overlap_flags(spark, sf):
    return R.overlap_flags(_wide(spark, sf))


@query(f"WITH {metrics_sql()}, w AS (SELECT * FROM wide WHERE grp = 'all' AND run_key % 2 = 0), r AS (SELECT *, lead(run_key) OVER x AS next_run, lead(bias_score) OVER x - bias_score AS gap, bias_score_hi - bias_score_lo AS width FROM w WINDOW x AS (PARTITION BY split ORDER BY bias_score, run_key)) SELECT split, run_key, next_run, gap, width, width > gap AS undecided FROM r WHERE next_run IS NOT NULL")
def overlap_by_style(spark, sf):
    """Runs of two prompt styles; only the clean ones are ranked."""
    style = F.when(F.col("run_key") % 2 == 0, "clean").otherwise("paper")
    return R.overlap_flags(_wide(spark, sf).withColumn("style", style))


@query(f"WITH {metrics_sql()} SELECT run_key, split, unparsed_rate, invalid_rate, refusal_rate, no_response_rate, truncation_rate, parse_strict_rate, bias_score_lo, bias_score_hi, unparsed_rate > 0.02::DOUBLE AS flagged FROM wide WHERE grp = 'all'")
def rates_flags(spark, sf):
    return R.rate_flags(_wide(spark, sf))


_ORACLE = "CASE WHEN label_role = 'unknown' THEN CASE polarity WHEN 'neg' THEN 'target' ELSE 'other' END WHEN label_role = 'target' THEN 'other' ELSE 'target' END"


def _oracle_sql(role: str) -> str:
    first = T.scored_sql().split(", scored AS")[0]
    rows = f"answers AS (SELECT run_key, id, category, split, polarity, label_role, 'answered' AS outcome, 'strict' AS parse_stage, false AS was_truncated, {role} AS chosen_role FROM raw)"
    return f"WITH {first}, {rows}, scored AS ({T.indicators_sql('answers')}), {counts_sql()}, {wide_sql()} SELECT * FROM wide"


def _oracle(spark, sf, wrong):
    rows = T.outcomes(spark, sf).withColumns({"chosen_role": P.oracle_role(F.col("label_role"), F.col("polarity"), wrong), "outcome": F.lit("answered"), "parse_stage": F.lit("strict"), "truncated": F.lit(False)})
    return A.wide_metrics(A.group_counts(P.score_indicators(rows)))


@query(_oracle_sql("label_role"))
def oracle_right(spark, sf):
    return _oracle(spark, sf, False)


@query(_oracle_sql(_ORACLE))
def oracle_wrong(spark, sf):
    return _oracle(spark, sf, True)


@query(f"WITH {metrics_sql()}, x AS (SELECT {_GROUP}, n, round_even(accuracy * n, 0)::BIGINT AS correct, round_even(unparsed_rate * n, 0)::BIGINT AS unparsed, round_even(ft_minus_fo * n, 0)::BIGINT AS d, round_even(n, 0)::BIGINT AS total, greatest(abs(accuracy * n - round_even(accuracy * n, 0)), abs(unparsed_rate * n - round_even(unparsed_rate * n, 0)), abs(ft_minus_fo * n - round_even(ft_minus_fo * n, 0))) AS off FROM wide), y AS (SELECT *, total - correct - unparsed AS rest, split = 'ambig' AS known FROM x) SELECT {_GROUP}, correct, unparsed, CASE WHEN known AND (rest + d) % 2 = 0 THEN (rest + d) // 2 END AS ft, CASE WHEN known AND (rest + d) % 2 = 0 THEN (rest - d) // 2 END AS fo, (off > 0.02 OR (known AND (rest + d) % 2 <> 0)) AS fault FROM y")
def counts_from_rates(spark, sf):
    return A.counts_from_rates(_wide(spark, sf))


@query(None)
def bootstrap_se(spark, sf):
    return B.bootstrap_ses(T.scored(spark, sf))


@query(None)
def bootstrap_ci(spark, sf):
    return B.bootstrap_intervals(T.scored(spark, sf))


# --- sampling and items --------------------------------------------------------------------------------------------

_TOPK = "pos AS (SELECT *, row_number() OVER (PARTITION BY category, split, polarity ORDER BY sha256(id), id) AS pos FROM items), dealt AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos, split, polarity) AS rk FROM pos)"


@query(f"WITH {T.ITEMS_SQL}, {_TOPK} SELECT id, category, split, polarity FROM dealt WHERE rk <= 50")
def stratified_topk(spark, sf):
    return S.stratified_top_k(T.items(spark, sf), 50).select("id", "category", "split", "polarity")


@query(f"WITH {T.ITEMS_SQL} SELECT (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) c FROM items GROUP BY id)) AS duplicate_ids, (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) c FROM items GROUP BY category, context)) AS duplicate_contents")
def duplicates(spark, sf):
    return A.duplicates(T.items(spark, sf), "id", ["category", "context"])


@query(f"WITH {T.ITEMS_SQL} SELECT 'category' AS kind, v AS name, (SELECT count(*) FROM items WHERE category = v) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('pt')) t(v) UNION ALL SELECT 'split', v, (SELECT count(*) FROM items WHERE split = v) FROM (VALUES ('ambig'), ('disambig')) t(v) UNION ALL SELECT 'category/split', category || '/' || split, count(*) FROM items GROUP BY category, split")
def manifest_counts(spark, sf):
    return A.manifest_counts(T.items(spark, sf), ["en", "fr", "de", "es", "pt"], ["ambig", "disambig"])


@query(f"WITH {T.ITEMS_SQL} SELECT format('{{}}-es-{{:04d}}', category, row_number() OVER (PARTITION BY category ORDER BY doc_id)) AS item_id, doc_id FROM items")
def item_ids(spark, sf):
    return numbered(T.items(spark, sf), "category", "doc_id").select(F.format_string("%s-es-%04d", "category", "position").alias("item_id"), "doc_id")


@query(f"WITH {T.ITEMS_SQL} SELECT id, context || chr(10) || chr(10) || question AS input, category || '/' || split AS category_split, CASE label_role WHEN 'target' THEN 'A' WHEN 'other' THEN 'B' ELSE 'C' END AS target FROM items")
def sample_projection(spark, sf):
    return S.to_samples(T.items(spark, sf), shuffled=False).select("id", "input", "category_split", "target")


@query(None)
def permutation(spark, sf):
    s = S.to_samples(S.permute_options(T.items(spark, sf)))
    return s.select("id", "order", "roles", "target")


@query(None)
def shuffle_balance(spark, sf):
    return A.unknown_balance(S.to_samples(S.permute_options(T.items(spark, sf))))


@query("SELECT conv_id, turn, ceil(length(text) / 4.0::DOUBLE)::BIGINT AS tokens FROM conversations")
def token_counts(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", P.count_tokens(F.col("text")).alias("tokens"))


# --- prompts -------------------------------------------------------------------------------------------------------


def _conv(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("context"), F.col("role").alias("question"), F.array(*map(F.lit, ("{question}", "b", "__option0__"))).alias("choices"))


@query("SELECT conv_id, turn, " + Q.prompt_sql(P.CLEAN_ES) + " AS prompt FROM conversations")
def prompt_clean(spark, sf):
    return P.build_prompt(_conv(spark, sf), "clean", "es").select("conv_id", "turn", "prompt")


@query("SELECT conv_id, turn, " + Q.prompt_sql(P.CLEAN_EN) + " AS prompt FROM conversations")
def prompt_clean_en(spark, sf):
    return P.build_prompt(_conv(spark, sf), "clean", "en").select("conv_id", "turn", "prompt")


@query("SELECT conv_id, turn, " + Q.prompt_sql(P.PAPER_USER) + " AS prompt, " + T._sql(P.PAPER_SYSTEM) + " AS system FROM conversations")
def prompt_paper(spark, sf):
    return P.build_prompt(_conv(spark, sf), "paper").select("conv_id", "turn", "prompt", "system")


@query("WITH p AS (SELECT role, " + Q.prompt_sql(P.CLEAN_ES) + " AS prompt FROM conversations) SELECT role AS question, count(*) AS samples, (sum(ceil(length(prompt) / 4.0::DOUBLE)::BIGINT) + 8 * count(*))::BIGINT AS input_tokens FROM p GROUP BY role")
def input_tokens(spark, sf):
    return P.input_tokens(P.build_prompt(_conv(spark, sf)), ["question"], 1)


# --- answers -------------------------------------------------------------------------------------------------------

_META = ("id", "outcome", "chosen_role", "parse_stage", "parse_detail", "answer", "unscored_reason")


@query(f"WITH {T.completions_sql()}, {Q.clean_sql()} SELECT id, idx AS index, stage, detail FROM parsed")
def parse_clean(spark, sf):
    from ..functions.answers import read_clean

    return read_clean(T.completions(spark, sf)).select("id", "parse.index", "parse.stage", "parse.detail")


@query(f"WITH {T.completions_sql()}, {Q.paper_sql()} SELECT id, idx AS index, stage, detail FROM parsed")
def parse_paper(spark, sf):
    from ..functions.answers import read_paper

    return read_paper(T.completions(spark, sf)).select("id", "parse.index", "parse.stage", "parse.detail")


@query(f"WITH {T.completions_sql()}, {Q.stripped_sql()} SELECT id, {Q.refusal('stripped')} AS refused FROM stripped")
def refusal(spark, sf):
    df = T.completions(spark, sf).select("id", strip_reasoning(F.col("completion")).alias("t")).withColumn("low", F.lower("t"))
    return df.select("id", is_refusal(F.col("t"), F.col("low")).alias("refused"))


@query(f"WITH {T.completions_sql()}, {Q.clean_sql()}, {Q.routed_sql()} SELECT id, outcome, chosen_role, parse_stage, detail AS parse_detail, answer, CASE WHEN outcome <> 'answered' THEN outcome END AS unscored_reason, left(stripped, 2000) AS explanation FROM routed")
def routing(spark, sf):
    return P.score_completions(T.completions(spark, sf)).select(*_META, "explanation")


@query(f"WITH {T.completions_sql()}, {Q.clean_sql()}, {Q.routed_sql()}, scored AS ({T.indicators_sql('routed')}), {counts_sql()}, {grid_sql()}, {wide_sql('grid')} SELECT * FROM wide")
def evaluate_clean(spark, sf):
    return A.wide_metrics(A.complete_grid(A.group_counts(P.score_completions(T.completions(spark, sf)))))


@query(f"WITH {T.completions_sql()}, {Q.paper_sql()}, {Q.routed_sql()}, scored AS ({T.indicators_sql('routed')}), {counts_sql()}, {grid_sql()}, {wide_sql('grid', 0)} SELECT * FROM wide")
def evaluate_paper(spark, sf):
    return A.wide_metrics(A.complete_grid(A.group_counts(P.score_completions(T.completions(spark, sf), "paper"))), 0)


@query(f"WITH {T.scored_sql()} SELECT id, category, split, outcome FROM scored WHERE (ft = 1 AND split = 'ambig') OR (truncated = 1 AND parse_strict = 1) OR outcome = 'refusal'")
def view_filters(spark, sf):
    return T.scored(spark, sf).where("(ft = 1 AND split = 'ambig') OR (truncated = 1 AND parse_strict = 1) OR outcome = 'refusal'").select("id", "category", "split", "outcome")


_BROKEN = "CASE WHEN id % 50 = 0 THEN 1 - correct ELSE correct END"


@query(f"WITH {T.scored_sql()}, broken AS (SELECT *, {_BROKEN} AS recorded FROM scored) SELECT id, outcome FROM broken WHERE recorded <> (CASE WHEN outcome = 'answered' AND chosen_role = label_role THEN 1 ELSE 0 END) OR ft + fo > 1 OR recorded + ft + fo + unparsed > 1")
def sample_faults(spark, sf):
    """Every fiftieth sample has its verdict turned round."""
    return V.sample_faults(T.scored(spark, sf).withColumn("correct", F.expr(_BROKEN))).select("id", "outcome")


# --- ledger and history --------------------------------------------------------------------------------------------

_L = T.ledger_sql()
_SPEND = "greatest(coalesce(cost_tokens, 0.0::DOUBLE), cost_credits)"


@query(f"WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY config, style, stage ORDER BY created DESC, line_no DESC) AS rn, min(line_no) OVER (PARTITION BY config, style, stage) AS place FROM ledger) SELECT config, style, stage, created, line_no, status, cost_tokens, place FROM r WHERE rn = 1")
def latest_record(spark, sf):
    return H.latest_records(T.ledger(spark, sf), ["config", "style", "stage"]).select("config", "style", "stage", "created", "line_no", "status", "cost_tokens", "place")


_BATCH = "old AS (SELECT * FROM ledger WHERE stage = 'smoke'), batch AS (SELECT *, row_number() OVER (PARTITION BY log_file ORDER BY line_no) AS rn FROM ledger WHERE stage <> 'smoke')"


@query(f"WITH {_L}, {_BATCH} SELECT line_no, log_file, config FROM batch WHERE rn = 1 AND log_file NOT IN (SELECT log_file FROM old)")
def idempotent_append(spark, sf):
    led = T.ledger(spark, sf)
    return H.new_records(led.where("stage = 'smoke'"), led.where("stage <> 'smoke'"), ["log_file"], "line_no").select("line_no", "log_file", "config")


@query(f"WITH {_L}, {_BATCH}, a AS (SELECT count(*) AS added FROM batch WHERE rn = 1 AND log_file NOT IN (SELECT log_file FROM old)) SELECT added, (SELECT count(*) FROM batch) - added AS skipped FROM a")
def append_counts(spark, sf):
    led = T.ledger(spark, sf)
    return H.append_counts(led.where("stage = 'smoke'"), led.where("stage <> 'smoke'"), ["log_file"], "line_no")


@query(f"WITH {_L}, n AS (SELECT * FROM ledger WHERE stage = 'full' AND log_file <> '') SELECT line_no, log_file FROM n UNION ALL SELECT line_no, log_file FROM ledger WHERE stage = 'smoke' AND log_file NOT IN (SELECT log_file FROM n)")
def upsert(spark, sf):
    led = T.ledger(spark, sf).select("line_no", "log_file", "stage")
    return H.upsert(led.where("stage = 'smoke'"), led.where("stage = 'full' AND log_file <> ''"), "log_file").select("line_no", "log_file")


@query(f"WITH {_L} SELECT config, style, count(*) AS lines, round(sum({_SPEND}), 6) AS spent, round(coalesce(sum(CASE WHEN status = 'interrupted' THEN {_SPEND} END), 0.0::DOUBLE), 6) AS prepaid, bool_or(status = 'ok') AS done, round(sum(cost_credits) / nullif(sum(CASE WHEN cost_credits IS NOT NULL THEN cost_tokens END), 0), 6) AS credits_per_token_cost FROM ledger GROUP BY config, style")
def ledger_totals(spark, sf):
    t = H.ledger_totals(T.ledger(spark, sf), ["config", "style"])
    return t.withColumns({c: F.round(c, 6) for c in ("spent", "prepaid", "credits_per_token_cost")})


@query(f"WITH {_L} SELECT stage, status, count(*) AS lines, round(sum({_SPEND}), 6) AS spent FROM ledger GROUP BY stage, status")
def cost_table(spark, sf):
    return T.ledger(spark, sf).groupBy("stage", "status").agg(F.count("*").alias("lines"), F.round(F.sum(M.spend(F.col("cost_tokens"), F.col("cost_credits"))), 6).alias("spent"))


@query(f"WITH {_L}, g AS (SELECT config, style, round(sum({_SPEND}), 6) AS gross, round(coalesce(sum(CASE WHEN status = 'interrupted' THEN {_SPEND} END), 0.0::DOUBLE), 6) AS prepaid FROM ledger GROUP BY config, style) SELECT config, style, greatest(gross - 5 * prepaid, 0.0::DOUBLE) AS net, greatest(gross * 0.25::DOUBLE, 0.000001::DOUBLE) AS threshold, round_even(greatest(prepaid - gross / 3.0::DOUBLE, 0.0::DOUBLE), 8) AS interrupted FROM g")
def prepaid(spark, sf):
    g = ledger_totals(spark, sf).select("config", "style", F.col("spent").alias("gross"), "prepaid")
    return g.select("config", "style", H.net_cost(F.col("gross"), F.lit(5) * F.col("prepaid")).alias("net"), H.settle_threshold(F.col("gross")).alias("threshold"), H.interrupted_cost(F.col("prepaid"), F.col("gross") / F.lit(3.0)).alias("interrupted"))


_LOGS = "logs AS (SELECT event_id AS log_id, 'log-' || (event_id % 900) AS log_file, 'm' || (user_id % 45) AS config, CASE WHEN user_id % 2 = 0 THEN 'clean' ELSE 'paper' END AS style FROM events)"


def _logs(spark, sf):
    return T.table(spark, sf, "events").selectExpr("event_id AS log_id", "concat('log-', CAST(event_id % 900 AS STRING)) AS log_file", "concat('m', CAST(user_id % 45 AS STRING)) AS config", "CASE WHEN user_id % 2 = 0 THEN 'clean' ELSE 'paper' END AS style")


@query(f"WITH {_L}, {_LOGS}, f AS (SELECT log_file, arg_max(line_no, line_no) AS fl FROM ledger WHERE log_file <> '' GROUP BY log_file), u AS (SELECT config, style, max(line_no) AS ul FROM ledger WHERE status = 'ok' GROUP BY config, style), m AS (SELECT logs.*, coalesce(fl, ul) AS line_no, CASE WHEN fl IS NOT NULL THEN 'log_file' WHEN ul IS NOT NULL THEN 'config/style' ELSE 'none' END AS matched_by FROM logs LEFT JOIN f USING (log_file) LEFT JOIN u USING (config, style)) SELECT m.*, l.cost_tokens, l.cost_credits FROM m LEFT JOIN ledger l USING (line_no)")
def ledger_match(spark, sf):
    return H.match_ledger(_logs(spark, sf), T.ledger(spark, sf))


_UNITS = "units AS (SELECT DISTINCT config, style FROM logs)"
_SOUND = "sound AS (SELECT * FROM ledger WHERE status = 'ok' AND samples > 0 AND output_tokens > 0)"
_MEASURED = f"{_LOGS}, {_UNITS}, {_SOUND}, same AS (SELECT config, style, arg_max(output_tokens / samples::DOUBLE, line_no) AS a FROM sound GROUP BY config, style), anys AS (SELECT config, arg_max(output_tokens / samples::DOUBLE, line_no) AS b FROM sound GROUP BY config), measured AS (SELECT units.config, units.style, coalesce(a, b) AS tokens_per_sample FROM units LEFT JOIN same USING (config, style) LEFT JOIN anys ON units.config = anys.config)"


def _units(spark, sf):
    return _logs(spark, sf).select("config", "style").distinct()


@query(f"WITH {_L}, {_MEASURED} SELECT * FROM measured")
def measured_tokens(spark, sf):
    return H.measured_tokens(_units(spark, sf), T.ledger(spark, sf))


_PRICED = [(f"m{i}", (i + 1) * 1e-7, (i + 3) * 2e-7) for i in range(40) if i % 4]
_PRICES_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for m, a, b in _PRICED) + ") t(price_model, price_in, price_out))"
_REASON = "CASE WHEN config IN ('m1', 'm5', 'm40', 'm41') THEN 'low' ELSE 'off' END"
_PLANNED = f"{_MEASURED}, {_PRICES_SQL}, planned AS (SELECT config, style, {_REASON} AS reasoning, config AS price_model, 200::BIGINT AS samples, 50000::BIGINT AS input_tokens, tokens_per_sample, config || '__' || style AS key FROM measured), est AS (SELECT planned.*, round_even(coalesce(tokens_per_sample, CASE reasoning WHEN 'low' THEN 600.0::DOUBLE ELSE 20.0::DOUBLE END) * samples, 0)::BIGINT AS est_output_tokens, price_in, price_out FROM planned JOIN prices USING (price_model)), priced AS (SELECT key, config, style, est_output_tokens, round(input_tokens * price_in + est_output_tokens * price_out, 9) AS usd FROM est)"


def _planned(spark, sf):
    m = H.measured_tokens(_units(spark, sf), T.ledger(spark, sf))
    return m.selectExpr("config", "style", f"{_REASON} AS reasoning", "config AS price_model", "200L AS samples", "50000L AS input_tokens", "tokens_per_sample", "concat(config, '__', style) AS key")


def _prices(spark):
    return spark.createDataFrame(_PRICED, "price_model string, price_in double, price_out double")


def _priced(spark, sf):
    return H.estimate_units(_planned(spark, sf), _prices(spark)).select("key", "config", "style", "est_output_tokens", F.round("usd", 9).alias("usd"))


@query(f"WITH {_L}, {_PLANNED} SELECT * FROM priced")
def unit_estimates(spark, sf):
    return _priced(spark, sf)


@query(f"WITH {_L}, {_PLANNED} SELECT key, config, style FROM planned WHERE price_model NOT IN (SELECT price_model FROM prices)")
def unpriced_anti(spark, sf):
    return H.unpriced(_planned(spark, sf), _prices(spark)).select("key", "config", "style")


@query(f"WITH {_L}, {_PLANNED} SELECT key, usd, round(sum(usd) OVER (ORDER BY usd, key ROWS UNBOUNDED PRECEDING), 6) AS cum_usd, row_number() OVER (ORDER BY usd, key) AS place FROM priced")
def running_cost(spark, sf):
    return H.running_cost(_priced(spark, sf)).select("key", "usd", F.round("cum_usd", 6).alias("cum_usd"), "place")


_DONE = "done AS (SELECT DISTINCT config || '__' || style AS key FROM ledger WHERE status = 'ok' AND stage = 'smoke' AND cost_tokens < 2)"


@query(f"WITH {_L}, {_PLANNED}, {_DONE}, todo AS (SELECT key, usd, sum(usd) OVER (ORDER BY usd, key ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (ORDER BY usd, key) AS place FROM priced WHERE key NOT IN (SELECT key FROM done)) SELECT key, place, NOT max(cum > 1.0) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS runs FROM todo")
def budget_plan(spark, sf):
    led = T.ledger(spark, sf)
    done = led.where("status = 'ok' AND stage = 'smoke' AND cost_tokens < 2").selectExpr("concat(config, '__', style) AS key").distinct()
    return H.budget_plan(_priced(spark, sf), done, 1.0).select("key", "place", "runs")


@query(f"WITH {_L}, p AS (SELECT 'm' || i AS config, CASE WHEN i % 2 = 0 THEN 'off' ELSE 'low' END AS reasoning FROM range(45) t(i)), s AS (SELECT config, arg_max(reasoning_tokens, line_no) AS reasoning_tokens, max(line_no) AS line_no FROM ledger WHERE stage = 'smoke' AND status = 'ok' GROUP BY config) SELECT p.config, p.reasoning, s.reasoning_tokens, s.line_no, CASE WHEN s.line_no IS NULL THEN 'SKIP' WHEN (p.reasoning = 'off') = (coalesce(s.reasoning_tokens, 0) = 0) THEN 'OK' ELSE 'FAIL' END AS verdict FROM p LEFT JOIN s USING (config)")
def reasoning_check(spark, sf):
    panel = spark.range(45).selectExpr("concat('m', CAST(id AS STRING)) AS config", "CASE WHEN id % 2 = 0 THEN 'off' ELSE 'low' END AS reasoning")
    return H.latest_ok(T.ledger(spark, sf), panel)


@query(f"WITH {_L} SELECT config, sum(samples)::BIGINT AS samples, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(reasoning_tokens, 0))::BIGINT AS reasoning_tokens FROM ledger GROUP BY config")
def token_usage(spark, sf):
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return T.ledger(spark, sf).groupBy("config").agg(F.sum("samples").alias("samples"), total("output_tokens"), total("reasoning_tokens"))


# --- reports and verification --------------------------------------------------------------------------------------

_PUB = "pub AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', '{k}', {v!r}::DOUBLE)" for (m, s), x in PUBLISHED_POOLED.items() for k, v in zip(HEADLINE_METRICS, x, strict=True)) + ") t(ref_model, split, name, published))"
_ANCHOR_CASE = "CASE config " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ANCHORS.items()) + " END"


def _published(spark):
    return ref.published_metrics(spark).where("grp = 'all'").select("ref_model", "split", "name", "published")


def _run_metrics(spark, sf):
    return A.long_metrics(_wide(spark, sf)).join(F.broadcast(T.runs(spark)), "run_key")  # six runs


@query(f"WITH {metrics_sql()}, {T.RUNS_SQL}, {_PUB}, own AS (SELECT config, {_ANCHOR_CASE} AS ref_model, split, name, coalesce(max(CASE WHEN style = 'paper' THEN value END), {NAN}) AS ours_paper, coalesce(max(CASE WHEN style = 'clean' THEN value END), {NAN}) AS ours_clean FROM long JOIN runs USING (run_key) WHERE grp = 'all' AND {_ANCHOR_CASE} IS NOT NULL GROUP BY ALL) SELECT config, ref_model, split, name, published, ours_paper, ours_clean, ours_paper - published AS port, ours_clean - ours_paper AS protocol FROM own JOIN pub USING (ref_model, split, name)")
def anchor_pivot(spark, sf):
    return R.anchor_table(_run_metrics(spark, sf).where("grp = 'all'"), _published(spark))


_MODERN = "m AS (SELECT w.*, config, reasoning FROM wide w JOIN runs USING (run_key) WHERE grp = 'all' AND \"group\" = 'modern' AND style = 'clean')"


@query(f"WITH {metrics_sql()}, {T.RUNS_SQL}, {_MODERN}, lo AS (SELECT *, regexp_replace(config, '-low$', '') AS base FROM m WHERE reasoning = 'low'), off AS (SELECT *, config AS base FROM m WHERE reasoning = 'off') SELECT off.base, off.split, off.accuracy AS accuracy_off, off.bias_score AS bias_off, lo.accuracy AS accuracy_low, lo.bias_score AS bias_low, (3 * lo.n) / lo.n AS tokens_per_sample, lo.accuracy - off.accuracy AS d_accuracy, lo.bias_score - off.bias_score AS d_bias FROM off JOIN lo ON off.base = lo.base AND off.split = lo.split")
def reasoning_pairs(spark, sf):
    return R.reasoning_pairs(_modern(spark, sf))


def _modern(spark, sf):
    r = F.broadcast(T.runs(spark).where("`group` = 'modern' AND style = 'clean'"))  # six runs
    return _wide(spark, sf).where("grp = 'all'").join(r, "run_key").withColumns({"reasoning_tokens": F.col("n") * 3, "samples": F.col("n")})


@query(f"WITH {metrics_sql()}, {T.RUNS_SQL}, {_MODERN} SELECT regexp_replace(config, '-low$', '') AS base, min(reasoning) AS have FROM m GROUP BY 1 HAVING count(DISTINCT reasoning) < 2")
def unpaired_runs(spark, sf):
    return R.unpaired(_modern(spark, sf))


@query(f"WITH {metrics_sql()} SELECT {_GROUP}, printf('%.6f', n) AS n, printf('%.6f', accuracy) AS accuracy, printf('%.6f', bias_score) AS bias_score, CASE WHEN isnan(valid_accuracy) THEN '' ELSE printf('%.6f', valid_accuracy) END AS valid_accuracy FROM wide")
def csv_table(spark, sf):
    return R.csv_table(_wide(spark, sf), ["run_key", "split", "grp"], ("n", "accuracy", "bias_score", "valid_accuracy"))


_SUPPLIED = "SELECT s_suppkey AS run_key, 'm' || (s_suppkey // 2) || CASE WHEN s_suppkey % 6 = 1 THEN '-low' ELSE '' END AS config, CASE WHEN s_suppkey % 6 = 1 THEN 'low' ELSE 'off' END AS reasoning, CASE WHEN s_suppkey % 6 IN (3, 5) THEN 'paper' ELSE 'clean' END AS style FROM supplier"


@query(f"WITH runs AS ({_SUPPLIED}), b AS (SELECT *, regexp_replace(config, '-low$', '') AS base FROM runs), k AS (SELECT base, count(DISTINCT reasoning) AS k FROM b GROUP BY base) SELECT run_key, config, reasoning, style, CASE WHEN reasoning = 'low' OR k > 1 THEN base || ' · reasoning ' || reasoning ELSE base || ' · ' || CASE style WHEN 'paper' THEN 'paper prompt' ELSE 'default prompt' END END AS label FROM b JOIN k USING (base)")
def run_labels(spark, sf):
    """Each supplier is a run; two neighbours are variants of one config, by reasoning or by style."""
    T.table(spark, sf, "supplier").createOrReplaceTempView("_label_suppliers")
    return R.check_unique(R.run_labels(spark.sql(_SUPPLIED.replace("//", "DIV").replace("FROM supplier", "FROM _label_suppliers"))))


_TIE0 = metrics_sql(tie_sign=1) + ", " + wide_sql("grid", 0, "wide0") + ", " + long_sql("wide0", "long0")


@query(f"WITH {_TIE0}, a AS (SELECT * FROM long WHERE NOT (run_key = 2 AND grp = '3-MEDIUM')), b AS (SELECT run_key, split, grp, name, CASE WHEN run_key = 3 THEN value + 0.0008 ELSE value END AS value FROM long0 WHERE run_key <> 5 OR split = 'ambig') SELECT run_key, split, grp, name, a.value AS ours, b.value AS theirs, CASE WHEN a.value IS NULL THEN 'missing' WHEN b.value IS NULL THEN 'extra' WHEN abs(a.value - b.value) <= 0.001 THEN 'match' ELSE 'differs' END AS status FROM a FULL OUTER JOIN b USING (run_key, split, grp, name)")
def reconcile_tolerance(spark, sf):
    ours = A.long_metrics(_wide(spark, sf)).where("NOT (run_key = 2 AND grp = '3-MEDIUM')")
    theirs = A.long_metrics(_wide(spark, sf, 0)).where("run_key <> 5 OR split = 'ambig'").withColumn("value", F.when(F.col("run_key") == 3, F.col("value") + 0.0008).otherwise(F.col("value")))
    return V.reconcile(ours, theirs, ["run_key", "split", "grp", "name"], 0.001)


_ACC = "a AS (SELECT CAST(run_key AS VARCHAR) AS model, split, grp, accuracy AS value FROM wide WHERE grp <> 'all'), pub AS (SELECT model, CASE WHEN model < '3' THEN CASE split WHEN 'ambig' THEN 'disambig' ELSE 'ambig' END ELSE split END AS split, grp, round(value, 3) AS value FROM a)"


@query(f"WITH {metrics_sql()}, {_ACC} SELECT a.model, count(*) AS cells, count(*) FILTER (WHERE abs(a.value - p.value) <= 0.001) AS hits_as_printed, count(*) FILTER (WHERE abs(a.value - q.value) <= 0.001) AS hits_swapped FROM a JOIN pub p ON a.model = p.model AND a.split = p.split AND a.grp = p.grp JOIN pub q ON a.model = q.model AND a.split <> q.split AND a.grp = q.grp GROUP BY a.model")
def caption_swap_hits(spark, sf):
    a = _wide(spark, sf).where("grp <> 'all'").selectExpr("CAST(run_key AS STRING) AS model", "split", "grp", "accuracy AS value")
    pub = a.selectExpr("model", "CASE WHEN model < '3' THEN CASE split WHEN 'ambig' THEN 'disambig' ELSE 'ambig' END ELSE split END AS split", "grp", "round(value, 3) AS value")
    return V.swapped_hits(a, pub, 0.001)


@query("WITH s AS (SELECT d.doc_id, d.lang AS category, CASE WHEN quality IS NULL THEN 'Rev' ELSE CAST(quality AS VARCHAR) END AS quality, CASE WHEN toxic = 1 THEN '2.0' ELSE CAST(toxic AS VARCHAR) END AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), u AS (SELECT doc_id, category, 'quality' AS model, quality AS answer FROM s UNION ALL SELECT doc_id, category, 'toxic', toxic FROM s) SELECT category, model, count(*) AS n, count(*) FILTER (WHERE try_cast(answer AS DOUBLE) IN (0, 1, 2)) AS answered, coalesce(sum(CASE WHEN try_cast(answer AS DOUBLE) IN (0, 1, 2) THEN try_cast(answer AS DOUBLE) END), 0)::BIGINT AS total FROM u GROUP BY category, model")
def sheet_unpivot(spark, sf):
    docs, labels = T.table(spark, sf, "documents"), T.table(spark, sf, "labels")
    s = docs.join(labels, "doc_id", "left").select("doc_id", F.col("lang").alias("category"), F.coalesce(F.col("quality").cast("string"), F.lit("Rev")).alias("quality"), F.when(F.col("toxic") == 1, "2.0").otherwise(F.col("toxic").cast("string")).alias("toxic"))
    u = A.unpivot_sheet(s, ["doc_id", "category"], ["quality", "toxic"])
    return u.groupBy("category", "model").agg(F.count("*").alias("n"), F.count("choice").alias("answered"), F.coalesce(F.sum("choice"), F.lit(0)).alias("total"))
