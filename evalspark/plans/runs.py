"""Registered queries over runs, samples and sheets: labels, replays, filters, cross checks, results files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import LETTERS
from ..functions.metrics import metric_at
from ..operators import aggregate as A
from ..operators import bootstrap as B
from ..operators import history as H
from ..operators import report as R
from ..operators import sampling as S
from ..operators import scoring as P
from ..operators import verify as V
from . import adapters as T
from .queries import _DONE, _L, _PLANNED, _modern, _priced, _wide, query
from .sql import NAN, counts_sql, grid_sql, metrics_sql, wide_sql

_SWAPPED = "CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'target' END"


@query(f"WITH {T.ITEMS_SQL} SELECT id FROM items WHERE doc_id % 5 = 0")
def role_faults(spark, sf):
    """Every fifth item has two options of one role."""
    first = F.struct(F.get("options", F.lit(0))["text"].alias("text"), F.expr(_SWAPPED).alias("role"))
    items = T.items(spark, sf).withColumn("options", F.array(first, F.get("options", F.lit(1)), F.get("options", F.lit(2))))
    return S.role_faults(items).select("id")


@query(f"WITH {T.ITEMS_SQL} SELECT id, category FROM items WHERE category IN ('de', 'en')")
def category_filter(spark, sf):
    return S.where_categories(T.items(spark, sf), "en, de", ("de", "en", "es", "fr")).select("id", "category")


_PANEL = "panel AS (SELECT 'm' || i AS config, CASE WHEN i % 2 = 0 THEN 'anchor' ELSE 'modern' END AS \"group\", CASE WHEN i % 3 = 0 THEN 'low' ELSE 'off' END AS reasoning FROM range(25) t(i))"


@query(f"WITH {_L}, {_PANEL} SELECT line_no, ledger.config, coalesce(\"group\", 'unknown') AS \"group\", coalesce(reasoning, 'unknown') AS reasoning FROM ledger LEFT JOIN panel ON ledger.config = panel.config")
def log_panel(spark, sf):
    panel = spark.range(25).selectExpr("concat('m', CAST(id AS STRING)) AS config", "CASE WHEN id % 2 = 0 THEN 'anchor' ELSE 'modern' END AS `group`", "CASE WHEN id % 3 = 0 THEN 'low' ELSE 'off' END AS reasoning")
    return H.label_logs(T.ledger(spark, sf).select("line_no", "config"), panel)


@query(f"WITH {_L} SELECT line_no, config, style, created FROM ledger WHERE stage = 'full'")
def full_runs(spark, sf):
    return H.full_stage_runs(T.ledger(spark, sf)).select("line_no", "config", "style", "created")


@query(f"WITH {T.scored_sql()} " + " UNION ALL ".join(f"SELECT id, '{k}' AS scorer, {k} AS score FROM scored" for k in ("correct", "ft", "fo", "unparsed")))
def sample_scores(spark, sf):
    scores = F.create_map(*[x for k in ("correct", "ft", "fo", "unparsed") for x in (F.lit(k), F.col(k))])
    return P.flatten_scores(T.scored(spark, sf).select("id", scores.alias("scores")))


@query(f"WITH {T.ITEMS_SQL} SELECT items.id, items.category, length(items.context) AS chars FROM items JOIN (SELECT 'd-' || doc_id AS id FROM labels) c ON items.id = c.id")
def sample_join(spark, sf):
    answered = T.table(spark, sf, "labels").select(F.concat(F.lit("d-"), "doc_id").alias("id"))
    return P.join_completions(T.items(spark, sf), answered).select("id", "category", F.length("context").alias("chars"))


_ACTUAL = "CASE WHEN place % 3 = 0 THEN usd * 3 ELSE usd / 2 END"
_GATE = "replay AS (SELECT key, usd, row_number() OVER (ORDER BY usd, key) AS place, key IN (SELECT key FROM done) AS done FROM priced), todo AS (SELECT *, round(0.1 + coalesce(sum(actual) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before FROM (SELECT *, " + _ACTUAL + " AS actual FROM replay) WHERE NOT done)"


@query(f"WITH {_L}, {_PLANNED}, {_DONE}, {_GATE} SELECT key, place, spent_before, NOT max(spent_before + usd > 0.6) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS runs FROM todo UNION ALL SELECT key, place, NULL, false FROM replay WHERE done")
def budget_gate(spark, sf):
    done = T.ledger(spark, sf).where("status = 'ok' AND stage = 'smoke' AND cost_tokens < 2").selectExpr("concat(config, '__', style) AS key").distinct().withColumn("done", F.lit(True))
    units = H.running_cost(_priced(spark, sf)).join(done, "key", "left").withColumns({"done": F.coalesce("done", F.lit(False)), "actual": F.expr(_ACTUAL)})
    return H.budget_gate(units, 0.1, 0.6).select("key", "place", F.round("spent_before", 6).alias("spent_before"), "runs")


@query(f"WITH {_L} SELECT coalesce(NULL, stage || '/' || config || '__' || style) AS unit, status, samples, created AS timestamp, cost_credits AS credits_usd, coalesce(cost_tokens, 0.0) AS tokens_usd, greatest(coalesce(cost_tokens, 0.0::DOUBLE), cost_credits) AS billed_usd FROM ledger")
def ledger_lines(spark, sf):
    return H.ledger_table(T.ledger(spark, sf).withColumn("key", F.lit(None).cast("string")))


_FILTERS = {k: v.format(category="2-HIGH", split="ambig", text="1") for k, v in P.SAMPLE_FILTERS.items()}


@query(f"WITH {T.scored_sql()}, s AS (SELECT *, CAST(id AS VARCHAR) AS input FROM scored) " + " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS n FROM s WHERE {v}" for k, v in _FILTERS.items()))
def sample_filters(spark, sf):
    """How many samples each documented filter keeps, in one pass."""
    s = T.scored(spark, sf).withColumn("input", F.col("id").cast("string"))
    counts = s.agg(*[F.count_if(F.expr(v)).alias(k) for k, v in _FILTERS.items()])
    return counts.unpivot([], list(_FILTERS), "filter", "n")


_CHECKED = "checked AS (SELECT *, CASE chosen_role WHEN 'target' THEN 0 WHEN 'other' THEN 1 WHEN 'unknown' THEN 2 END AS chosen_at, CASE WHEN id % 30 = 0 THEN 'A' ELSE CASE label_role WHEN 'target' THEN 'A' WHEN 'other' THEN 'B' ELSE 'C' END END AS target, CASE WHEN id % 70 = 0 THEN 1 - ft ELSE ft END AS rec FROM scored)"


@query(f"WITH {T.scored_sql()}, {_CHECKED}, p AS (SELECT id, (chosen_at IS NOT NULL AND (substr('ABC', chosen_at + 1, 1) = target) <> (chosen_role = label_role)) AS letter, rec <> ft AS ft_bad FROM checked) SELECT id, concat_ws(', ', CASE WHEN letter THEN 'target letter' END, CASE WHEN ft_bad THEN 'ft' END) AS problems FROM p WHERE letter OR ft_bad")
def cross_check(spark, sf):
    """Every thirtieth sample has the letter A as its target, every seventieth a wrong ft."""
    roles = F.array(*map(F.lit, ("target", "other", "unknown")))
    letter = F.get(F.array(*map(F.lit, LETTERS)), (F.array_position(roles, F.col("label_role")) - 1).cast("int"))
    s = T.scored(spark, sf).withColumns({
        "roles": roles, "chosen_at": F.when(F.col("chosen_role").isNotNull(), F.array_position(roles, F.col("chosen_role")) - 1).cast("int"),
        "target": F.when(F.col("id") % 30 == 0, "A").otherwise(letter), "ft": F.when(F.col("id") % 70 == 0, 1 - F.col("ft")).otherwise(F.col("ft")),
    })
    return V.cross_check(s).select("id", F.array_join("problems", ", ").alias("problems"))


@query(f"WITH {metrics_sql()}, {T.RUNS_SQL} SELECT run_key, config, split, accuracy FROM wide JOIN runs USING (run_key) WHERE grp = 'all'")
def runs_by_accuracy(spark, sf):
    runs = _wide(spark, sf).where("grp = 'all'").join(F.broadcast(T.runs(spark)), "run_key")  # six runs
    return R.by_accuracy(runs).select("run_key", "config", "split", "accuracy")


@query(f"WITH {metrics_sql()}, {T.RUNS_SQL}, m AS (SELECT w.*, config, reasoning FROM wide w JOIN runs USING (run_key) WHERE grp = 'all' AND \"group\" = 'modern' AND style = 'clean') SELECT o.config AS base, o.split, o.accuracy AS accuracy_off FROM m o JOIN m l ON l.reasoning = 'low' AND o.reasoning = 'off' AND regexp_replace(l.config, '-low$', '') = o.config AND o.split = l.split")
def pairs_by_accuracy(spark, sf):
    return R.pairs_by_accuracy(R.reasoning_pairs(_modern(spark, sf))).select("base", "split", "accuracy_off")


def _results(spark, sf, intervals):
    scored, counts = T.scored(spark, sf), A.complete_grid(A.group_counts(T.scored(spark, sf)))
    runs = R.run_labels(T.runs(spark)).withColumns({"temperature": F.lit(0.75), "tie_sign": F.lit(1)})
    key = "run_key long, split string, grp string, name string, se double"
    ci = B.bootstrap_intervals(scored) if intervals else spark.createDataFrame([], key + ", lo double, hi double")
    se = B.bootstrap_ses(scored) if intervals else spark.createDataFrame([], key)
    return R.results_table(runs, A.wide_metrics(counts), counts, ci, se, "percentile bootstrap over outcome patterns")


_CELL = lambda x: f"CASE WHEN isnan({x}) THEN '' ELSE printf('%.6f', {x}) END"


@query(f"WITH {metrics_sql()}, {T.RUNS_SQL} SELECT config, style AS prompt_style, split, grp AS category, CAST(w.n::BIGINT AS VARCHAR) AS n, CAST(g.correct::BIGINT AS VARCHAR) AS n_correct, CAST(g.ft::BIGINT AS VARCHAR) AS n_target_error, CAST((g.n - g.correct - g.ft - g.fo - g.unparsed)::BIGINT AS VARCHAR) AS n_other_outcome, {_CELL('w.accuracy')} AS accuracy, {_CELL('abs(w.bias_score)')} AS bias_magnitude, 'no' AS sign_decided FROM wide w JOIN grid g USING (run_key, split, grp) JOIN runs USING (run_key) WHERE w.n > 0")
def results_table(spark, sf):
    cols = ["config", "prompt_style", "split", "category", "n", "n_correct", "n_target_error", "n_other_outcome", "accuracy", "bias_magnitude", "sign_decided"]
    return _results(spark, sf, False).select(*cols)


@query(None)
def results_file(spark, sf):
    """All 29 columns, with the bootstrap's intervals, which no SQL draws alike."""
    return _results(spark, sf, True)


_KEYS = ("ambig/all/accuracy", "disambig/all/accuracy", "ambig/none/accuracy")


@query(f"WITH {metrics_sql()} SELECT run_key, max(CASE WHEN split = 'ambig' THEN round_even(accuracy, 6) END) AS a, max(CASE WHEN split = 'disambig' THEN round_even(accuracy, 6) END) AS b, {NAN} AS c FROM wide WHERE grp = 'all' GROUP BY run_key")
def metric_access(spark, sf):
    maps = A.to_maps(A.long_metrics(_wide(spark, sf)))
    return maps.select("run_key", *[metric_at(F.col("metrics"), k).alias(n) for n, k in zip("abc", _KEYS, strict=True)])


_SHEET = "sheet AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"WITH {_SHEET} SELECT * FROM (SELECT 'columns' AS check, false AS ok, 'missing_one' AS detail UNION ALL SELECT 'rows', count(*) = 7, CAST(count(*) AS VARCHAR) FROM sheet UNION ALL SELECT 'values of lang', count(*) FILTER (WHERE lang NOT IN ('en', 'es')) = 0, coalesce(string_agg(DISTINCT lang, ', ' ORDER BY lang) FILTER (WHERE lang NOT IN ('en', 'es')), '') FROM sheet UNION ALL SELECT 'values of toxic', true, '' UNION ALL SELECT 'even', count(*) FILTER (WHERE doc_id % 2 <> 0) = 0, CAST(count(*) FILTER (WHERE doc_id % 2 <> 0) AS VARCHAR) FROM sheet)")
def sheet_sanity(spark, sf):
    sheet = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")
    return A.sheet_sanity(sheet, {"lang": ["en", "es"], "toxic": [0, 1]}, ["doc_id", "missing_one"], 7, {"even": "doc_id % 2 = 0"})


@query(f"""WITH {_SHEET}, q AS (SELECT string_agg(v || ': ' || n, ', ' ORDER BY v || ': ' || n) AS detail FROM (SELECT coalesce(CAST(quality AS VARCHAR), 'null') AS v, count(*) AS n FROM sheet GROUP BY ALL)),
    langs AS (SELECT list(DISTINCT lang) AS have FROM sheet), want AS (SELECT ['en', 'es', 'xx'] AS w)
    SELECT 'columns' AS check, true AS ok, '' AS detail
    UNION ALL SELECT 'exactly lang', len(list_filter(w, lambda x: NOT list_contains(have, x))) + len(list_filter(have, lambda x: NOT list_contains(w, x))) = 0,
        'missing: ' || array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(have, x))), ', ') || '; too much: ' || array_to_string(list_sort(list_filter(have, lambda x: NOT list_contains(w, x))), ', ') FROM langs, want
    UNION ALL SELECT 'rows by quality', true, detail FROM q
    UNION ALL SELECT 'answers of toxic', true, 'unparsed: ' || count(*) FILTER (WHERE toxic IS NULL OR toxic = 1) FROM sheet
    UNION ALL SELECT 'answers of doc', false, 'no answer: ' || min(CAST(doc_id AS VARCHAR)) FILTER (WHERE doc_id NOT IN (0, 1, 2)) FROM sheet""")
def sheet_domains(spark, sf):
    """Exact sets, rows by value, and answer cells of the joined table."""
    sheet = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")
    return A.sheet_sanity(sheet, {}, ["doc_id"], equal={"lang": ["en", "es", "xx"]}, counts=("quality",), answers={"toxic": "toxic", "doc": "doc_id"}, unparsed=("1",))



_ANSWERS = "raw AS (SELECT model AS run_key, doc_id AS id, lang AS category, CASE WHEN doc_id % 2 = 0 THEN 'ambig' ELSE 'disambig' END AS split, CASE WHEN n_chars % 2 = 0 THEN 'neg' ELSE 'nonneg' END AS polarity, CASE WHEN doc_id % 2 = 0 THEN 'unknown' WHEN doc_id % 4 = 1 THEN 'target' ELSE 'other' END AS label_role, CASE choice WHEN 0 THEN 'other' WHEN 1 THEN 'target' WHEN 2 THEN 'unknown' END AS chosen_role, CASE WHEN choice IS NULL THEN 'invalid_response_format' ELSE 'answered' END AS outcome, CASE WHEN choice IS NULL THEN 'none' ELSE 'strict' END AS parse_stage, false AS was_truncated FROM (SELECT doc_id, lang, n_chars, 'a' AS model, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 3 END AS choice FROM documents UNION ALL SELECT doc_id, lang, n_chars, 'b', n_chars % 3 FROM documents))"


@query(f"WITH {_ANSWERS}, scored AS ({T.indicators_sql('raw')}), {counts_sql()}, {grid_sql()}, {wide_sql('grid', 0)} SELECT * FROM wide")
def sheet_metrics(spark, sf):
    docs = T.table(spark, sf, "documents")
    label = F.when(F.pmod("doc_id", F.lit(2)) == 0, "unknown").when(F.pmod("doc_id", F.lit(4)) == 1, "target").otherwise("other")
    sheet = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "ambig").otherwise("disambig").alias("split"), F.when(F.pmod("n_chars", F.lit(2)) == 0, "neg").otherwise("nonneg").alias("polarity"), label.alias("label_role"),
        F.array(*map(F.lit, ("other", "target", "unknown"))).alias("roles"), F.when(F.pmod("doc_id", F.lit(9)) == 0, "Rev").otherwise(F.pmod("doc_id", F.lit(3)).cast("string")).alias("a"), F.pmod("n_chars", F.lit(3)).cast("double").cast("string").alias("b"),
    )
    long = A.unpivot_sheet(sheet, ["id", "category", "split", "polarity", "label_role", "roles"], ["a", "b"])
    return A.wide_metrics(A.complete_grid(A.group_counts(P.score_indicators(A.sheet_outcomes(long)))), 0)


_USAGE = "SELECT config, sum(coalesce(samples, 0) + coalesce(output_tokens, 0))::BIGINT AS input_tokens, sum(2 * coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(reasoning_tokens, 0))::BIGINT AS reasoning_tokens FROM ledger GROUP BY config"


@query(f"WITH {_L} {_USAGE}")
def usage_maps(spark, sf):
    """Two models a log, the second without reasoning tokens."""
    use = lambda i, r: F.struct(i.cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), r.cast("long").alias("reasoning_tokens"))
    logs = T.ledger(spark, sf).withColumn("usage", F.create_map(F.lit("m"), use(F.col("samples"), F.col("reasoning_tokens")), F.lit("n"), use(F.col("output_tokens"), F.lit(None))))
    logs = P.token_usage(logs.select("config", "usage"))
    return logs.groupBy("config").agg(*[F.sum(k).alias(k) for k in ("input_tokens", "output_tokens", "reasoning_tokens")])
