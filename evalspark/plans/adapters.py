"""Bindings of the test tables to the engine's inputs, as DataFrames and as DuckDB common table expressions.

The item corpus itself is not public here, so domains are re-bound: order priorities serve as categories, return flags
as chosen roles and so on. Both sides use the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import score_indicators

CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASE = {
    "run_key": "l_partkey % 6",
    "id": "l_orderkey * 8 + l_linenumber",
    "split": "CASE l_linestatus WHEN 'O' THEN 'ambig' ELSE 'disambig' END",
    "polarity": "CASE WHEN l_linenumber % 2 = 0 THEN 'neg' ELSE 'nonneg' END",
    "role": "CASE l_returnflag WHEN 'N' THEN 'unknown' WHEN 'A' THEN 'target' ELSE 'other' END",
    "label_role": "CASE WHEN l_linestatus = 'O' THEN 'unknown' WHEN l_partkey % 2 = 0 THEN 'target' ELSE 'other' END",
    "outcome": "CASE l_suppkey % 20 WHEN 0 THEN 'invalid_response_format' WHEN 1 THEN 'refusal' WHEN 2 THEN 'no_response' ELSE 'answered' END",
    "parse_stage": "CASE WHEN l_suppkey % 20 <= 2 THEN 'none' WHEN l_suppkey % 20 <= 5 THEN 'lenient' ELSE 'strict' END",
    "truncated": "l_suppkey % 20 IN (2, 7)",
}


def outcomes(spark: SparkSession, sf_dir: str, geo: bool = False) -> DataFrame:
    """Unscored rows from line items; category is the order's priority, or with ``geo`` the customer's region."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    df = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    category = "o_orderpriority"
    if geo:
        nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
        places = F.broadcast(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name"))  # 25 rows by definition
        customer = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
        df, category = df.join(customer, F.col("o_custkey") == F.col("c_custkey")), "r_name"
    df = df.select(F.col(category).alias("category"), *[F.expr(v).alias(k) for k, v in _BASE.items()])
    return df.withColumn("chosen_role", F.when(F.col("outcome") == "answered", F.col("role"))).drop("role")


def scored(spark: SparkSession, sf_dir: str, geo: bool = False) -> DataFrame:
    return score_indicators(outcomes(spark, sf_dir, geo))


_COLS = ", ".join(f"{v} AS {k}" for k, v in _BASE.items())
_JOIN = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_GEO = f"{_JOIN} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_FLAG = lambda cond: f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def indicators_sql(source: str) -> str:
    """A select that adds the thirteen indicators to rows of ``source``."""
    against = "((chosen_role = 'target' AND polarity = 'neg') OR (chosen_role = 'other' AND polarity = 'nonneg'))"
    other_way = "((chosen_role = 'other' AND polarity = 'neg') OR (chosen_role = 'target' AND polarity = 'nonneg'))"
    wrong = "outcome = 'answered' AND chosen_role <> label_role"
    flags = {
        "correct": "outcome = 'answered' AND chosen_role = label_role", "chose_target": "chosen_role = 'target'", "chose_other": "chosen_role = 'other'", "chose_unknown": "chosen_role = 'unknown'",
        "ft": f"{wrong} AND {against}", "fo": f"{wrong} AND {other_way}", "unparsed": "outcome <> 'answered'", "invalid": "outcome = 'invalid_response_format'",
        "refusal": "outcome = 'refusal'", "no_response": "outcome = 'no_response'", "truncated": "was_truncated", "parse_strict": "parse_stage = 'strict'", "parse_lenient": "parse_stage = 'lenient'",
    }
    return f"SELECT run_key, id, category, split, polarity, label_role, chosen_role, outcome, parse_stage, {', '.join(f'{_FLAG(v)} AS {k}' for k, v in flags.items())} FROM {source}"


def scored_sql(geo: bool = False) -> str:
    """CTEs ``raw`` and ``scored``."""
    category, source = ("r_name", _GEO) if geo else ("o_orderpriority", _JOIN)
    raw = f"SELECT category, run_key, id, split, polarity, label_role, outcome, parse_stage, truncated AS was_truncated, CASE WHEN outcome = 'answered' THEN role END AS chosen_role FROM (SELECT {category} AS category, {_COLS} FROM {source})"
    return f"raw AS ({raw}), scored AS ({indicators_sql('raw')})"


# --- completions over documents -------------------------------------------------------------------------------------

CHOICES = (("el hombre", "la mujer", "No se puede determinar"), ("el hombre mayor", "el hombre", "desconocido"), ("the old man", "the young man", "unknown"))
#: (before, after) the document's whole text, by doc_id % len; a closing tag before or after decides what is read.
FRAMES = (
    ("", "\nRESPUESTA: B"),
    ("", "\n**ANSWER:** (c)."),
    ("Respuesto: A\n", ""),
    ("", "\nRESPUESTA A\nfin"),
    ("La respuesta correcta es C. ", ""),
    ("the correct option would be (B) ", ""),
    ("Se elige la opción A. ", ""),
    ("I choose option C, ", ""),
    ("", "</think>(b)."),
    ("", "</think> B"),
    ("No puedo responder. ", ""),
    ("I’m sorry, ", ""),
    ("", "</think>"),
    ("", "</think> El hombre"),
    ("", "</think> el hombre mayor"),
    ("RESPUESTA: A\nRESPUESTA: B\n", ""),
    ("", "</think>Option 1: la mujer"),
    ("", "</think>2"),
    ("", "</think>0: el hombre"),
    ("", "\nOpción C."),
    ("<think>RESPUESTA: A</think>", "\nANSWER : b"),
    ("", "</think>__unknown__"),
    ("La respuesta es A. La alternativa es B. ", ""),
    ("", ""),
)
_STOPS = ("stop", "max_tokens", "content_filter", "model_length")


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cases(expr: str, values: list[str], quote) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


def _pick(expr: Column, values: list) -> Column:
    out = F.when(expr == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(expr == i, v)
    return out


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, completion, stop_reason, choices, roles, label_role, polarity, category, split from documents."""
    docs = table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(len(FRAMES)))
    text = F.concat(_pick(k, [F.lit(a) for a, _ in FRAMES]), F.coalesce("text", F.lit("")), _pick(k, [F.lit(b) for _, b in FRAMES]))
    choices = _pick(F.pmod("doc_id", F.lit(3)), [F.array(*map(F.lit, c)) for c in CHOICES])
    stop = _pick(F.least(F.pmod("doc_id", F.lit(17)), F.lit(3)), [F.lit(_STOPS[i]) for i in (1, 2, 3, 0)])
    return docs.select(
        F.concat(F.lit("d-"), "doc_id").alias("id"), F.lit(0).cast("long").alias("run_key"), F.col("lang").alias("category"), text.alias("completion"), stop.alias("stop_reason"), choices.alias("choices"),
        F.array(*map(F.lit, ("target", "other", "unknown"))).alias("roles"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "ambig").otherwise("disambig").alias("split"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "unknown").when(F.pmod("doc_id", F.lit(4)) == 1, "target").otherwise("other").alias("label_role"),
        F.when(F.pmod("n_chars", F.lit(2)) == 0, "neg").otherwise("nonneg").alias("polarity"),
    )


def completions_sql() -> str:
    """CTE ``comp``; choices are three columns c0..c2."""
    k = f"doc_id % {len(FRAMES)}"
    text = f"concat({_cases(k, [a for a, _ in FRAMES], _sql)}, coalesce(text, ''), {_cases(k, [b for _, b in FRAMES], _sql)})"
    c = [_cases("doc_id % 3", [x[i] for x in CHOICES], _sql) for i in range(3)]
    stop = _cases("least(doc_id % 17, 3)", [_STOPS[i] for i in (1, 2, 3, 0)], _sql)
    return f"""comp AS (SELECT 'd-' || doc_id AS id, 0::BIGINT AS run_key, lang AS category, {text} AS completion, {stop} AS stop_reason, {c[0]} AS c0, {c[1]} AS c1, {c[2]} AS c2,
        CASE WHEN doc_id % 2 = 0 THEN 'ambig' ELSE 'disambig' END AS split, CASE WHEN doc_id % 2 = 0 THEN 'unknown' WHEN doc_id % 4 = 1 THEN 'target' ELSE 'other' END AS label_role,
        CASE WHEN n_chars % 2 = 0 THEN 'neg' ELSE 'nonneg' END AS polarity FROM documents)"""


# --- items, ledger, history ----------------------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = F.when(F.pmod("doc_id", F.lit(2)) == 0, "ambig").otherwise("disambig")
    polarity = F.when(F.pmod("n_chars", F.lit(2)) == 0, "neg").otherwise("nonneg")
    label = F.when(F.pmod("doc_id", F.lit(2)) == 0, "unknown").when(F.pmod("doc_id", F.lit(4)) == 1, "target").otherwise("other")
    options = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(r).alias("role")) for t, r in zip(CHOICES[0], ("target", "other", "unknown"), strict=True)])
    return docs.select(F.concat(F.lit("d-"), "doc_id").alias("id"), "doc_id", F.col("lang").alias("category"), split.alias("split"), polarity.alias("polarity"), label.alias("label_role"), options.alias("options"), F.col("text").alias("context"), F.col("source").alias("question"))


ITEMS_SQL = """items AS (SELECT 'd-' || doc_id AS id, doc_id, lang AS category, CASE WHEN doc_id % 2 = 0 THEN 'ambig' ELSE 'disambig' END AS split, CASE WHEN n_chars % 2 = 0 THEN 'neg' ELSE 'nonneg' END AS polarity,
    CASE WHEN doc_id % 2 = 0 THEN 'unknown' WHEN doc_id % 4 = 1 THEN 'target' ELSE 'other' END AS label_role, text AS context, source AS question FROM documents)"""

_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
_LEDGER = {
    "line_no": "event_id",
    "config": "concat('m', CAST(user_id % 40 AS STRING))",
    "style": "CASE WHEN user_id % 2 = 0 THEN 'clean' ELSE 'paper' END",
    "stage": "CASE event_id % 3 WHEN 0 THEN 'smoke' WHEN 1 THEN 'pilot' ELSE 'full' END",
    "status": "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'interrupted' WHEN 'view' THEN 'ok' ELSE 'manual' END",
    "cost_tokens": "value",
    "cost_credits": f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE {_K} / CAST(10 AS DOUBLE) END",
    "samples": f"{_K} % 50",
    "output_tokens": f"CASE WHEN {_K} % 7 = 0 THEN NULL ELSE {_K} * 11 END",
    "reasoning_tokens": f"CASE WHEN user_id % 3 = 0 THEN {_K} % 5 ELSE 0 END",
    "log_file": "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('log-', CAST(event_id % 700 AS STRING)) END",
}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created")
    return table(spark, sf_dir, "events").select(*[F.expr(v).alias(k) for k, v in _LEDGER.items()], created)


def ledger_sql() -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in _LEDGER.items()).replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')").replace("AS STRING", "AS VARCHAR")
    return f"ledger AS (SELECT {cols}, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created FROM events)"


#: Panel of the six runs: run_key -> config, group, reasoning, style.
RUNS = (
    (0, "gpt-4o-mini", "anchor", "off", "clean"),
    (1, "gpt-4o-mini", "anchor", "off", "paper"),
    (2, "llama-3.1-8b-instruct", "anchor", "off", "clean"),
    (3, "modern-a", "modern", "off", "clean"),
    (4, "modern-a-low", "modern", "low", "clean"),
    (5, "modern-b", "modern", "off", "clean"),
)


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RUNS), "run_key long, config string, `group` string, reasoning string, style string")


RUNS_SQL = "runs AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{c}', '{g}', '{r}', '{s}')" for k, c, g, r, s in RUNS) + ') AS t(run_key, config, "group", reasoning, style))'
