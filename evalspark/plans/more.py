"""Further registered queries: paths, errors, set operations, source grids, SQL functions, conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import COUNTED, LANGUAGES, VERSIONS
from ..functions import metrics as M
from ..functions.tables import register_table_functions
from ..functions.text import config_and_style, mentions, path_part
from ..operators import recovery as V
from ..operators import sampling as S
from ..operators import scoring as P
from ..runtime import scratch_folder
from ..sources.commits import KeyedTable
from . import adapters as T
from .queries import _wide, query
from .sql import metrics_sql

_PATHS = "paths AS (SELECT line_no, 'logs/' || stage || '/' || CASE stage WHEN 'smoke' THEN 'panel/' ELSE '' END || config || CASE WHEN line_no % 4 = 0 THEN '' ELSE '__x__' || style END || '/' || CAST(line_no AS VARCHAR) || '.log' AS path FROM ledger)"


@query(f"WITH {T.ledger_sql()}, {_PATHS}, u AS (SELECT line_no, split_part(path, '/', -1) AS file, split_part(path, '/', -2) AS unit, split_part(path, '/', 2) AS stage FROM paths) SELECT line_no, file, stage, CASE WHEN contains(unit, '__') THEN regexp_extract(unit, '^(.*)__(.*)$', 1) ELSE unit END AS config, CASE WHEN contains(unit, '__') THEN regexp_extract(unit, '^(.*)__(.*)$', 2) ELSE 'clean' END AS style FROM u")
def log_paths(spark, sf):
    p = T.ledger(spark, sf).selectExpr("line_no", "concat('logs/', stage, '/', CASE stage WHEN 'smoke' THEN 'panel/' ELSE '' END, config, CASE WHEN line_no % 4 = 0 THEN '' ELSE concat('__x__', style) END, '/', CAST(line_no AS STRING), '.log') AS path")
    config, style = config_and_style(path_part(F.col("path"), 2))
    return p.select("line_no", path_part(F.col("path"), 1).alias("file"), F.get(F.split("path", "/"), F.lit(1)).alias("stage"), config.alias("config"), style.alias("style"))


@query("SELECT conv_id, turn, contains(lower(left(text, 2000)), 'tion') AS mentioned, left(text, 2000) AS error FROM conversations")
def error_scan(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", mentions(F.col("text"), "TION").alias("mentioned"), F.left("text", F.lit(2000)).alias("error"))


@query("WITH g AS (SELECT v.x AS version, l.x AS language FROM (VALUES ('paper'), ('head')) v(x), (VALUES ('es'), ('en'), ('xx')) l(x)), have AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'paper' ELSE 'head' END AS version, lang AS language FROM documents) SELECT g.*, EXISTS (SELECT 1 FROM have h WHERE h.version = g.version AND h.language = g.language) AS available FROM g")
def source_pairs(spark, sf):
    have = T.table(spark, sf, "documents").selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'paper' ELSE 'head' END AS version", "lang AS language")
    return S.source_pairs(have, VERSIONS, (*LANGUAGES, "xx"))


@query(f"WITH {T.ledger_sql()}, a AS (SELECT DISTINCT config FROM ledger WHERE stage = 'smoke' AND status = 'failed'), b AS (SELECT DISTINCT config FROM ledger WHERE stage = 'full' AND status = 'ok') SELECT config, config IN (SELECT config FROM a) AS left_side, config IN (SELECT config FROM b) AS right_side FROM (SELECT config FROM a UNION SELECT config FROM b)")
def config_sets(spark, sf):
    led = T.ledger(spark, sf)
    side = lambda where, name: led.where(where).select("config").distinct().withColumn(name, F.lit(True))
    both = side("stage = 'smoke' AND status = 'failed'", "left_side").join(side("stage = 'full' AND status = 'ok'", "right_side"), "config", "full_outer")
    return both.select("config", F.coalesce("left_side", F.lit(False)).alias("left_side"), F.coalesce("right_side", F.lit(False)).alias("right_side"))


@query(f"WITH {T.ledger_sql()} SELECT DISTINCT config, style FROM ledger")
def distinct_configs(spark, sf):
    return T.ledger(spark, sf).select("config", "style").distinct()


@query(f"WITH {metrics_sql()} SELECT run_key, split, grp, (CASE WHEN abs(ft - fo) <= 1e-12 THEN 1.0::DOUBLE WHEN ft - fo > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * sqrt((1 - accuracy) * (1 - accuracy) + (ft - fo) * (ft - fo)) + 0.0::DOUBLE AS bias, coalesce(ft - fo <> 0 AND abs(ft - fo) > 1.96::DOUBLE * 0.01::DOUBLE, false) AS decided FROM wide")
def sql_functions(spark, sf):
    M.register_sql_functions(spark)
    return _wide(spark, sf).selectExpr("run_key", "split", "grp", "eval_bias_score(accuracy, ft, fo, 1) AS bias", "eval_sign_decided(ft - fo, 0.01D) AS decided")


@query(f"WITH {metrics_sql()} SELECT * FROM long")
def summarize_table(spark, sf):
    """The long metrics by SQL alone: counts where the rows lie, then one task a run for its few groups."""
    register_table_functions(spark)
    T.scored(spark, sf).select("run_key", "split", "category", *COUNTED).createOrReplaceTempView("scored_rows")
    return spark.sql("SELECT CAST(run_key AS BIGINT) AS run_key, split, grp, name, value FROM eval_summarize(TABLE(SELECT * FROM eval_counts(TABLE(scored_rows))), tie_sign => 1)")


_BAD_POLARITY = "CASE WHEN id % 40 = 0 THEN 'odd' ELSE polarity END"
_BAD_LABEL = "CASE WHEN id % 60 = 0 THEN NULL ELSE label_role END"


@query(f"WITH {T.scored_sql()} SELECT id, {_BAD_POLARITY} AS polarity, {_BAD_LABEL} AS label_role FROM raw WHERE id % 40 = 0 OR id % 60 = 0")
def scoring_faults(spark, sf):
    """Every fortieth row has no known polarity, every sixtieth no label."""
    broken = T.outcomes(spark, sf).withColumns({"polarity": F.expr(_BAD_POLARITY), "label_role": F.expr(_BAD_LABEL)})
    return P.scoring_faults(broken).select("id", "polarity", "label_role")


_RAW = "raw AS (SELECT lang AS category, doc_id AS source_row, CASE WHEN doc_id % 2 = 0 THEN 'ambig' ELSE 'disambig' END AS context_condition, CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE ' neg ' END AS question_polarity, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE ' c' || doc_id END AS context, CAST(doc_id % 4 AS VARCHAR) AS target, CAST(doc_id % 3 AS VARCHAR) AS other, CASE WHEN doc_id % 7 = 0 THEN '1.0' ELSE CAST(doc_id % 3 AS VARCHAR) END AS label, CASE WHEN doc_id % 5 = 0 THEN 'True' ELSE '0' END AS bbq FROM documents)"


@query(f"""WITH {_RAW}, kept AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY source_row) AS pos, source_row % 4 AS t, source_row % 3 AS o, CASE WHEN label = '1.0' THEN NULL ELSE source_row % 3 END AS l FROM raw WHERE bbq <> 'True'),
    r AS (SELECT *, t BETWEEN 0 AND 2 AND t <> o AS ok, CASE WHEN l = t THEN 'target' WHEN l = o THEN 'other' ELSE 'unknown' END AS role FROM kept)
    SELECT format('{{}}-es-{{:04d}}', category, pos) AS id, source_row, trim(context) AS context, trim(question_polarity) AS question_polarity,
    CASE WHEN trim(context) = '' THEN 'context' WHEN NOT ok THEN 'target/other' WHEN l IS NULL THEN 'label' WHEN trim(question_polarity) <> 'neg' THEN 'question_polarity'
    WHEN 3 - t - o <> 2 THEN 'unknown text' WHEN (context_condition = 'ambig') <> (role = 'unknown') THEN 'label/condition' END AS fault FROM r""")
def convert_items(spark, sf):
    spark_sql = _RAW.removeprefix("raw AS (").removesuffix(")").replace("AS VARCHAR", "AS STRING").replace("' c' || doc_id", "concat(' c', doc_id)")
    T.table(spark, sf, "documents").createOrReplaceTempView("_convert_documents")
    raw = spark.sql(spark_sql.replace("FROM documents", "FROM _convert_documents"))
    info = "{'ans0': ' uno', 'ans1': 'dos', 'ans2': 'No se sabe'}"
    raw = raw.withColumns({"language": F.lit("es"), "question": F.lit("q"), "answer_info": F.lit(info)})
    return S.convert_items(raw, "No se sabe", drop_bbq=True).select("id", "source_row", "context", "question_polarity", "fault")


_KEYED = "rows AS (SELECT stage || '-' || (line_no % 1000) AS key, config, line_no AS event, status = 'failed' AS early FROM ledger)"


@query(f"""WITH {T.ledger_sql()}, {_KEYED}, a AS (SELECT key, min(event) AS event, 0 AS batch FROM rows WHERE early GROUP BY key),
    b AS (SELECT * FROM a UNION ALL SELECT key, min(event), 1 FROM rows WHERE key NOT IN (SELECT key FROM a) GROUP BY key)
    SELECT row_number() OVER (ORDER BY batch, b.event) AS line_no, b.key, config, b.event FROM b JOIN rows USING (key, event)""")
def keyed_append(spark, sf):
    """Failed lines first, then all lines, each batch twice, into a table that holds a key once."""
    rows = T.ledger(spark, sf).selectExpr("concat(stage, '-', CAST(line_no % 1000 AS STRING)) AS key", "config", "line_no AS event", "status")
    table = KeyedTable(spark, scratch_folder(spark, "keyed"), "key string, config string, event long", ["key"], "event", "parquet")
    for number, batch in enumerate((rows.where("status = 'failed'"), rows)):
        for _ in range(2):
            table.append(batch, "query", number)
    table.append(rows)
    return table.read()


@query(f"""WITH {T.ledger_sql()} SELECT 'a' || line_no AS attempt, status, samples, cost_tokens, cost_credits FROM ledger WHERE line_no % 7 <> 3
    UNION ALL SELECT 'a' || line_no, 'interrupted', 0, 0, round_even(greatest(cost_tokens + coalesce(cost_credits, 0) - cost_tokens, 0), 8) FROM ledger WHERE line_no % 7 = 3""")
def recovered_ledger(spark, sf):
    """Every seventh attempt was killed before its line was written, another seventh after it; all of these left markers,
    some twice. Recovery runs twice, and so does the writer of the lines."""
    led = T.ledger(spark, sf).withColumn("attempt", F.concat(F.lit("a"), "line_no")).withColumn("key", F.concat_ws("/", "stage", "config"))
    table = V.ledger_table(spark, scratch_folder(spark, "ledger"))
    written = led.where("line_no % 7 <> 3")
    table.append(written, "writer", 0)
    left = led.where("line_no % 7 IN (3, 4)").selectExpr("attempt", "key", "config", "style", "stage", "created", "cost_tokens AS credits_before", "cost_tokens + coalesce(cost_credits, 0) AS credits_now", "line_no")
    markers = left.drop("line_no").unionByName(left.where("line_no % 2 = 0").withColumn("created", F.concat("created", F.lit("+"))).drop("line_no"))
    for _ in range(2):
        table.append(V.interrupted_lines(markers, table.read()))
    table.append(written)
    return table.read().select("attempt", "status", "samples", "cost_tokens", "cost_credits")


_ORDERS = "(VALUES (0, 'C'), (1, 'B'), (2, 'C'), (3, 'B'), (4, 'A'), (5, 'A')) o(k, letter)"


@query(f"""WITH {T.ITEMS_SQL}, k AS (SELECT ('0x' || substr(sha256(id), 1, 8))::BIGINT % 6 AS k FROM items)
    SELECT letter, count(*) AS n FROM k JOIN {_ORDERS} USING (k) GROUP BY letter""")
def native_balance(spark, sf):
    """Where the option 'unknown' stands after the permutation that needs no Python."""
    samples = S.to_samples(S.permute_options(T.items(spark, sf), native=True))
    place = F.array_position("roles", "unknown").cast("int") - 1
    return samples.groupBy(F.get(F.array(*map(F.lit, "ABC")), place).alias("letter")).agg(F.count("*").alias("n"))
