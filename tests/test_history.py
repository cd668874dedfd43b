"""Ledger, history, panel, prices, reports, reconciliation, sources and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.functions.metrics import spend
from evalspark.operators import history as H
from evalspark.operators import report as R
from evalspark.operators import verify as V
from evalspark.sources import jsonl, reference, schemas


def test_spend(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (3.0, 1.0, 3.0), (1.5, None, 1.5), (None, None, 0.0)], "t double, c double, want double")
    assert df.where(spend(F.col("t"), F.col("c")) != F.col("want")).count() == 0


def test_money_rules(spark):
    r = spark.range(1).select(H.net_cost(F.lit(0.01), F.lit(0.04)).alias("n"), H.settle_threshold(F.lit(0.0)).alias("s"), H.interrupted_cost(F.lit(1.0), F.lit(1.043)).alias("i"), H.interrupted_cost(F.lit(1.043), F.lit(1.0)).alias("j")).first()
    assert r["n"] == 0 and r["s"] == 1e-6 and r["i"] == 0 and r["j"] == pytest.approx(0.043)
    assert H.resolve_budget(None, 1.0, 5.0) == pytest.approx(5.7) and H.resolve_budget(None, 20, 20) == 15 and H.resolve_budget(2.0, 0, 0) == 2.0


def test_history_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("k1", "a", "2024-01-01"), ("k2", "b", "2024-01-02"), ("k2", "b", "2024-01-03")], "key string, config string, created string")
    nan = F.create_map(F.lit("ambig/all/accuracy"), F.lit(float("nan")), F.lit("ambig/all/n"), F.lit(0.1234565))
    batch = rows.withColumn("metrics", nan)
    assert jsonl.append_history(spark, batch, path) == (2, 1)
    assert jsonl.append_history(spark, batch, path) == (0, 3)
    more = batch.unionByName(spark.createDataFrame([("k3", "c", "2024-01-04")], "key string, config string, created string").withColumn("metrics", nan))
    assert jsonl.append_history(spark, more, path) == (1, 3)
    back = jsonl.read_history(spark, path).orderBy("line_no").collect()
    assert [r["line_no"] for r in back] == [1, 2, 3] and back[0]["group"] == "unknown" and back[0]["style"] == "clean"
    assert back[0]["metrics"]["ambig/all/accuracy"] != back[0]["metrics"]["ambig/all/accuracy"] and back[0]["metrics"]["ambig/all/n"] == round(0.1234565, 6)


def test_latest(spark):
    df = spark.createDataFrame([("a", "1", 1, "x"), ("b", "1", 2, "y"), ("a", "2", 3, "z"), ("a", "2", 4, "w")], "k string, created string, line_no long, v string")
    got = {r["k"]: (r["v"], r["place"]) for r in H.latest_records(df, ["k"]).collect()}
    assert got == {"a": ("w", 1), "b": ("y", 2)}


def ledger(spark, *rows):
    keys = ("line_no", "config", "style", "stage", "status", "cost_tokens", "cost_credits", "samples", "output_tokens", "reasoning_tokens", "log_file")
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], "line_no long, config string, style string, stage string, status string, cost_tokens double, cost_credits double, samples long, output_tokens long, reasoning_tokens long, log_file string")


def test_two_tier_match(spark):
    led = ledger(spark, {"line_no": 1, "config": "a", "style": "clean", "status": "ok", "cost_tokens": 1.0, "log_file": "f"}, {"line_no": 2, "config": "a", "style": "clean", "status": "failed", "log_file": "f"}, {"line_no": 3, "config": "b", "style": "clean", "status": "ok", "cost_tokens": 3.0, "log_file": ""})
    logs = spark.createDataFrame([(1, "f", "a", "clean"), (2, "g", "b", "clean"), (3, "g", "c", "clean")], "i int, log_file string, config string, style string")
    got = {r["i"]: (r["matched_by"], r["line_no"], r["cost_tokens"]) for r in H.match_ledger(logs, led).collect()}
    assert got == {1: ("log_file", 2, None), 2: ("config/style", 3, 3.0), 3: ("none", None, None)}


def test_measured_tokens_and_estimates(spark):
    led = ledger(spark, {"line_no": 1, "config": "a", "style": "clean", "status": "ok", "samples": 200, "output_tokens": 1400}, {"line_no": 2, "config": "a", "style": "clean", "status": "ok", "samples": 0, "output_tokens": 9}, {"line_no": 3, "config": "b", "style": "paper", "status": "ok", "samples": 10, "output_tokens": 25})
    units = spark.createDataFrame([("a", "clean"), ("b", "clean"), ("c", "clean")], "config string, style string")
    m = H.measured_tokens(units, led)
    assert {r["config"]: r["tokens_per_sample"] for r in m.collect()} == {"a": 7.0, "b": 2.5, "c": None}
    u = m.selectExpr("*", "config AS price_model", "CASE config WHEN 'c' THEN 'low' ELSE 'off' END AS reasoning", "1L AS samples", "10000L AS input_tokens", "config AS key")
    prices = spark.createDataFrame([("a", 1e-7, 2e-7), ("b", 1e-7, 2e-7), ("c", 1e-7, 2e-7)], schemas.PRICES)
    est = {r["config"]: r for r in H.estimate_units(u, prices).collect()}
    assert est["b"]["est_output_tokens"] == 2 and est["c"]["est_output_tokens"] == 600  # half goes to even
    assert est["a"]["usd"] == pytest.approx(1e-3 + 14e-7)
    assert [r["config"] for r in H.unpriced(u, prices.where("price_model <> 'b'")).collect()] == ["b"]


def test_budget_plan_stops_at_first_excess(spark):
    est = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 10.0), ("d", 11.0)], "key string, usd double")
    done = spark.createDataFrame([("a",)], "key string")
    got = [(r["key"], r["runs"]) for r in H.budget_plan(est, done, 5.0).orderBy("place").collect()]
    assert got == [("b", True), ("c", False), ("d", False)]
    assert [r["cum_usd"] for r in H.running_cost(est).orderBy("place").collect()] == [1.0, 3.0, 13.0, 24.0]


def test_totals_and_reasoning_check(spark):
    led = ledger(spark, {"line_no": 1, "config": "a", "stage": "smoke", "status": "interrupted", "cost_tokens": 0.0, "cost_credits": 0.03}, {"line_no": 2, "config": "a", "stage": "smoke", "status": "ok", "cost_tokens": 1.0, "cost_credits": 2.0, "reasoning_tokens": 5})
    r = H.ledger_totals(led, ["config"]).first()
    assert (r["lines"], r["prepaid"], r["done"]) == (2, 0.03, True) and r["spent"] == pytest.approx(2.03) and r["credits_per_token_cost"] == pytest.approx(2.03)
    panel = spark.createDataFrame([("a", "low"), ("b", "off")], "config string, reasoning string")
    assert {x["config"]: x["verdict"] for x in H.latest_ok(led, panel).collect()} == {"a": "OK", "b": "SKIP"}


def test_panel(spark):
    good = {"name": "m-1", "model": "openrouter/x/y", "group": "modern", "reasoning": "off", "prompt_styles": ["paper", "clean", "clean"], "max_tokens": None}
    p = reference.load_panel(spark, [good])
    r = p.first()
    assert r["price_model"] == "x/y" and r["prompt_styles"] == ["clean", "paper"] and r["max_tokens"] is None and r["temperature"] == 0.75
    u = reference.panel_units(p, "smoke").orderBy("style").collect()
    assert [x["key"] for x in u] == ["smoke/m-1__clean", "smoke/m-1__paper"] and u[0]["limit_per_category"] == 3 and "panel/" in u[0]["log_dir"]
    for change in ({"group": "x"}, {"name": "a b"}, {"temperature": 3}, {"timeout": 0}, {"max_tokens": True}, {"colour": 1}, {"prompt_styles": []}):
        with pytest.raises(ValueError, match="panel entry"):
            reference.load_panel(spark, [good | change])
    with pytest.raises(ValueError, match="twice"):
        reference.load_panel(spark, [good, good])
    assert reference.select_panel(p, "m-1", "off").count() == 1 and reference.select_panel(p, reasoning="low").count() == 0
    with pytest.raises(ValueError, match="not in the panel"):
        reference.select_panel(p, "nope")


def test_prices(spark, tmp_path):
    payload = json.dumps({"data": [{"id": "a", "pricing": {"prompt": "0.1", "completion": "0.2"}}, {"id": "", "pricing": {"prompt": "1", "completion": "1"}}, {"id": "b", "pricing": {"prompt": "x", "completion": "1"}}, {"id": "c"}, {"id": "a", "pricing": {"prompt": "0.3", "completion": "0.4"}}]})
    got = reference.parse_prices(spark.createDataFrame([(payload,)], "value string")).collect()
    assert [tuple(r) for r in got] == [("a", 0.3, 0.4)]
    cache = str(tmp_path / "prices.json")
    with pytest.raises(FileNotFoundError):
        reference.load_prices(spark, cache, offline=True)
    assert reference.load_prices(spark, cache, fetch=lambda: payload).count() == 1
    assert reference.load_prices(spark, cache, offline=True).first()["price_in"] == 0.3

    def fails():
        raise OSError("no network")

    assert reference.load_prices(spark, cache, fetch=fails, refresh=True).count() == 1  # the stale cache serves
    assert reference.age_seconds("nonsense") == float("inf") and reference.age_seconds("1970-01-01T00:00:00", 60.0) == 60


def test_inflight_and_credits(tmp_path):
    m = reference.Inflight(str(tmp_path / "x.json"))
    assert m.read() is None
    m.write(key="u", before=1.0)
    assert m.read() == {"key": "u", "before": 1.0}
    (tmp_path / "x.json").write_text("{")
    assert m.read() is None
    m.clear()
    seq = iter([20.0, 20.03, 20.05, 20.05])
    assert reference.settle_credits(lambda: next(seq), 20.0, 0.01, wait=lambda s: None) == (20.05, True)
    assert reference.settle_credits(lambda: 20.0, 20.0, 0.01, tries=2, wait=lambda s: None) == (20.0, False)


def test_jsonl_sources(spark, tmp_path):
    path = str(tmp_path / "ledger.jsonl")
    assert jsonl.read_ledger(spark, path).count() == 0
    (tmp_path / "ledger.jsonl").write_text('{"config": "a"}\nnot json\n')
    with pytest.raises(ValueError, match="not json"):
        jsonl.read_ledger(spark, path)
    items = str(tmp_path / "items")
    spark.createDataFrame([("b",), ("a",)], "id string").write.json(items)
    assert [r["id"] for r in jsonl.read_items(spark, items, total=2).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="manifest says"):
        jsonl.read_items(spark, items, total=3)
    one = tmp_path / "one.jsonl"
    one.write_text('{"id": "a"}\n')
    with pytest.raises(ValueError, match="sha256"):
        jsonl.read_items(spark, str(one), sha256="0" * 64)
    (tmp_path / "manifest.json").write_text(json.dumps({"one.jsonl": {"sha256": jsonl.file_sha256(spark, str(one)).first()["sha256"], "total": 1}}))
    m = jsonl.read_manifest(spark, str(tmp_path / "manifest.json")).first()
    assert jsonl.read_items(spark, str(one), m["sha256"], m["total"]).count() == 1
    with pytest.raises(FileNotFoundError):
        jsonl.read_manifest(spark, str(tmp_path / "none.json"))


def test_reconcile(spark):
    nan = float("nan")
    a = spark.createDataFrame([("x", 1.0), ("y", nan), ("z", 2.0), ("only", 1.0), ("k", 5.0)], "key string, value double")
    b = spark.createDataFrame([("x", 1.0004), ("y", nan), ("z", 2.1), ("gone", 1.0), ("k", 4.0)], "key string, value double")
    r = V.reconcile(a, b, ["key"], 0.0005)
    assert {x["key"]: x["status"] for x in r.collect()} == {"x": "match", "y": "match", "z": "differs", "only": "extra", "gone": "missing", "k": "differs"}
    e = spark.createDataFrame([("k", 5.0), ("z", 9.0)], "key string, pinned double")
    assert {x["key"] for x in V.excuse(r, e, ["key"], 0.0005).where("status = 'known'").collect()} == {"k"}
    assert V.worst_deviation(r, ["key"]).first()["at"] == "k"


def test_report(spark):
    df = spark.createDataFrame([("a", 0.5, float("nan"))], "config string, x double, y double")
    text = R.build_report([("Summary", df)])
    assert text == "## 1. Summary\n\n| config | x | y |\n|---|---|---|\n| a | 0.500 | — |\n"
    assert reference.markdown_tables(text) == [("1. Summary", ["config", "x", "y"], [["a", "0.500", "—"]])]
    v, se, marked = reference.parse_cell("0.159 ± 0.011 *")
    assert (v, se, marked) == (0.159, 0.011, True) and reference.parse_cell("—")[0] != reference.parse_cell("—")[0]
    cells = spark.createDataFrame([(0.1, 0.5, 0.4), (0.4, 0.01, 0.4), (0.0, 0.1, 0.0)], "ft_minus_fo double, se double, bias_score double")
    assert [r["cell"].endswith("*") for r in R.mark_signs(cells).collect()] == [True, False, False]


def test_stream_scores_once(spark, tmp_path):
    from evalspark.streaming.append import append_scored, stream_scored

    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    row = lambda i: ("r", i, "RESPUESTA: C", "stop")
    comp = spark.createDataFrame([row("a"), row("b"), row("a")], "run_key string, id string, completion string, stop_reason string").withColumn("created", F.to_timestamp(F.lit("2024-01-01")))
    comp.write.parquet(src)
    samples = spark.createDataFrame([(i, "x", "ambig", ["u", "v", "w"], ["target", "other", "unknown"], "unknown", "neg") for i in "ab"], "id string, category string, split string, choices array<string>, roles array<string>, label_role string, polarity string")
    for _ in range(2):
        append_scored(stream_scored(spark, src, samples), out, chk).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b"] and got.where("correct = 1").count() == 2
