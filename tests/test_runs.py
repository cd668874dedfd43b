"""Sources, sinks, replays and command line of runs, on small fixtures."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark import registry
from evalspark.cli import main
from evalspark.functions.text import iso_seconds, seconds_between, strip
from evalspark.operators import aggregate as A
from evalspark.operators import bootstrap as B
from evalspark.operators import history as H
from evalspark.operators import report as R
from evalspark.operators import sampling as S
from evalspark.operators import scoring as P
from evalspark.operators import verify as V
from evalspark.plans import adapters as T
from evalspark.sources import jsonl, reference, workbook


def write_xlsx(path):
    main_ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main_ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="TODOS" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main_ns}><si><t>tipo</t></si><si><r><t>la</t></r><r><t>bel</t></r></si><si><t>genero</t></si></sst>")
        row = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>bbq</t></is></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="B3"><v>2</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main_ns}><sheetData>{row}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    write_xlsx(tmp_path / "b.xlsx")
    df = workbook.read_sheet(spark, str(tmp_path / "b.xlsx"), "TODOS")
    assert [tuple(r) for r in df.orderBy("source_row").collect()] == [(2, "genero", None, "True"), (3, None, "2", None)] and df.columns == ["source_row", "tipo", "label", "bbq"]
    with pytest.raises(Exception, match="no sheet 'X'"):
        workbook.read_sheet(spark, str(tmp_path / "b.xlsx"), "X").collect()
    assert workbook.column_place("AB7") == 27 and workbook.sheet_names((tmp_path / "b.xlsx").read_bytes()) == {"TODOS": "xl/worksheets/sheet1.xml"} and io is not None


def test_dataset_is_written_with_its_manifest(spark, tmp_path):
    items = spark.createDataFrame([("b", "ñ"), ("a", "x")], "id string, context string")
    entry = jsonl.write_dataset(items, str(tmp_path), "one.jsonl", version="head")
    jsonl.write_dataset(items.limit(1), str(tmp_path), "two.jsonl")
    assert jsonl.write_dataset(items, str(tmp_path), "one.jsonl", version="head") == entry
    assert (tmp_path / "one.jsonl").read_text() == '{"id":"a","context":"x"}\n{"id":"b","context":"ñ"}\n'
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert list(manifest) == ["one.jsonl", "two.jsonl"] and manifest["one.jsonl"] == entry and entry["total"] == 2 and entry["version"] == "head"
    assert [r["id"] for r in jsonl.read_items(spark, str(tmp_path / "one.jsonl"), entry["sha256"], 2).collect()] == ["a", "b"]
    assert main(["data", str(tmp_path)]) == 0


@pytest.mark.parametrize("line", ['{"id": "a"', '{"context": "no id"}', "3"])
def test_items_are_strict(spark, tmp_path, line):
    (tmp_path / "x.jsonl").write_text('{"id": "z"}\n\n' + line + "\n")
    with pytest.raises(ValueError, match="not an item"):
        jsonl.read_items(spark, str(tmp_path / "x.jsonl"))


def test_ledger_errors_name_the_line(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_text('{"key": "a", "line_no": 1}\n\n[1, 2]\n"text"\n{"key": "b"}\n')
    assert [r["key"] for r in jsonl.read_ledger(spark, str(path)).collect()] == ["a", "b"]
    path.write_text('{"key": "a"}\n\n{"key": \n')
    with pytest.raises(ValueError, match="line 3 "):
        jsonl.read_ledger(spark, str(path))


def test_panel_file(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("defaults:\n  temperature: 0.5\nmodels:\n  - name: a\n    model: openrouter/x/a\n    group: modern\n    reasoning: 'off'\n")
    r = reference.load_panel_file(spark, str(tmp_path / "p.yaml")).first()
    assert (r["name"], r["price_model"], r["temperature"]) == ("a", "x/a", 0.5)
    (tmp_path / "q.yaml").write_text("models: 3\n")
    with pytest.raises(ValueError, match="no list"):
        reference.load_panel_file(spark, str(tmp_path / "q.yaml"))


def test_markdown_lookup():
    tables = reference.markdown_tables("# One\n| a | b |\n|---|---|\n| 1 | 2 |\n## Rates of runs\n| c | d |\n|---|---|\n| 3 | x |\n")
    assert reference.table_for(tables, "rates", "c") == (["c", "d"], [["3", "x"]])
    with pytest.raises(LookupError):
        reference.table_for(tables, "rates", "a")
    assert np.isnan(reference.parse_cell("abc")[0])


def test_strip_is_unicode_and_linear(spark):
    texts = ["  a b \n", "  x　", "\x1cq\x1f", "", " ", "a" + " " * 300_000 + "b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.strip() for t in texts]


def test_literal_fallback(spark):
    texts = ["{'ans0': 'a', 'ans1': 'b', 'ans2': 'c'}", r"{'ans0': '\x41', 'ans1': 'b' 'c', 'ans2': 'd'}", "{'ans0': 'a'}", "import os", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_answer_info(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [["a", "b", "c"], ["A", "bc", "d"], None, None, None]


def test_streams_of_cells_differ():
    draw = lambda *n: B.cell_generator(7, *n).random(4).tolist()
    assert draw("a", "s", "g") == draw("a", "s", "g") != draw("b", "s", "g") and draw("ab", "c") != draw("a", "bc")
    assert B._spread(np.array([1.0, np.nan, 3.0])) == pytest.approx(2**0.5) and np.isnan(B._spread(np.array([1.0])))


def test_single_bootstrap_error(spark, sf):
    scored = T.scored(spark, sf).where("run_key < 2").cache()
    want = B.bootstrap_ses(scored).where("run_key = 1 and split = 'ambig' and grp = 'all' and name = 'accuracy'").first()["se"]
    assert B.bootstrap_se(scored, 1, "ambig", "all", "accuracy") == want
    assert np.isnan(B.bootstrap_se(scored, 99, "ambig", "all", "accuracy"))
    both = B.bootstrap_ses(scored.where("split = 'ambig'").withColumn("run_key", F.explode(F.array(F.lit(1), F.lit(2)))))
    assert both.where("grp = 'all' and name = 'accuracy'").select("se").distinct().count() == 2  # equal counts, other draws
    scored.unpersist()


def test_budget_is_carried_as_spent():
    units = [{"key": k, "usd": u} for k, u in (("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0))]
    lines, stopped = H.run_units(units, {"b"}, 0.5, 3.0, lambda u: {"key": u["key"], "cost_tokens": 1.2, "cost_credits": None})
    assert [x["key"] for x in lines] == ["a"] and stopped == "c" or [x["key"] for x in lines] == ["a", "c"] and stopped == "d"
    assert H.run_units(units, set(), 0.0, 9.0, lambda u: {"cost_credits": 0.1})[1] is None


def test_cli_run_ledger_and_report(spark, sf, tmp_path, capsys):
    spark.createDataFrame([("u", 1.0), ("v", 1.5)], "key string, usd double").write.parquet(str(tmp_path / "e"))
    run = ["run", str(tmp_path / "e"), "--ledger", str(tmp_path / "l"), "--limit"]
    assert main([*run, "2"]) == 4 and main([*run, "9"]) == 0 and main([*run, "9"]) == 0
    assert [r["key"] for r in jsonl.read_ledger(spark, str(tmp_path / "l")).orderBy("line_no").collect()] == ["u", "v"]
    assert main(["ledger", str(tmp_path / "l"), "--add", "top up", "x"]) == 2
    assert main(["ledger", str(tmp_path / "l"), "--add", "top up", "0.25"]) == 0
    assert "manual/top up" in (out := capsys.readouterr().out) and "2.750000" in out
    T.scored(spark, sf).write.parquet(str(tmp_path / "s"))
    T.runs(spark).withColumns({"samples": F.lit(10), "reasoning_tokens": F.lit(20)}).write.parquet(str(tmp_path / "r"))
    assert main(["report", str(tmp_path / "s"), str(tmp_path / "R.md"), "--runs", str(tmp_path / "r"), "--ledger", str(tmp_path / "l")]) == 0
    text = (tmp_path / "R.md").read_text()
    assert [x.split(". ")[1] for x in text.splitlines() if x.startswith("## ")] == ["Summary", "Anchors", "Reasoning", "Rates", "Cost", "Design", "Commands"]


def test_results_file(spark, sf, tmp_path):
    from evalspark.plans import REGISTRY

    df = REGISTRY["results_table"][0](spark, sf)
    full = REGISTRY["results_file"][0](spark, sf)
    assert tuple(full.columns) == R.RESULT_COLUMNS and len(full.columns) == 29
    R.write_csv(full, str(tmp_path / "c"), ["run", "split", "category"])
    back = pd.read_csv(next((tmp_path / "c").glob("part-*")), dtype=str, keep_default_na=False)
    assert list(back.columns) == list(R.RESULT_COLUMNS) and len(back) == full.count() == df.count()
    assert (back["accuracy_ci_lo"].astype(float) <= back["accuracy"].astype(float) + 1e-9).all()


def test_labels_are_unique(spark):
    runs = T.runs(spark)
    assert R.check_unique(R.run_labels(runs)).count() == 6
    with pytest.raises(ValueError, match="repeats"):
        R.check_unique(R.run_labels(runs.unionByName(runs.limit(1))))


def test_oracle_rejects_values_outside_the_domain(spark):
    df = spark.createDataFrame([("target", "odd")], "label_role string, polarity string")
    role = lambda wrong: df.select(P.oracle_role(F.col("label_role"), F.col("polarity"), wrong)).first()[0]
    assert role(False) == "target" and role(True) == "other"
    with pytest.raises(Exception, match="outside its domain"):
        df.select(P.oracle_role(F.lit("unknown"), F.col("polarity"), True)).collect()
    with pytest.raises(Exception, match="outside its domain"):
        df.select(P.oracle_role(F.lit("x"), F.col("polarity"), False)).collect()


def test_model_calls(spark):
    prompts = spark.range(60).selectExpr("CAST(id AS STRING) AS id", "concat('p', id) AS prompt").coalesce(1)

    def client(prompt):
        if prompt == "p7":
            raise OSError("down")
        return prompt.upper()

    got = {r["id"]: r for r in P.call_model(prompts, client).collect()}
    assert got["3"]["completion"] == "P3" and got["7"]["error"] == "OSError: down" and got["7"]["stop_reason"] == "error"
    with pytest.raises(Exception, match="calls failed"):
        P.call_model(prompts, lambda p: 1 / 0).collect()


def test_registry():
    assert registry.names("solver") == ["model", "oracle"] and registry.resolve("scorer", "multiple_choice") is P.score_completions
    with pytest.raises(KeyError, match="no task 'x'"):
        registry.resolve("task", "x")
    with pytest.raises(ValueError, match="registered already"):
        registry.register("solver", "oracle")(lambda: None)
    with pytest.raises(ValueError, match="kind"):
        registry.register("thing")


def test_task_runs_from_its_name(spark, sf):
    samples = S.to_samples(T.items(spark, sf), shuffled=False).withColumn("run_key", F.lit(1))
    scored = registry.resolve("task", "multiple_choice")(samples)
    assert scored.agg(F.avg("correct")).first()[0] == 1.0
    assert registry.resolve("task", "multiple_choice")(samples, wrong=True).agg(F.avg("correct")).first()[0] == 0.0


def test_exact_tokens(spark):
    sys_path = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "prompt string").withColumn("k", F.lit(1))
    count = P.tokenizer_counter(sys_path.path("byte_bpe_50k.json"))
    assert [r[0] for r in df.select(count(F.col("prompt"))).collect()] == [2, 0, None]
    assert P.input_tokens(df, ["k"], 2, count).first()["input_tokens"] == 2 + 3 * 16


def test_sets_names_and_stamps(spark):
    a, b = spark.range(3), spark.range(5)
    assert V.same_members(a, b) == (False, True) and V.same_members(b, a) == (False, False) and V.same_members(a, a.union(a)) == (True, True)
    assert S.missing_names(["1", "9"], a.select(F.col("id").cast("string").alias("n")), "n") == ["9"]
    assert S.all_categories([a.withColumn("x", F.lit(1)), a.select(F.lit(2).alias("x"), "id")]).count() == 6
    t = spark.sql("SELECT timestamp'2024-01-02 03:04:05.9' AS a, timestamp'2024-01-02 03:05:05' AS b")
    assert tuple(t.select(iso_seconds(F.col("a")), seconds_between(F.col("a"), F.col("b"))).first()) == ("2024-01-02T03:04:05Z", 60)
    with pytest.raises(ValueError, match="stage 'full'"):
        H.full_stage_runs(spark.createDataFrame([("smoke", "c", "s")], "stage string, config string, style string"))


def test_sheet_sanity_reports_in_one_pass(spark):
    s = spark.createDataFrame([(1, "neg", 1), (2, None, 0)], "i int, p string, t int")
    got = {r["check"]: (r["ok"], r["detail"]) for r in A.sheet_sanity(s, {"p": ["neg"]}, ["i"], 2, {"t is 1": "t = 1"}).collect()}
    assert got == {"columns": (True, ""), "rows": (True, "2"), "values of p": (False, "null"), "t is 1": (False, "1")}
