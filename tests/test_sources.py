"""Line-numbered scans, streamed digests and sheets, panels with free-form settings, model calls side by side, folding."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evalspark.functions.text import casefold
from evalspark.operators import scoring as P
from evalspark.sources import jsonl, reference, workbook


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, "2000")
    yield
    spark.conf.set(name, was)


@pytest.mark.parametrize("most", [0, 100_000])
def test_lines_are_numbered_over_many_splits(spark, tmp_path, small_splits, monkeypatch, most):
    monkeypatch.setattr(jsonl, "BROADCAST_SPLITS", most)
    text = {"a": "".join(f"line {i} {'x' * (i % 90)}\n" + "\n" * (i % 7 == 0) for i in range(800)), "b": "only\r\none", "c": ""}
    for n, t in text.items():
        (tmp_path / n).write_bytes(t.encode())
    df = jsonl.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {n: [] for n in text}
    for r in df.collect():
        got[r["file"].rpartition("/")[2]].append((r["line_no"], r["line"]))
    assert {n: sorted(x) for n, x in got.items()} == {n: list(enumerate(t.splitlines(), 1)) for n, t in text.items()}


def test_a_bad_line_of_a_large_ledger_has_its_number(spark, tmp_path, small_splits):
    path = tmp_path / "ledger.jsonl"
    lines = [json.dumps({"key": f"k{i}", "status": "ok", "note": "n" * (i % 60)}) for i in range(900)]
    path.write_text("\n".join(lines))
    assert jsonl.read_ledger(spark, str(path)).count() == 900
    lines[700:701] = ["", "no json"]
    path.write_text("\n".join(lines))
    with pytest.raises(ValueError, match="line 702 is no JSON: no json"):
        jsonl.read_ledger(spark, str(path))


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file; its digest is that of the same bytes chunk by chunk."""
    big, size = tmp_path / "big file.bin", (2 << 30) + 12345
    with big.open("wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    (tmp_path / "small").write_bytes(b"small")
    want, chunk = hashlib.sha256(), bytes(1 << 24)
    for _ in range((size - 3) >> 24):
        want.update(chunk)
    want.update(bytes((size - 3) % (1 << 24)) + b"end")
    got = {r["path"].rpartition("/")[2]: r["sha256"] for r in jsonl.file_sha256(spark, str(tmp_path)).collect()}
    assert sorted(got.values()) == sorted([want.hexdigest(), hashlib.sha256(b"small").hexdigest()])


def test_digest_where_only_spark_reads(spark, tmp_path):
    (tmp_path / "x[1]").write_bytes(b"abc")
    spark.conf.set("fs.viewfs.mounttable.t.link./in", f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./in", f"file://{tmp_path}")
    assert jsonl.file_sha256(spark, "viewfs://t/in").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def big_workbook(path, rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>n</t></is></c><c r="B1" t="inlineStr"><is><t>wide</t></is></c></row>'.encode())
            for i in range(rows):
                f.write(f'<row><c r="A{i + 2}"><v>{i}</v></c><c r="B{i + 2}" t="inlineStr"><is><t>{"w" * 40}</t></is></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return path.read_bytes()


def test_a_sheet_is_read_as_a_stream(spark, tmp_path):
    import tracemalloc

    raw, most = big_workbook(tmp_path / "b.xlsx", 60_000), []
    for sheet_columns in (None, lambda head: {0}):
        tracemalloc.start()
        n = sum(1 for _ in workbook.sheet_rows(raw, "S", sheet_columns))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == 60_001
    assert max(most) < 3 << 20  # the sheet's XML alone is six megabytes
    df = workbook.read_sheet(spark, str(tmp_path / "b.xlsx"), "S", ["n"])
    assert df.columns == ["source_row", "n"]
    assert tuple(df.selectExpr("count(*)", "min(source_row)", "max(source_row)", "sum(cast(n AS long))").first()) == (60_000, 2, 60_001, 60_000 * 59_999 // 2)
    assert workbook.read_sheet(spark, str(tmp_path / "b.xlsx"), "S").where("length(wide) = 40").count() == 60_000
    with pytest.raises(ValueError, match="lacks the columns"):
        workbook.read_sheet(spark, str(tmp_path / "b.xlsx"), "S", ["n", "none"])


PANEL = {
    "defaults": {"temperature": 0.5, "max_tokens": 100, "attempt_timeout": 30},
    "configs": [
        {"name": "a", "model": "openrouter/x/a", "group": "anchor", "reasoning": "off", "prompt_styles": "paper", "note": "n"},
        {"name": "b-low", "model": "openrouter/x/b", "group": "modern", "reasoning": "low", "model_args": {"reasoning_enabled": False, "provider": {"order": ["p", "q"], "quantizations": None}},
         "generate": {"max_tokens": None, "temperature": 1, "reasoning_effort": "low", "extra": {"top": [1, 2.5, True]}}, "timeout": 9},
    ],
}


def test_published_panel_format(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(PANEL))
    panel = reference.load_panel_file(spark, str(path))
    a, b = panel.orderBy("name").collect()
    assert (a["temperature"], a["max_tokens"], a["timeout"], a["attempt_timeout"], a["prompt_styles"], a["price_model"]) == (0.5, 100, 600, 30, ["paper"], "x/a")
    assert (b["temperature"], b["max_tokens"], b["timeout"]) == (1.0, None, 9) and b["prompt_styles"] == ["clean"]
    # nested values survive and can be filtered; what was lifted out of generate is gone from it
    assert b["model_args"].toPython() == PANEL["configs"][1]["model_args"] and b["generate"].toPython() == {"reasoning_effort": "low", "extra": {"top": [1, 2.5, True]}}
    assert a["generate"].toPython() == {}
    pick = panel.where("variant_get(model_args, '$.provider.order[1]', 'string') = 'q' AND try_variant_get(generate, '$.extra.top[2]', 'boolean')")
    assert [r["name"] for r in pick.collect()] == ["b-low"]
    panel.write.parquet(str(tmp_path / "panel"))
    assert spark.read.parquet(str(tmp_path / "panel")).where("variant_get(model_args, '$.reasoning_enabled', 'boolean') = false").count() == 1


@pytest.mark.parametrize("change", [{"model": "no-provider"}, {"model": None}, {"model_args": [1]}, {"generate": {"temperature": 5}}, {"generate": {"max_tokens": 0}}, {"attempt_timeout": True}, {"note": 3}, {"price_model": 4}, {"prompt_styles": "none"}])
def test_panel_faults_name_the_entry(spark, change):
    with pytest.raises(ValueError, match="panel entry 'b-low'"):
        reference.load_panel(spark, [PANEL["configs"][1] | change])


def test_panel_file_faults(spark, tmp_path):
    for k, (raw, message) in enumerate([({"configs": []}, "no list"), ({"configs": PANEL["configs"], "more": 1}, "unknown fields"), ({"defaults": {"note": "x"}, "configs": PANEL["configs"]}, "panel defaults"), (3, "no list")]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(raw))
        with pytest.raises(ValueError, match=message):
            reference.load_panel_file(spark, str(path))


def test_calls_go_side_by_side_and_are_tried_again(spark):
    """Sixteen at once and no more; 429s wait as asked and pass; calls without an answer in time are recorded."""
    prompts = spark.range(100).selectExpr("CAST(id AS STRING) AS id", "concat('p', id) AS prompt").coalesce(1)

    def client(prompt):
        import threading
        import time

        state = client.__dict__.setdefault("state", {"now": 0, "most": 0, "seen": {}, "lock": threading.Lock()})
        with state["lock"]:
            state["now"] += prompt != "p9"  # its threads go on when the call has been given up
            state["most"] = max(state["most"], state["now"])
            tries = state["seen"][prompt] = state["seen"].get(prompt, 0) + 1
        try:
            if prompt in ("p5", "p6") and tries == 1:
                raise P.RateLimited("429", after=0.05)
            time.sleep(1.5 if prompt == "p9" else 0.02)
            return f"{state['most']}"
        finally:
            with state["lock"]:
                state["now"] -= prompt != "p9"

    how = P.Calls(timeout=0.5, retries=2, pause=0.01)
    got = {r["id"]: r for r in P.call_model(prompts, client, calls=how).collect()}
    assert len(got) == 100 and max(int(r["completion"]) for r in got.values() if r["completion"]) == 16
    assert (got["5"]["tries"], got["6"]["tries"], got["1"]["tries"]) == (2, 2, 1) and got["5"]["error"] is None
    assert got["9"]["completion"] is None and got["9"]["error"].startswith("TimeoutError") and got["9"]["tries"] == 2 and got["9"]["stop_reason"] == "error"


def test_coroutine_clients_and_rates():
    import asyncio
    import time

    async def client(prompt):
        await asyncio.sleep(0.01)
        return prompt * 2

    begun = time.monotonic()
    out = asyncio.run(P.Calls(per_second=50).all(client, [str(i) for i in range(20)]))
    assert [o[0] for o in out] == [str(i) * 2 for i in range(20)] and time.monotonic() - begun >= 0.35


def test_full_case_folding(spark):
    """Every character as Python folds it, but for Cherokee (and letters that this Python does not know yet)."""
    import unicodedata

    odd = lambda c: 0x13A0 <= c <= 0x13FD or 0xAB70 <= c <= 0xABBF or 0xD800 <= c <= 0xDFFF or c == 0xE131 or unicodedata.category(chr(c)) == "Cn"
    texts = [chr(c) for c in range(1, 0x1F000) if not odd(c)] + ["ΟΔΟΣ ΣΑΣ Straße", "ẞ ﬁnd ﬀ ŉ", "Iıİi", "ÑANDÚ ÉL", ""]
    df = spark.createDataFrame([(t, t.casefold()) for t in texts], "t string, want string")
    assert [(r["t"], r["got"], r["want"]) for r in df.withColumn("got", casefold(F.col("t"))).where("got <> want").collect()] == []


def test_published_manifest(spark, tmp_path):
    """Layout, order of fields, zeros, repeats; entries of other files stay; both layouts are read."""
    rows = [("b", "genero", "ambig", "c1", "q"), ("a", "genero", "disambig", "c2", "q"), ("a", "racismo", "ambig", "c1", "q")]
    items = spark.createDataFrame(rows, "id string, category string, context_condition string, context string, question string")
    entry = jsonl.publish_dataset(items, str(tmp_path), "paper_es.jsonl", "paper", "es", "c0ffee")
    jsonl.publish_dataset(items.limit(0), str(tmp_path), "head_en.jsonl", "head", "en", "abc")
    assert jsonl.publish_dataset(items, str(tmp_path), "paper_es.jsonl", "paper", "es", "c0ffee") == entry
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert list(m) == ["converter_version", "files"] and list(m["files"]) == ["head_en.jsonl", "paper_es.jsonl"] and m["files"]["paper_es.jsonl"] == entry
    assert list(entry) == ["dataset_version", "language", "commit", "file", "converter_version", "total", "categories", "splits", "category_splits", "duplicate_ids", "duplicate_prompts", "sha256"]
    assert (entry["total"], entry["categories"], entry["splits"]) == (3, {"racismo": 1, "genero": 2, "clasismo": 0, "xenofobia": 0}, {"ambig": 2, "disambig": 1})
    assert entry["category_splits"] == {"genero/ambig": 1, "genero/disambig": 1, "racismo/ambig": 1} and (entry["duplicate_ids"], entry["duplicate_prompts"]) == (1, 1)
    assert m["files"]["head_en.jsonl"]["total"] == 0 and set(m["files"]["head_en.jsonl"]["categories"].values()) == {0}
    assert entry["sha256"] == hashlib.sha256((tmp_path / "paper_es.jsonl").read_bytes()).hexdigest()
    got = {r["name"]: r for r in jsonl.read_manifest(spark, str(tmp_path / "manifest.json")).collect()}
    assert got["paper_es.jsonl"]["categories"]["genero"] == 2 and got["paper_es.jsonl"]["commit"] == "c0ffee" and got["head_en.jsonl"]["total"] == 0
    with pytest.raises(ValueError, match="known categories"):
        jsonl.publish_dataset(items.withColumn("category", F.lit("other")), str(tmp_path), "x.jsonl", "paper", "es", "c")
