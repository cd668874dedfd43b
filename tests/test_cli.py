import json

from evalspark.cli import main
from evalspark.sources import jsonl


def test_cli(spark, tmp_path, capsys):
    assert main(["queries"]) == 0 and "summarize_wide" in capsys.readouterr().out
    m = spark.createDataFrame([("r", "ambig", "all", "accuracy", 0.5)], "run_key string, split string, grp string, name string, value double")
    m.write.parquet(str(tmp_path / "a"))
    m.selectExpr("run_key", "split", "grp", "name", "value + 0.01 AS value").write.parquet(str(tmp_path / "b"))
    assert main(["verify", str(tmp_path / "a"), str(tmp_path / "a")]) == 0
    assert main(["verify", str(tmp_path / "a"), str(tmp_path / "b")]) == 1
    assert main(["data", str(tmp_path)]) == 3
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n')
    sha = jsonl.file_sha256(spark, str(tmp_path / "x.jsonl")).first()["sha256"]
    (tmp_path / "manifest.json").write_text(json.dumps({"x.jsonl": {"sha256": sha, "total": 1}}))
    assert main(["data", str(tmp_path)]) == 0
    (tmp_path / "x.jsonl").write_text('{"id": "b"}\n')
    assert main(["data", str(tmp_path)]) == 1
    spark.createDataFrame([("u", 1.0)], "key string, usd double").write.parquet(str(tmp_path / "e"))
    assert main(["plan", str(tmp_path / "e"), "--ledger", str(tmp_path / "none"), "--limit", "2"]) == 0
