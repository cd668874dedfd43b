"""Conversion, roles, stratified top-k, permutation, prompts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.domain import check_task
from evalspark.operators import aggregate as A
from evalspark.operators import sampling as S
from evalspark.operators.scoring import build_prompt

INFO = "{'ans0': ' uno ', 'ans1': 'dos', 'ans2': 'No se sabe'}"


def raw(spark, *changes):
    base = {"category": "genero", "language": "es", "source_row": 1, "context_condition": "ambig", "question_polarity": " neg ", "context": " c ", "question": "q", "answer_info": INFO, "target": "1", "other": "0", "label": "2", "bbq": "False"}
    return spark.createDataFrame([base | {"source_row": i + 1} | c for i, c in enumerate(changes)], "category string, language string, source_row int, context_condition string, question_polarity string, context string, question string, answer_info string, target string, other string, label string, bbq string")


def test_conversion(spark):
    out = S.convert_items(raw(spark, {}, {"bbq": "1"}, {"category": "racismo"}, {}), "No se sabe", drop_bbq=True).orderBy("source_row").collect()
    assert [r["id"] for r in out] == ["genero-es-0001", "racismo-es-0001", "genero-es-0002"]
    assert [(o["text"], o["role"]) for o in out[0]["options"]] == [("uno", "other"), ("dos", "target"), ("No se sabe", "unknown")]
    assert out[0]["label_role"] == "unknown" and out[0]["context"] == "c" and all(r["fault"] is None for r in out)


def test_conversion_faults(spark):
    bad = [
        ({"context": "  "}, "context"), ({"answer_info": "{'ans0': 'x'}"}, "answer_info"), ({"target": "0"}, "target/other"), ({"other": "3"}, "target/other"), ({"label": "1.0"}, "label"),
        ({"bbq": "maybe"}, "bbq"), ({"label": "1"}, "label/condition"), ({"context_condition": "disambig"}, "label/condition"), ({"answer_info": INFO.replace("No se", "Si se")}, "unknown text"),
    ]
    out = S.convert_items(raw(spark, *[b for b, _ in bad]), "No se sabe").orderBy("source_row").collect()
    assert [r["fault"] for r in out] == [w for _, w in bad]


@pytest.mark.parametrize("k, cells", [(4, [1, 1, 1, 1]), (6, [1, 1, 2, 2]), (100, [3, 3, 3, 3])])
def test_stratified_cells(spark, k, cells):
    rows = [(f"{c}-{s}-{p}-{i}", c, s, p) for c in "abcd" for s in ("ambig", "disambig") for p in ("neg", "nonneg") for i in range(3)]
    got = S.stratified_top_k(spark.createDataFrame(rows, "id string, category string, split string, polarity string"), k).collect()
    for c in "abcd":
        assert sorted(Counter((r["split"], r["polarity"]) for r in got if r["category"] == c).values()) == cells


def test_permutation_and_samples(spark):
    options = [{"text": t, "role": r} for t, r in (("uno", "target"), ("dos", "other"), ("tres", "unknown"))]
    items = spark.createDataFrame([(f"i{k}", "x", "ambig", "c", "q", options, "unknown") for k in range(600)], "id string, category string, split string, context string, question string, options array<struct<text:string,role:string>>, label_role string")
    for native in (False, True):
        s = S.to_samples(S.permute_options(items, native=native))
        assert s.where("roles[ascii(target) - 65] <> 'unknown' OR choices[array_position(roles, 'target') - 1] <> 'uno'").count() == 0
        assert A.unknown_balance(s).where("NOT share BETWEEN 0.25 AND 0.42").count() == 0
    assert S.seeded_order("i1") == S.seeded_order("i1") and sorted(S.seeded_order("x")) == [0, 1, 2]
    assert S.role_faults(items).count() == 0
    first = S.to_samples(items, shuffled=False).first()
    assert first["input"] == "c\n\nq" and first["target"] == "C" and first["category_split"] == "x/ambig"


def test_prompts_fill_in_one_pass(spark):
    df = spark.createDataFrame([("{question} 100%", "{a}", ["{b}", "x", "__option0__"])], "context string, question string, choices array<string>")
    p = build_prompt(df, "clean", "en").first()["prompt"]
    assert "Context: {question} 100%\n\nQuestion: {a}\n\nA) {b}\nB) x\nC) __option0__\n" in p
    r = build_prompt(df, "paper").first()
    assert r["prompt"].startswith("\n##context\n{question} 100%\n##question\n{a}\n") and r["prompt"].endswith("Option 2: __option0__\n") and "##options" in r["system"]


def test_task_parameters():
    assert check_task("clean", "head", "en", 0.75, 10, None, None) and not check_task("paper", "paper", "es", 0, None, None, None)
    for bad in (("paper", "paper", "es", 0, None, None, True), ("clean", "paper", "en", 0, None, None, None), ("clean", "head", "es", 2.1, None, None, None), ("clean", "head", "es", 1, 0, None, None), ("x", "head", "es", 1, None, None, None)):
        with pytest.raises(ValueError):
            check_task(*bad)


def test_duplicates_and_manifest(spark):
    df = spark.createDataFrame([("1", "a", "s", "t"), ("1", "a", "s", "t"), ("2", "a", "s", "t")], "id string, category string, split string, context string")
    assert tuple(A.duplicates(df, "id", ["category", "context"]).first()) == (1, 2)
    m = {(r["kind"], r["name"]): r["n"] for r in A.manifest_counts(df, ["a", "b"], ["s"]).collect()}
    assert m == {("category", "a"): 3, ("category", "b"): 0, ("split", "s"): 3, ("category/split", "a/s"): 3}


def test_unpivot(spark):
    s = spark.createDataFrame([(1, "0", "Rev"), (2, "2.0", None), (3, "7", "1")], "i int, a string, b string")
    got = {(r["i"], r["model"]): r["choice"] for r in A.unpivot_sheet(s, ["i"], ["a", "b"], strict=False).collect()}
    with pytest.raises(Exception, match="not an answer: 7"):
        A.unpivot_sheet(s, ["i"], ["a", "b"]).collect()
    assert A.unpivot_sheet(s.where("i < 3").withColumn("a", F.lit("NaN")), ["i"], ["a", "b"]).where("choice is not null").count() == 0
    assert got == {(1, "a"): 0, (1, "b"): None, (2, "a"): 2, (2, "b"): None, (3, "a"): None, (3, "b"): 1}
    assert s.select(F.lit(1)).count() == 3
