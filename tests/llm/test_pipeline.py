"""The pipeline's stages one by one against brute force, and the registered queries."""

import re
from collections import Counter

import pytest
from compare import assert_equal, connect

import corpus_pipeline
from evalspark.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of every stage, written and read again as the driver does."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{base}/{k}")
        after = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(stages[-1][2].columns)


def test_quality_keeps_what_the_model_accepts(stages, spark, sf):
    from evalspark.llm import quality

    _, before, after = stages[0]
    scored = quality.score_documents(before, quality.train(before, spark.read.parquet(f"{sf}/labels.parquet")))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scored.where("predicted = 1").collect()}


def test_one_of_each_group_stays(stages):
    from test_near import brute

    _, before, after = stages[1]
    # the stage links at its own percent, not at op10's
    _, comp = brute({r["doc_id"]: r["text"] for r in before.collect()}, corpus_pipeline.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(comp.values()))


def test_secrets_are_masked_and_nothing_goes(stages):
    from test_texts import brute_base

    _, before, after = stages[2]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    new = {r["doc_id"]: r["text"] for r in after.collect()}
    assert old.keys() == new.keys()
    for i, t in new.items():
        assert not brute_base(t or "")
        if not brute_base(old[i] or "") and "[SECRET]" not in (t or ""):
            assert t == old[i]


def test_mix_repeats_whole_rows(stages):
    _, before, after = stages[3]
    a, b = rows(before), rows(after)
    from evalspark.llm import mixing

    assert set(b) <= set(a) and max(n / a[r] for r, n in b.items()) <= 3
    want = Counter()
    for r in mixing.mix(before).collect():
        want[r["doc_id"]] += r["epochs"] + r["picked"]
    assert Counter(r["doc_id"] for r in after.collect()) == +want
    size = lambda c: sum(n * len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r, n in c.items())
    assert 0.7 < size(b) / size(a) < 1.3


def test_packing_takes_every_document(stages):
    _, before, after = stages[4]
    assert Counter(r["doc_id"] for r in before.collect()) == Counter(r["doc_id"] for r in after.where("piece = 0").collect())


def test_run(spark, sf, stages):
    assert rows(corpus_pipeline.run(spark, sf)) == rows(stages[-1][2]) and corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql_twin(spark, sf, name):
    assert_equal(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.ORACLES])
def test_one_row_a_document(spark, sf, name):
    n = queries.QUERIES[name](spark, sf).select("doc_id").distinct().count()
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_near_dedup_links_at_80(spark, sf):
    """Planted pairs in [0.80, 0.85) lose their later document, pairs below 0.80 keep both."""
    import random

    from test_near import brute, brute_set

    rng = random.Random(8)
    texts, near = {}, 0
    for i in range(0, 600, 2):
        n = rng.choice((14, 29, 104, 204))  # 10, 25, 100, 200 shingles
        a = [f"p{i}w{k}" for k in range(n)]
        share = rng.uniform(0.76, 0.85)
        b = a[: n - round((n - 4) * (1 - share) / (1 + share))]
        b += [f"p{i}v{k}" for k in range(n - len(b))]
        texts[i], texts[i + 1] = " ".join(a), " ".join(b)
        x, y = brute_set(texts[i]), brute_set(texts[i + 1])
        near += 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y)
    _, comp = brute(texts, 80)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    after = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, sf)
    assert 100 < near < 250 and sorted(r["doc_id"] for r in after.collect()) == sorted(set(comp.values()))


def test_banding_follows_the_percent():
    """At every threshold the bands and the signature filter lose next to nothing of the pairs that lie on it."""
    from math import comb

    from evalspark.llm.minhash import VALUES, banding

    assert banding(85) == (16, 4, 42)
    for percent in (50, 70, 80, 85, 90, 95):
        p, (bands, rows, least) = percent / 100, banding(percent)
        assert bands * rows <= VALUES and (1 - p**rows) ** bands <= 1e-5
        assert sum(comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k) for k in range(least)) < 1e-4


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_hard_rows(spark, sf, docs, rows, name):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names clash: a defined result and whole rows."""
    hard = docs.unionByName(spark.createDataFrame([(None, None, None, None, None, *"abcdefg")] * 2, docs.schema))
    after = dict(corpus_pipeline.STAGES)[name](spark, hard, sf)
    got, had = after.collect(), Counter(map(tuple, hard.collect()))
    if name == "best_fit_packing":
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in hard.collect())
        return
    assert after.columns == hard.columns
    if name == "secret_scan":
        rest = lambda r: (r["doc_id"], r["source"], *tuple(r)[5:])
        assert Counter(map(rest, got)) == Counter(map(rest, hard.collect()))
    else:
        times = Counter(map(tuple, got))
        assert set(times) <= set(had) and max(n / had[r] for r, n in times.items()) <= (3 if name == "mix_sources" else 1)
    if name == "minhash_near_dedup":  # texts without words and rows without an id all stay
        assert sum(r["doc_id"] is None for r in got) == 3 and sum(not (r["text"] or "").split() and r["doc_id"] is not None for r in got) == sum(not (r[1] or "").split() and r[0] is not None for r in rows)
