"""Trees learn, score arrays agree with walking, held-out accuracy, labels stay outside."""

import zlib

import numpy as np
import pytest

from evalspark.llm import quality


def test_fit_learns_a_rule_and_is_deterministic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] < 0.3)).astype(float)
    m = quality.fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97
    again = quality.fit(x[:1500], y[:1500])
    assert np.array_equal(m.value, again.value) and np.array_equal(m.threshold, again.threshold)


def test_flattened_score_equals_walking():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 3)), (rng.random(500) > 0.5).astype(float)
    m = quality.fit(x, y, trees=5, depth=3)
    for row, s in zip(x[:20], m.score(x[:20]), strict=True):
        raw = m.prior
        for f, t, v in zip(m.feature, m.threshold, m.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            raw += v[node - len(f)]
        assert s == pytest.approx(1 / (1 + np.exp(-raw)))


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_degenerate_training(y):
    x = np.zeros((len(y), len(quality.FEATURES)))
    s = quality.fit(x, np.array(y)).score(np.zeros((2, len(quality.FEATURES))))
    assert ((s >= 0) & (s <= 1)).all()


@pytest.mark.parametrize("text", [None, "", " ", "a", "word " * 50000, "\ud800 lone", "x" * 10**6])
def test_statistics(text):
    v = quality.statistics(text)
    assert len(v) == len(quality.FEATURES) and np.isfinite(v).all()


def test_scores(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(i, int(not (r[1] or "").startswith("junk")), 0) for i, r in enumerate(rows[:70])] + [(5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.score_documents(no_docs, model).count() == 0 and quality.keep_good(no_docs, model).count() == 0
    assert quality.train(no_docs, labels).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 30 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    (x, y), (x2, y2) = quality.training_rows(docs, labels), quality.training_rows(docs, flipped)
    assert np.array_equal(x, x2) and np.array_equal(y, y2)


def stumps(x, y, trees):
    """Boosted trees of depth one by trying every split, and the raw scores of the rows."""
    rate, l2, least = quality.RATE, quality.L2, quality.LEAST_ROWS
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        best, left = 1e-9, None
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                side = x[:, f] <= cut
                if least <= side.sum() <= len(y) - least:
                    gain = sum(g[m].sum() ** 2 / (h[m].sum() + l2) for m in (side, ~side)) - g.sum() ** 2 / (h.sum() + l2)
                    if gain > best:
                        best, left = gain, side
        for m in (left, ~left) if left is not None else (np.ones(len(y), dtype=bool),):
            raw[m] -= rate * g[m].sum() / (h[m].sum() + l2)
    return raw


def test_trees_equal_those_of_a_search_over_all_splits():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (400, 5)).astype(float)  # fewer values than bins: the histogram is exact
    y = ((x[:, 1] + x[:, 3] > 8) ^ (rng.random(400) < 0.1)).astype(float)
    for trees in (1, 2, 7):
        s = quality.fit(x, y, trees=trees, depth=1).score(x)
        assert np.allclose(np.log(s / (1 - s)), stumps(x, y, trees), atol=1e-6)


def test_a_repeated_id_is_one_training_row(spark, docs):
    """However often a labelled id is repeated, the driver gets one row of it, and the same one."""
    text = "some words of a document that is repeated"
    many = docs.select("doc_id", "text").unionByName(spark.range(3000).selectExpr("7L AS doc_id", f"concat('{text} ', id % 50) AS text"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    x, y = quality.training_rows(many, labels)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert len(y) == len(ids) and x.shape == (len(ids), len(quality.FEATURES))
    again, _ = quality.training_rows(many.repartition(7), labels)
    assert np.array_equal(x, again)


def test_ties_and_empty_training_sets():
    x = np.tile(np.array([[0.0], [1.0]]), (40, 3))  # three equal features: the first one splits
    y = np.tile([0.0, 1.0], 40)
    m = quality.fit(x, y, trees=1, depth=1)
    assert m.feature[0][0] == 0
