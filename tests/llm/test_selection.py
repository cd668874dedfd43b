"""Filter audit, block matrix join and importance resampling against brute force."""

import math
import re
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest

from evalspark.llm import audit, blockjoin, resample


def fails(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = set()
    if len(w) < 200:
        out.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
        out.add("C")
    if re.search(r"[#$%&*|]", t):
        out.add("D")
    return out


def test_audit(spark, docs, rows, no_docs):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    masks = []
    for r in rows:
        f = fails(r[1])
        if r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == (r[1] or "") for o in rows):
            f.add("E")
        masks.append((r[3] or "", f, r[0] in good and r[0] is not None, r[0] in toxic and r[0] is not None))
    want, total = {}, {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, own in enumerate(order):
                gone = set(order[:k])
                here = [m for m in mine if not m[1] & gone and own in m[1]]
                kept = sum(not m[1] & (gone | {own}) for m in mine)
                late = sum(bool(m[1] & gone) and own in m[1] for m in mine)
                want[part, order, k + 1] = (kept, len(here), late, sum(m[1] == {own} for m in mine), sum(m[2] for m in here), sum(m[3] for m in here))
                total[part, own] = total.get((part, own), 0) + len(here)
    got = audit.interaction_audit(docs, table).collect()
    assert len(got) == len(want)
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == want[key], key
        assert r["shapley"] == total[r["part"], r["filter_order"][r["step"] - 1]]
    assert audit.interaction_audit(no_docs, table).count() == 0
    assert audit.interaction_audit(docs, table.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_subset_sums(spark):
    from pyspark.sql import functions as F

    values = [3, 1, 4, 1, 5, 9, 2, 6]
    got = spark.range(1).select(audit.subset_sums(F.array(*[F.lit(v).cast("long") for v in values]), 3).alias("x")).first()["x"]
    assert got == [sum(v for m, v in enumerate(values) if m & s == m) for s in range(8)]


def brute_nearest(vectors, every, k=10):
    fine = sorted({(i, tuple(v)) for i, v in vectors if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    x = np.array([v for _, v in fine])
    out = []
    for i, v in fine:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            near = sorted((float(d[j]), fine[j][0]) for j in range(len(fine)) if fine[j][0] != i)[:k]
            out += [(i, r, name, round(score, 9)) for r, (score, name) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest(spark, kind):
    """Ties, copies, a repeated row, an id with two vectors, a tight group, and vectors that take no part."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 8)) + 5
    vectors = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(base)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)] + [(340 + i, (base[9] + 1e-4 * rng.standard_normal(8)).astype(np.float32).astype(float).tolist()) for i in range(60)]
    vectors += [vectors[20], vectors[20], (40, vectors[3][1]), (500, None), (520, []), (540, [0.0] * 8), (560, [float("nan")] + [1.0] * 7), (580, [None] + [1.0] * 7), (600, [1.0] * 5), (None, [1.0] * 8), (620, [1e30] * 8)]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], f"vec_id long, embedding array<{kind}>, digest string, query_id int").repartition(3)
    if kind == "float":
        vectors = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors]
    got = blockjoin.nearest(df, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == brute_nearest(vectors, 20)
    assert blockjoin.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = blockjoin.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] in ([1, 2], [2, 1])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((50, 1500)) + 2, rng.standard_normal((400, 1500)) + 2
    mean = b.mean(axis=0)
    left, right = blockjoin.Side(a, mean), blockjoin.Side(b, mean)
    assert (blockjoin.products(left.codes, right.codes) == left.codes.astype(np.int64) @ right.codes.astype(np.int64).T).all()
    low, high = blockjoin.bounds(left.part(slice(0, 50)), right.part(slice(0, 400)), 1e-12)
    exact = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all() and ((high - low) / exact).max() < 0.1


def test_tile_keeps_few_pairs_for_doubles(monkeypatch):
    """Of random vectors only some are computed anew; answers equal those of a full sort."""
    rng = np.random.default_rng(4)
    x, seen = rng.standard_normal((6000, 64)).astype(np.float32), []
    full = blockjoin.distances
    monkeypatch.setattr(blockjoin, "distances", lambda a, i, b, j: seen.append(len(i)) or full(a, i, b, j))
    got = blockjoin.search_tile(x[:100], np.arange(100), x, [np.array([i]) for i in range(len(x))], 10)
    assert sum(seen) < 0.02 * 100 * len(x)
    for q in range(100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        assert [n for _, n in sorted(got[q])] == [j for j in np.lexsort((np.arange(len(x)), d)).tolist() if j != q][:10]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_resample(spark, docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 7)  # runs go on over pieces
    target = [(0, rows[3][1]), (1, rows[45][1]), (2, None), (3, "É ünï Token 123 x-y")]
    bench = spark.createDataFrame(target, "item_id long, text string")
    bucket = lambda f: crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for r in rows:
        for f in features(r[1]):
            s[bucket(f)] += 1
    for _, text in target:
        for f in features(text):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    want = []
    for r in rows:
        f = features(r[1])
        h = int(sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        want.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(r[1]))])
    fit = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is not None, w[0] or 0))
    for k, w in enumerate(fit[: 30 * len(fit) // 100], 1):
        w[4] = k
    key = lambda w: tuple((x is not None, x or 0) for x in w)
    got = resample.resample(docs, bench, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(w[:5]) for w in want), key=key)
    assert resample.resample(no_docs, bench).count() == 0
    assert resample.resample(docs, bench.limit(0)).count() == len(rows)
    assert resample.resample(docs.limit(3), bench).where("rank is not null").count() == 0  # 5 % of three documents is none


def test_runs_of_one_to_three():
    for text in ("", " - ", "One", "one, TWO", "a b c", "A1 é b  c_d\x7fe", "x " * 300):
        got = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *[x for _, x in resample.run_buckets(text.encode())]]))
        assert got.tolist() == sorted(crc32(f.encode()) % 10_000 for f in features(text))


def test_draw_of_hot_scores(spark):
    """Many rows share one score and one id; ranks are 1, 2, 3 ... in order of score and id."""
    data = [(1 if i % 3 == 0 else i, 50, 7 if i % 2 else i % 40) for i in range(400)] + [(1000, 3, 99)]
    got = resample.draw(spark.createDataFrame(data, "doc_id long, n_words long, score long"), percent=60).collect()
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, 241))
    assert [d[1:] for d in drawn] == sorted((-s, d) for d, w, s in data if w >= 20)[:240]
