"""Near-duplicates against brute force, signatures, components, binary codes."""

import random
import string
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import components, hamming, itq, minhash

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def union(ids, links):
    p = {i: i for i in ids}

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        p[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute(texts, percent=85):
    sets = {i: brute_set(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, union(sets, links)


def test_near_duplicates(docs, rows, no_docs):
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    sizes, comp = brute(texts)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert sum(comp[i] != i for i in comp) >= 8
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i in comp if comp[i] == i}
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).count() == 0


def test_dense_group_in_small_blocks(spark, monkeypatch):
    """A group whose members link in chains, cut into many block pairs, keeps every component."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "ROWS_A_CELL", 50)
    _, comp = brute(texts)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert len(set(comp.values())) > 1


def test_candidates_beyond_the_broadcast_bound_are_joined(spark, docs, monkeypatch):
    want = sorted(map(tuple, minhash.near_duplicates(docs.where("doc_id is not null")).collect()))
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, minhash.near_duplicates(docs.where("doc_id is not null")).collect())) == want


def test_repeated_rows_and_ids_beyond_the_broadcast_bound(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base))] * 5 + [(1, "another text of the same id " * 4), (2, " ".join([*base, "more"])), (3, None), (None, " ".join(base)), (None, None), (4, ""), (5, " ".join(reversed(base)))]
    df = spark.createDataFrame([(i, t, i, t) for i, t in rows], "doc_id long, text string, filter_word long, shingles string")
    want = sorted(map(repr, minhash.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    assert sorted(map(repr, minhash.near_duplicates(df).collect())) == want


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 27])
def test_bit_filter_loses_no_row(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "FILTER_BITS", bits)
    rows = spark.range(-3000, 3000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    ids = spark.range(-3000, 3000, 100).select(F.col("id").alias("doc_id"))
    got = [r["doc_id"] for r in minhash.likely_among(rows, ids, "doc_id").collect()]
    assert set(range(-3000, 3000, 100)) <= set(got) and len(got) == len(set(got))
    assert len(got) <= 60 + 5940 * min(1, 2 * 60 / bits) + 5 and minhash.likely_among(rows, ids.limit(0), "doc_id").count() == 0


def test_rows_that_repeat_an_id_with_another_text(spark):
    """Every row is judged by its own text: the copy of another document goes, the unrelated text of the same id stays."""
    rng = random.Random(11)
    t, u = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(80)) for _ in range(2))
    near = t.replace(" ", "  ", 3) + " tail"
    rows = [(1, t), (5, near), (5, u), (5, u), (9, u + " x"), (7, None), (7, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    n = {x: len(brute_set(x)) for x in (t, near, u, u + " x")}
    assert got == {(1, n[t], 1, True), (5, n[near], 1, False), (5, n[u], 5, True), (9, n[u + " x"], 5, False), (7, 0, 7, True), (7, n[t], 1, False)}
    assert sorted(map(str, minhash.drop_near_duplicates(df).collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[2], rows[3], rows[5]], "doc_id long, text string").collect()))


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    """Windows, neighbours and long words change nothing: equal words have equal hashes, others others."""
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice((1, 2, 5, 30, 64, 65, 300)))).encode() for _ in range(3000)]
    raw = b"".join(w + rng.choice((b" ", b"\n", b" \t ")) for w in words)
    _, want = minhash.word_hashes(raw)
    assert len(want) == len(words) and len(set(zip(words, want.tolist(), strict=True))) == len(set(words)) == len(set(want.tolist()))
    minhash._rolling.cache_clear()
    monkeypatch.setattr(minhash, "WINDOW", 100)
    starts, got = minhash.word_hashes(raw)
    assert np.array_equal(got, want) and [raw[s : s + 1] for s in starts] == [w[:1] for w in words]
    minhash._rolling.cache_clear()
    texts = ["A b  c\td e f", None, "", "one two", "x " * 5000, "Y"]
    sets = list(minhash.shingle_sets_of(texts))
    assert list(map(len, sets)) == [len(brute_set(t)) for t in texts]
    minhash._rolling.cache_clear()


def test_min_max_estimates_resemblance():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 1150, dtype=np.uint64)
        a, b = np.unique(pool[:1000]), np.unique(pool[150:])
        agree.append((minhash.min_max(a) == minhash.min_max(b)).mean())
    assert abs(np.mean(agree) - 850 / 1150) < 0.03
    v = minhash.min_max(np.array([5], dtype=np.uint64))
    assert len(v) == 2 * minhash.PERMUTATIONS and np.array_equal(v[::2], v[1::2])


@pytest.mark.parametrize("n, both, linked", [(100, 92, True), (100, 91, False), (20, 20, True)])
def test_link_rule(n, both, linked):
    x = np.arange(n, dtype=np.uint64)
    y = np.concatenate([x[:both], np.arange(10**6, 10**6 + n - both, dtype=np.uint64)])
    assert minhash.shared_at_least(x, np.sort(y)) == (100 * both >= 85 * (2 * n - both)) == linked


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, k) for k in range(1001, 1400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(7, 7)]
    want = union({x for e in links for x in e}, [e for e in links if e[0] != e[1]])
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and {i for i, c in want.items() if c != i} <= set(got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=0, n=300, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, 120, 4):  # pairs and small groups at many angles
        x[k + 1] = x[k] + rng.standard_normal(dim) * 0.05 * (k % 12)
        x[k + 2] = x[k] * 3
    out = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim - 1)]
    return out + [(n + i, v) for i, v in enumerate(bad)] + [(n + 50, out[0][1]), (n + 51, out[0][1])], dim


def test_near_vectors(spark):
    rows, dim = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links int, rep string")
    good = {i: np.array(v, dtype=float) for i, v in rows if v and len(v) == dim and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    links = [(a, b) for a, b in combinations(sorted(good), 2) if cos(good[a], good[b]) >= 0.9]
    comp = union([i for i, _ in rows], links)
    got = {r["vec_id"]: r for r in itq.near_vectors(df).collect()}
    assert len(got) == len(rows)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    found = sum(r["n_links"] for r in got.values())
    assert found <= 2 * len(links) and found >= 0.95 * 2 * len(links)
    assert all(got[i]["n_links"] <= n[i] for i in n)
    assert sum(got[i]["component_id"] == comp[i] for i in n) >= 0.95 * len(n)
    for i in range(300, 307):
        assert got[i]["n_links"] == 0 and got[i]["kept"]
    assert itq.near_vectors(df.limit(0)).count() == 0
    assert itq.near_vectors(df.where("vec_id = 302")).count() == 1


def test_dense_bucket_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(i, (base + rng.standard_normal(32) * 0.1).tolist()) for i in range(120)]
    monkeypatch.setattr(itq, "BLOCK", 16)
    monkeypatch.setattr(itq, "ROWS_A_CELL", 64)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.97 * want.sum() and all(got[i] <= want[i] for i in got)


def test_itq_recall_at_the_threshold():
    """Pairs exactly at the threshold share a segment about as often as planned."""
    rng = np.random.default_rng(2)
    x = itq.unit(rng.standard_normal((2000, 64)))
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * itq.unit(noise)
    bits, tables, rotations = itq.plan_tables(10_000, 64)
    mean = np.zeros(64)
    p = itq.learn(x, mean, rotations, iterations=10)
    same = (itq.segments(x, mean, p, bits, tables) == itq.segments(y, mean, p, bits, tables)).any(axis=1)
    assert same.mean() >= 0.9
    code = (x - mean) @ p[0] >= 0
    assert np.all(np.abs(code.mean(axis=0) - 0.5) < 0.1)  # balanced bits


@pytest.mark.parametrize("mean_cosine, most", [(0.0, 0.02), (0.5, 0.02), (0.8, 0.05)])
def test_vectors_that_share_a_direction(mean_cosine, most):
    """Codes about the mean keep buckets small, and planted links are found whatever the vectors have in common."""
    rng = np.random.default_rng(6)
    n, dim = 20_000, 64
    noise = itq.unit(rng.standard_normal((n, dim)))
    noise[1::2] = itq.unit(noise[::2] + rng.uniform(0.1, 1.2, (n // 2, 1)) * itq.unit(rng.standard_normal((n // 2, dim))))
    shared = itq.unit(rng.standard_normal((1, dim)))
    x = itq.unit(np.sqrt(mean_cosine) * shared + np.sqrt(1 - mean_cosine) * noise)
    cos = (x[::2] * x[1::2]).sum(axis=1)
    links = np.flatnonzero(cos >= 0.9)
    origin, seen = itq.origin_and_cosine(x[:4096])
    bits, tables, rotations = itq.plan_tables(50_000, dim, seen)
    seg = itq.segments(x, origin, itq.learn(x[:4096], origin, rotations, iterations=3), bits, tables)
    assert (seg[::2][links] == seg[1::2][links]).any(axis=1).mean() >= 0.9 and len(links) > 1000
    pairs = sum(int((c * (c - 1)).sum()) for c in (np.unique(seg[:, t], return_counts=True)[1].astype(np.int64) for t in range(tables)))
    assert pairs / (n * (n - 1)) < most


def test_vectors_that_repeat_an_id(spark):
    """(5, near a) links with (1, a); the unrelated vector of id 5 does not."""
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, -1.0, 0.0]
    df = spark.createDataFrame([(1, a), (5, [1.0, 0.05, 0.0, 0.1]), (5, b), (9, b)], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in itq.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (9, 1, 5, False)]


def brute_top(codes, k):
    """codes: id -> bits. The k nearest of every twentieth id by (distance, id)."""
    return {q: sorted((int((codes[q] != b).sum()), i) for i, b in codes.items() if i != q)[:k] for q in codes if q % 20 == 0}


def answers(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    return out


@pytest.mark.parametrize("entries", [0, 10**6])
@pytest.mark.parametrize("dim", [24, 37])
def test_top_k(spark, monkeypatch, dim, entries):
    """Pairs and groups, ties and unusable vectors, with broadcast and with shuffled tables."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(hamming, "BROADCAST_ENTRIES", entries)
    rows, _ = vectors(5, 200, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = df.where(itq.usable_numbers(F.col("embedding"), dim))
    bits = {i: np.array(v) > 0 for i, v in rows if v and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)}
    for k in (5, 500):
        want = {q: x for q, x in brute_top(bits, k).items() if x}
        assert answers(hamming.top_k(hamming.sign_codes(good, dim), dim, F.col("vec_id") % 20 == 0, k).collect()) == want
    assert hamming.top_k(hamming.sign_codes(good.limit(0), dim), dim, F.col("vec_id") % 20 == 0).count() == 0
    one = good.where("vec_id = 20")
    assert hamming.top_k(hamming.sign_codes(one, dim), dim, F.col("vec_id") % 20 == 0).count() == 0


def test_answers_stop_by_radius(spark, monkeypatch):
    """Where neighbours are near, a query is answered by the bound at a small radius and goes no further."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    base = rng.standard_normal((200, 64))
    near = np.repeat(base, 20, axis=0)
    flip = rng.random(near.shape) < 0.03
    x = np.where(flip, -near, near).astype(np.float32)
    x[-1] = x[-2]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    radii, met = [], hamming._met
    monkeypatch.setattr(hamming, "_met", lambda a, i, n, r: (radii.append(r), met(a, i, n, r))[1])
    got = answers(hamming.top_k(hamming.sign_codes(df, 64), 64, F.col("vec_id") % 20 == 0, 10).collect())
    assert got == brute_top(dict(enumerate(x > 0)), 10)
    lengths = hamming.segment_lengths(64, 12)
    assert radii == list(range(len(radii))) and len(radii) - 1 < lengths[-1] / 2


def test_segments_and_rings():
    for dim, bits in ((64, 16), (64, 12), (37, 8), (5, 16), (24, 9)):
        n = hamming.segment_lengths(dim, bits)
        assert sum(n) == dim and max(n) <= bits and n == sorted(n, reverse=True) and n[0] - n[-1] <= 1
    assert sorted(x for r in range(6) for x in hamming.ring(5, r)) == list(range(32))


def cone(rng, n, dim, mean_cosine, low, high):
    """``n`` unit vectors of this mean cosine, each odd one at a cosine of ``low`` to ``high`` to the one before."""
    shared = np.zeros(dim)
    shared[0] = np.sqrt(mean_cosine)
    side = itq.unit(rng.standard_normal((n // 2, dim - 1)))
    x = shared + np.sqrt(1 - mean_cosine) * np.pad(side, ((0, 0), (1, 0)))
    want = rng.uniform(low, high, n // 2)
    turn = rng.standard_normal((n // 2, dim))
    turn[:, 0] = 0  # the partner leaves the first in a direction across both
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    y = want[:, None] * x + np.sqrt(1 - want**2)[:, None] * itq.unit(turn)
    spin = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    out = np.empty((n, dim))
    out[::2], out[1::2] = x @ spin, y @ spin
    return out


def entries_met(bits):
    """Table entries that a code meets at radius 0, over all segments, as a mean share of the rows."""
    n = hamming.segment_lengths(bits.shape[1], round(np.log2(len(bits))))
    met = 0
    for lo, hi in zip(np.cumsum([0, *n]), np.cumsum(n), strict=False):
        _, sizes = np.unique(bits[:, lo:hi], axis=0, return_counts=True)
        met += (sizes.astype(float) ** 2).sum() / len(bits)
    return met / len(bits)


@pytest.mark.parametrize("mean_cosine", [0.0, 0.5, 0.8])
def test_tables_stay_spread_where_vectors_share_a_direction(spark, mean_cosine):
    """About the centre a query meets under 1 % of the rows, and the answers are those of all pairs of the same codes."""
    from pyspark.sql import functions as F

    x = cone(np.random.default_rng(3), 4000, 64, mean_cosine, 0.93, 0.99)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    bar = hamming.centre(df, 64)
    assert (bar == hamming.centre(df.repartition(2), 64)).all() and np.abs(bar - x.mean(axis=0)).max() < 2e-6
    bits = x > bar
    assert entries_met(bits) < 0.01
    if mean_cosine == 0.8:
        assert entries_met(x > 0) > 0.05  # what the signs about 0 met
    got = answers(hamming.top_k(hamming.sign_codes(df, 64, bar), 64, F.col("vec_id") % 20 == 0, 10).collect())
    assert got == brute_top(dict(enumerate(bits)), 10)


def test_centre_of_hard_rows(spark):
    """Huge components count within the limit; equal components are not above their centre; no rows give zeros."""
    rows = [(1, [0.1, 3e38, -3e38]), (2, [0.1, 1.0, 0.0]), (20, [0.1, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    bar = hamming.centre(df, 3)
    assert bar.tolist() == [300000 / 3 / 1e6, 1002e6 / 3 / 1e6, -1000e6 / 3 / 1e6]
    assert hamming.centre(df.limit(0), 3).tolist() == [0.0, 0.0, 0.0] and len(hamming.centre(df, 0)) == 0


@pytest.mark.parametrize("mean_cosine", [0.0, 0.5, 0.8, 0.87])
def test_links_just_at_the_threshold_are_found(spark, monkeypatch, mean_cosine):
    """Whole operator on vectors that share a direction, with planted pairs of cosine 0.9 to 0.91 only."""
    monkeypatch.setattr(itq, "LEAST_BUCKET", 256)  # several buckets a table on few rows
    rng = np.random.default_rng(11)
    x = cone(rng, 4000, 64, mean_cosine, 0.9001, 0.91)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_vectors(df).collect()}
    u = itq.unit(x)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= links[i] for i in got) and sum(got.values()) >= 0.95 * links.sum() and links.sum() >= 4000


@pytest.mark.parametrize("cosine", [0.9, 0.8, 0.5])
def test_pairs_compared_fall_with_the_rows(cosine):
    share = []
    for n in (10**5, 10**6, 10**7, 10**8):
        (bits, tables, _), (fine, more, _) = itq.plan_levels(n, 64, cosine, 2 * n // itq.BLOCK)
        share.append(tables / 2**bits * more / 2**fine)
    assert share == sorted(share, reverse=True) and share[-1] < share[0] / 3
    flat = itq.plan_tables(10**8, 64, cosine)
    assert itq.plan_levels(10**8, 64, cosine, 2 * 10**8 // itq.BLOCK)[0][1] < flat[1] / 3  # vectors travel to far fewer tables


def test_a_block_gives_each_link_once():
    rng = np.random.default_rng(8)
    x = itq.unit(rng.standard_normal((300, 16)) * 0.3 + np.repeat(rng.standard_normal((30, 16)), 10, axis=0))
    fine = rng.integers(0, 4, (300, 9))
    for side in (None, rng.integers(0, 2, 300).astype(np.int8)):
        got = [tuple(sorted(pq)) for p, q in itq.link_block(x, side, fine, 0.9) for pq in zip(p.tolist(), q.tolist(), strict=True)]
        want = {(i, j) for i, j in combinations(range(300), 2) if x[i] @ x[j] >= 0.9 and (fine[i] == fine[j]).any() and (side is None or side[i] != side[j])}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_a_tile_gives_what_a_query_meets_first(monkeypatch, at_once):
    """Radius by radius, crowded entries, shared ids and bounds, however few probes and codes are compared at once."""
    monkeypatch.setattr(hamming, "PROBES_AT_ONCE", at_once)
    monkeypatch.setattr(hamming, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    lengths, k = [4, 4, 3, 3, 3], 3
    code = np.unique(np.stack([rng.integers(0, 1 << n, 300) for n in lengths], axis=1).astype(np.int32), axis=0)
    code[:200, 0] = 5  # most rows in one entry
    code = np.unique(code, axis=0)
    size = rng.integers(1, k + 2, len(code))
    start = np.concatenate([[0], np.cumsum(size)])
    ids = np.concatenate([np.sort(rng.choice(400, s, replace=False)) for s in size])
    names, asked = ids[start[:40]], code[:40]
    apart = np.bitwise_count(asked[:, None] ^ code[None]).astype(int)
    for radius in range(4):
        for most in (17, 4):
            got: dict[int, list] = {}
            bound = np.full(len(names), most)
            for q, d, name in zip(*(x.tolist() for x in hamming.search_tile(names, asked, bound, hamming.Codes(code, start, ids), lengths, radius, k)), strict=True):
                got.setdefault(q, []).append((d, name))
            want = {}
            for q in range(len(names)):
                x = sorted((int(apart[q, c].sum()), int(i)) for c in range(len(code)) if apart[q, c].min() == radius and apart[q, c].sum() <= most for i in ids[start[c] : start[c + 1]] if i != names[q])
                if x:
                    want[q] = x[:k]
            assert got == want and (radius or got)


def test_search_sends_no_table_through_the_driver(spark, monkeypatch):
    """No plan of a search broadcasts a table or lists probes, and its tasks stay few where neighbours are far."""
    monkeypatch.setattr(hamming, "PROBES_A_TASK", 1, raising=False)
    monkeypatch.setattr(hamming, "PAIRS_A_TILE", 1, raising=False)
    monkeypatch.setattr(hamming, "MOST_TILES", 4, raising=False)
    plans, parts, cut, met = [], [], hamming.cut, hamming._met
    monkeypatch.setattr(hamming, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    monkeypatch.setattr(hamming, "_met", lambda *a: (parts.append((near := met(*a)).rdd.getNumPartitions()), near)[1])
    x = np.random.default_rng(9).standard_normal((200, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = answers(hamming.top_k(hamming.sign_codes(df, 24), 24, F.col("vec_id") % 20 == 0, 10).collect())
    assert got == brute_top(dict(enumerate(x > 0)), 10)
    assert len(plans) > 4 and not any("strategy=broadcast" in p or "mask" in p for p in plans)
    assert max(parts) <= 16
