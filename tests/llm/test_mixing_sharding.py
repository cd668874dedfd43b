"""Mixing against a plain loop, differencing against its definition, sharding laws."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from evalspark.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, most=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = fill(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(size(r[1]) for r in rows if r[3] == s)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_draws_in_key_order(docs):
    """Within a source, what is picked has smaller keys than what is not, but for the document at the edge."""
    from pyspark.sql import functions as F

    d = docs.where("source is not null and doc_id is not null").dropDuplicates(["doc_id"])
    keys = {r["doc_id"]: r["k"] for r in d.select("doc_id", mixing.exponential_key(F.col("doc_id"), mixing.text_quality(F.col("text"))).alias("k")).collect()}
    by = defaultdict(list)
    for r in mixing.mix(d).collect():
        by[r["source"]].append((keys[r["doc_id"]], r["picked"]))
    for rows in by.values():
        flags = [p for _, p in sorted(rows)]
        assert sum(a != b for a, b in zip(flags, flags[1:], strict=False)) <= 3


def test_mix_low_quality_is_drawn_late(spark):
    rows = [(i, ("word " * 20 if i % 2 else "#$%& " * 20).strip(), "s0") for i in range(400)] + [(1000 + i, "fill " * 50, "s1") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 's0'").collect()
    share = lambda odd: sum(r["picked"] for r in got if r["doc_id"] % 2 == odd) / 200
    assert share(1) > share(0) + 0.2


def test_apply_mix(docs):
    n = {(r["doc_id"], r["size"]): r for r in mixing.mix(docs).where("doc_id is not null").collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    times = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["epochs"] + r["picked"]
    assert n and times == +want


@pytest.mark.parametrize("parts", [1, 3])
def test_equal_rows_and_empty_texts_keep_the_budget(spark, parts):
    """Of equal rows as many are drawn as the budget takes; an empty text of a capped source comes three times at most."""
    rows = [(1, "a b", "x")] * 100 + [(2, "w " * 1001, "y"), (3, "", "z"), (3, "", "z"), (4, "one", "z"), (5, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    plan = mixing.mix(df).collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    out = mixing.apply_mix(df).collect()
    words = Counter()
    for r in out:
        words[r["source"]] += len((r["text"] or "").split())
    assert words == +taken and abs(taken["x"] - target["x"]) <= 1
    assert Counter(r["doc_id"] for r in out)[4] == 3 and Counter(r["doc_id"] for r in out)[3] == 6 and 5 not in {r["doc_id"] for r in out}


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0 and sharding.shard_documents(no_docs).count() == 0


def spread(parts, places, shards):
    sums = [0] * shards
    for part, place in zip(parts, places, strict=True):
        for value, b in part:
            sums[place[b]] += value
    return max(sums) - min(sums), sums


@pytest.mark.parametrize("shards", [2, 3, 8])
def test_differencing(shards):
    rng = random.Random(shards)
    parts = [[(int(rng.lognormvariate(7, 1)), 0)] for _ in range(500)]
    gap, sums = spread(parts, sharding.difference(parts, shards), shards)
    assert sum(sums) == sum(p[0][0] for p in parts)
    greedy = [0] * shards
    for v in sorted((p[0][0] for p in parts), reverse=True):
        greedy[greedy.index(min(greedy))] += v
    assert gap <= max(greedy) - min(greedy)


def test_differencing_textbook():
    # 8, 7, 6, 5, 4 into two: differencing ends 2 apart (16, 14)
    parts = [[(v, 0)] for v in (8, 7, 6, 5, 4)]
    assert spread(parts, sharding.difference(parts, 2), 2)[0] == 2
    assert sharding.difference([], 4) == []


def test_partial_partitions_keep_their_bins_apart():
    parts = [[(5, 0), (4, 1), (1, 2)], [(6, 0), (3, 1)]]
    for place, part in zip(sharding.difference(parts, 3), parts, strict=True):
        assert len(set(place.values())) == len(part)


def test_shard_documents(docs, rows):
    got = sharding.shard_documents(docs).collect()
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    size = lambda t: (0 if t is None else len(t.encode())) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r[1]), crc(r[1])) for r in rows)
    shard_of, load, slots = {}, Counter(), defaultdict(list)
    for r in got:
        assert shard_of.setdefault(r["text_crc32"], r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) <= set(range(8))


def test_balance(spark):
    rng = random.Random(5)
    rows = [(i, "y" * int(rng.lognormvariate(6, 1))) for i in range(3000)]
    load = Counter()
    for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 3


def test_many_chunks_agree_with_groups(spark):
    rng = random.Random(6)
    g = spark.createDataFrame([(bytes([i % 256, i // 256]), rng.randint(1, 1000)) for i in range(2000)], "group binary, weight long")
    for per_node in (2000, 3):  # one node, and a tree of three levels
        out = sharding.assign_groups(g, 8, 100, per_node).join(g, "group").groupBy("shard").agg({"weight": "sum", "*": "count"}).collect()
        loads = [r["sum(weight)"] for r in out]
        assert max(loads) - min(loads) <= 5 and sum(r["count(1)"] for r in out) == 2000
