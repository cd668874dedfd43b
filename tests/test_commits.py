"""Tables of commits, attempts that are killed at every step, keyed streams, prefix sums, shuffles of many seeds."""

import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions import twister
from evalspark.functions.numbering import numbered, prefix_sums
from evalspark.operators import recovery as R
from evalspark.operators import sampling as S
from evalspark.sources import commits, jsonl
from evalspark.sources.commits import KeyedTable
from evalspark.sources.files import Folder

SCHEMA = "k string, v long, created string"


def table(spark, tmp_path, form="json"):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "created", form)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(t):
    return [(r["line_no"], r["k"], r["v"]) for r in t.read().orderBy("line_no").collect()]


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_each_key_once(spark, tmp_path, form):
    t = table(spark, tmp_path, form)
    assert content(t) == [] and t.entries() == []
    assert t.append(frame(spark, ("b", 2, "2"), ("a", 1, "1"), ("b", 9, "3"))) == (2, 1)
    assert t.append(frame(spark, ("a", 7, "0"), ("c", 3, "4"))) == (1, 1)
    assert t.append(frame(spark, ("a", 7, "0"))) == (0, 1) and len(t.entries()) == 2
    assert t.append(frame(spark, ("d", 4, "9")), "w", 5) == (1, 0)
    assert t.append(frame(spark, ("e", 5, "9")), "w", 5) == (0, 1)  # that batch is in
    assert t.append(frame(spark, ("d", 5, "9")), "w", 6) == (0, 1) and t.append(frame(spark, ("z", 5, "9")), "w", 6) == (0, 1)
    assert content(t) == [(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4)]
    with pytest.raises(Exception, match="a row without k"):
        t.append(frame(spark, (None, 1, "1")))
    assert t.append(spark.createDataFrame([("y",)], "k string")) == (1, 0)


def test_many_commits_are_read_from_the_last_whole_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "WHOLE", 3)
    t = table(spark, tmp_path)
    for i in range(8):
        assert t.append(frame(spark, (f"k{i}", i, "1"))) == (1, 0)
    opened, read = [], Folder.read
    monkeypatch.setattr(Folder, "read", lambda self, name: opened.append(name) or read(self, name))
    assert content(t) == [(i + 1, f"k{i}", i) for i in range(8)] and len(opened) <= 3


def test_two_writers_of_one_batch(spark, tmp_path):
    """Both begin before either commits; each key comes once, and no row of another batch is lost."""
    gate, out = threading.Barrier(2), []
    publish = KeyedTable._publish

    def wait(self, version, seen, entry):
        if version == 1:
            gate.wait(60)
        return publish(self, version, seen, entry)

    def write(own):
        t = table(spark, tmp_path)
        t._publish = wait.__get__(t)
        out.append(t.append(frame(spark, *[(f"k{i}", i, "1") for i in range(20)], (own, 99, "2"))))

    threads = [threading.Thread(target=write, args=(n,)) for n in ("x", "y")]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(out) == [(1, 20), (21, 0)]
    got = content(table(spark, tmp_path))
    assert [g[0] for g in got] == list(range(1, 23)) and sorted(g[1] for g in got) == sorted([f"k{i}" for i in range(20)] + ["x", "y"])
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # what lost is gone


def test_writers_without_common_keys_keep_their_rows(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    written, write = [], KeyedTable._write

    def late(self, batch, seen):
        held = write(self, batch, seen)
        written.append(held["commit"])
        if len(written) == 1:
            other.append(frame(spark, ("b", 2, "1")))
        return held

    monkeypatch.setattr(KeyedTable, "_write", late)
    assert t.append(frame(spark, ("a", 1, "1"))) == (1, 0)
    assert content(t) == [(1, "b", 2), (2, "a", 1)] and len(written) == 2


def test_what_a_killed_writer_left_is_not_read(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.append(frame(spark, ("a", 1, "1")))
    with monkeypatch.context() as m:
        m.setattr(Folder, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.append(frame(spark, ("b", 2, "1")))
    assert content(t) == [(1, "a", 1)] and t.vacuum() == 0 and t.vacuum(0) == 1 and t.vacuum(0) == 0
    assert t.append(frame(spark, ("b", 2, "1"))) == (1, 0) and content(t) == [(1, "a", 1), (2, "b", 2)]


def test_one_of_many_creators_wins(spark, tmp_path):
    f, out = Folder(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda i=i: out.append((f.create("x/one", f"text {i}"), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(made for made, _ in out) == 1 and f.read("x/one") == f"text {next(i for made, i in out if made)}"
    f.replace("x.json", "ä")
    f.replace("x.json", "b")
    assert f.read("x.json") == "b" and f.names() == ["x", "x.json"] and f.names("none") == []


class Killed(BaseException):
    pass


@pytest.mark.parametrize("at", ["marker", "call", "data", "manifest", "clear", "recovery"])
def test_kill_at_every_step(spark, tmp_path, monkeypatch, at):
    """Whatever step the driver dies at, the attempt has one line at last: its own, or an interrupted one, never both."""
    ledger, marker = R.ledger_table(spark, str(tmp_path / "l")), R.Marker(spark, str(tmp_path / "inflight.json"))
    account = [10.0]

    def die(*a, **k):
        raise Killed

    def call(unit):
        account[0] += 0.25
        if at == "call":
            die()
        return {"status": "ok", "cost_credits": 0.25}

    with monkeypatch.context() as m:
        if at == "marker":
            m.setattr(R.Marker, "write", die)
        if at == "data":
            m.setattr(KeyedTable, "_write", die)
        if at in ("manifest", "recovery"):
            m.setattr(Folder, "create", die)
        if at == "clear":
            m.setattr(R.Marker, "clear", die)
        with pytest.raises(Killed):
            R.attempt_unit(ledger, marker, {"key": "full/u", "config": "u", "style": "clean", "stage": "full"}, "2024-01-01", lambda: account[0], call)
    if at == "recovery":  # the booking is killed as well, after its line and before the marker goes
        with monkeypatch.context() as m:
            m.setattr(R.Marker, "clear", die)
            with pytest.raises(Killed):
                R.recover(ledger, marker, lambda: account[0])
    account[0] += 0.125  # usage that settles late
    for _ in range(2):
        R.recover(ledger, marker, lambda: account[0])
    lines = [(r["key"], r["status"], r["cost_credits"]) for r in ledger.read().collect()]
    interrupted = {"call": 0.375, "data": 0.375, "manifest": 0.375, "recovery": 0.25}
    assert lines == ([] if at == "marker" else [("full/u", "ok", 0.25)] if at == "clear" else [("full/u", "interrupted", interrupted[at])])
    assert marker.read() is None


def test_a_marker_waits_for_the_account(spark, tmp_path):
    ledger, marker = R.ledger_table(spark, str(tmp_path / "l")), R.Marker(spark, str(tmp_path / "inflight.json"))

    def offline():
        raise OSError("no network")

    marker.write(attempt="a", key="k", credits_before=1.0, created="2024")
    assert R.recover(ledger, marker, offline) is None and marker.read()["attempt"] == "a"
    assert R.recover(ledger, marker, lambda: 1.5)["cost_credits"] == 0.5 and marker.read() is None
    (tmp_path / "inflight.json").write_text("{")
    assert R.recover(ledger, marker, lambda: 9.0) is None and ledger.read().count() == 1
    marker.write(created="2025")  # a marker that says little
    assert R.recover(ledger, marker, lambda: 2.0)["key"] is None and ledger.read().count() == 2


def test_old_files_become_tables(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text("".join(json.dumps({"line_no": i, "key": k, "status": "ok", "cost_tokens": 1.0}) + "\n" for i, k in enumerate("ab", 1)))
    assert R.book(R.open_ledger(spark, str(path)), {"attempt": "n", "key": "c", "cost_tokens": 2.0})
    assert not R.book(R.open_ledger(spark, str(path)), {"attempt": "n", "key": "c", "cost_tokens": 2.0})
    assert [(r["line_no"], r["key"]) for r in jsonl.read_ledger(spark, str(path)).orderBy("line_no").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    old = tmp_path / "history.jsonl"
    old.write_text('{"key": "k1", "config": "a", "created": "1", "metrics": {"x": null}}\n')
    batch = spark.createDataFrame([("k1", "a", "1"), ("k2", "b", "2")], "key string, config string, created string")
    assert jsonl.append_history(spark, batch, str(old)) == (1, 1)
    assert [(r["line_no"], r["key"]) for r in jsonl.read_history(spark, str(old)).orderBy("line_no").collect()] == [(1, "k1"), (2, "k2")]


def test_stream_adds_each_key_once(spark, tmp_path):
    """A batch that runs again, a stream that starts anew, and a completion that comes back after the watermark."""
    from evalspark.streaming.append import append_keyed, keyed_table, stream_scored

    src, chk = str(tmp_path / "in"), str(tmp_path / "chk")
    made = lambda day, *ids: spark.createDataFrame([("r", i, "RESPUESTA: C", "stop") for i in ids], "run_key string, id string, completion string, stop_reason string").withColumn("created", F.to_timestamp(F.lit(day)))
    samples = spark.createDataFrame([(i, "x", "ambig", ["u", "v", "w"], ["target", "other", "unknown"], "unknown", "neg") for i in "abcd"], "id string, category string, split string, choices array<string>, roles array<string>, label_role string, polarity string")
    made("2024-01-01", "a", "b", "a").write.parquet(src)
    rows = stream_scored(spark, src, samples)
    t = keyed_table(spark, str(tmp_path / "t"), rows)
    append_keyed(rows, t, chk).awaitTermination()
    made("2024-02-01", "c", "a").write.mode("append").parquet(src)  # a is long past the watermark
    append_keyed(stream_scored(spark, src, samples), t, chk).awaitTermination()
    made("2024-03-01", "b", "d").write.mode("append").parquet(src)
    append_keyed(stream_scored(spark, src, samples), t, str(tmp_path / "other")).awaitTermination()  # all files again
    assert sorted(r["id"] for r in t.read().collect()) == ["a", "b", "c", "d"] and t.read().where("correct = 1").count() == 4
    before = t.entries()
    assert t.append(t.read().drop("line_no"), chk, 0) == (0, 4) and t.entries() == before


def test_prefix_sums_in_hard_orders(spark):
    """Sparse and repeated orders, nulls, one hot key, wholly equal rows, a column named like an internal one."""
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.choice([None, rng.randrange(50), rng.randrange(10**12)]), rng.randrange(5), i) for i in range(600)] + [("hot", 7, 1, 1000)] * 30
    df = spark.createDataFrame(data, "k string, o long, v long, _sum_ long").repartition(5).cache()
    got = prefix_sums(df, ["k"], ["o"], {"ahead": F.col("v"), "place": F.lit(1).cast("long")}).collect()
    assert len(got) == len(data) and set(got[0].asDict()) == {"k", "o", "v", "_sum_", "ahead", "place"}
    for k in ("hot", "a", None):
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert [r["o"] is not None and r["o"] for r in mine] == sorted((r["o"] is not None and r["o"] for r in mine), key=lambda o: (o is not False, o))
        total = 0
        for r in mine:
            assert r["ahead"] == total
            total += r["v"]
    parts = numbered(df, "k", "o").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 400  # the hot key is in several tasks
    assert numbered(df.limit(0), [], "o").count() == 0


def test_shuffles_equal_pythons(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(3000)] + [rng.getrandbits(31) for _ in range(50)] + [0, 1, 2**32 - 1, 2**32, 2**64 - 1]
    for size in (1, 2, 3, 4, 9):
        out, enough = twister.shuffles(np.array(seeds, dtype=np.uint64), size)
        assert enough.all() and out.tolist() == [random.Random(s).sample(range(size), size) for s in seeds]
    words = np.array([[5], [6], [7]], dtype=np.uint32)
    assert twister.outputs(twister.seeded(words), 5)[:, 0].tolist() == [random.Random(5 + (6 << 32) + (7 << 64)).getrandbits(32) if i == 0 else x for i, x in enumerate(twister.outputs(twister.seeded(words), 5)[:, 0].tolist())]


def test_option_orders(spark, monkeypatch):
    ids = [f"item-{i}" for i in range(3000)] + ["", "é", None]
    got = S.permute_options(spark.createDataFrame([(i,) for i in ids], "id string")).collect()
    assert all(r["order"] == (None if r["id"] is None else S.seeded_order(r["id"])) for r in got) and len(got) == len(ids)
    assert {tuple(r["order"]) for r in got if r["order"]} == {(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)}
