"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations that balance and sharpen the signs of the principal components are learned on a bounded sample. Their codes
are cut into segments, one table a segment, at two levels. The segments of the first level are so short that a bucket is
some thousands of vectors; a vector travels to its bucket of each of these few tables, and no further. Within a bucket the
second level's longer segments, made there from the vector itself, name the candidates, which are reranked by cosine on
the original vectors in double precision; where a product of all pairs of a bucket costs less than these look-ups, it is
taken instead. Vectors are taken about their mean, so that codes stay balanced where all vectors share a direction; the
angle at which a pair just at the threshold is then seen, and with it the number of tables, follows from how far vectors
lie from the mean. Where vectors lie so close to it that most pairs are links anyway, directions are taken about the
origin. However many tables it takes, a pair exactly at the threshold is found with probability ``RECALL``; closer pairs
are found more often. A pair that several tables find counts in the first of them, so no list of pairs is needed: a bucket
gives each vector its number of links and the smallest of its local group. A bucket of many different vectors is
compared in blocks, for each of its links has to be counted.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components link
with nothing, and are kept; equal vectors are one class from the start; rows that repeat a vec_id are judged each by its
own vector; a null vec_id links with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for
from .components import connected_components

COSINE = 0.9
RECALL = 0.97
#: Below this cosine, seen from the mean, a pair at the threshold is hardly told from others: the origin serves better.
LEAST_SEEN = 0.4
#: Vectors that the rotations are learned on, the documented bound of the sample: those with the least hash.
SAMPLE_ROWS = 4096
ITERATIONS = 30
#: Vectors of one side of a block, and their bytes as doubles.
BLOCK, BLOCK_BYTES = 16_384, 64 << 20
#: Buckets are not made smaller than this for the sake of more tasks.
LEAST_BUCKET = 1024
#: Rows of buckets that are handed to Python together; small buckets would cost more in calls than in comparisons.
ROWS_A_CELL = 2_500
#: Pairs that a product of matrices compares in the time of one look-up of a candidate.
PAIRS_A_LOOK = 16


def usable_numbers(v: Column, dim: int) -> Column:
    """``dim`` components, all of them finite numbers."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & fine, F.lit(False))


def usable(v: Column, dim: int) -> Column:
    return usable_numbers(v, dim) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame) -> int:
    """The most common length of a vector (the larger of equals); 0 if there is none."""
    row = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def number_kind(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def packed(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, digest and v (the numbers as bytes) of vectors without nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            v = [np.asarray(x, dtype=kind).tobytes() for x in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "digest": [xxhash.xxh3_128_digest(x) for x in v], "v": v})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "vec_id long, digest binary, v binary")


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def origin_and_cosine(sample: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, float]:
    """The point about which unit vectors are taken, and the cosine there of a pair that has ``cosine`` about zero."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    away = float(np.median(((sample - mean) ** 2).sum(axis=1))) if len(sample) else 1.0
    seen = 1 - (1 - cosine) / away if away > 0 else -1.0
    return (mean, min(seen, cosine)) if seen >= LEAST_SEEN else (np.zeros(sample.shape[1]), cosine)


def learn(sample: np.ndarray, origin: np.ndarray, rotations: int, iterations: int = ITERATIONS, seed: int = 7) -> list[np.ndarray]:
    """``rotations`` projections of vectors about ``origin``, each from another random start."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    x = sample - origin
    _, vectors = np.linalg.eigh(x.T @ x / max(len(x), 1) + 1e-12 * np.eye(d))
    p = vectors[:, ::-1]
    y = x @ p
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(iterations):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        out.append(p @ r)
    return out


def tables_for(bits: int, cosine: float, recall: float) -> int:
    """Tables of ``bits`` bits in which a pair seen at ``cosine`` shares a segment with probability ``recall``."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same)) if same < 1 else 1


def rotations_for(bits: int, tables: int, dim: int) -> int:
    return -(-tables // (dim // bits)) if bits else 0


def plan_tables(n: int, dim: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits of a segment, tables, rotations) for ``n`` vectors and pairs seen at ``cosine``: the bits at which
    look-ups and candidates (each of which costs about two) of a vector are fewest."""
    work = lambda bits: tables_for(bits, cosine, recall) * (1 + 2 * n / 2**bits)
    bits = min(range(min(4, dim), min(31, dim) + 1), key=work)
    tables = tables_for(bits, cosine, recall)
    return bits, tables, rotations_for(bits, tables, dim)


def plan_levels(n: int, dim: int, cosine: float, buckets: int, recall: float = RECALL) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """(bits, tables, rotations) of both levels for about ``buckets`` buckets a table; no bits mean one bucket of all."""
    bits = min(max(0, math.ceil(math.log2(max(buckets, 1)))), dim, 31)
    rows = n / 2**bits
    each = recall if not bits else math.sqrt(recall)
    fine = plan_tables(max(round(rows), 1), dim, cosine, each)
    if rows / PAIRS_A_LOOK <= fine[1] * (1 + 2 * rows / 2 ** fine[0]):
        fine, each = (0, 1, 0), recall
    tables = tables_for(bits, cosine, each)
    return (bits, tables, rotations_for(bits, tables, dim)), fine


def segments(x: np.ndarray, origin: np.ndarray, projections: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """Values of the first ``tables`` segments of each row's codes."""
    if not bits:
        return np.zeros((len(x), tables), dtype=np.int64)
    weights = 2.0 ** np.arange(bits)  # sums stay whole below 2**31
    out = np.empty((len(x), tables), dtype=np.int64)
    at = 0
    for p in projections:
        code = (((x - origin) @ p) >= 0).astype(np.float64)
        for k in range(0, code.shape[1] - bits + 1, bits):
            if at < tables:
                out[:, at] = code[:, k : k + bits] @ weights
                at += 1
    return out


def local_groups(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable by the links (i, j) among n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows in which no column of ``a`` equals that of ``b``; most rows that have one have it early."""
    left = np.arange(len(a))
    for t in range(a.shape[1]):
        left = left[a[left, t] != b[left, t]]
    return left


def _hits(x: np.ndarray, rows: np.ndarray, cols: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``rows`` and ``cols`` (or of ``rows`` among themselves) with at least this cosine."""
    others = rows if cols is None else cols
    for k in range(0, len(rows), 512):
        part = rows[k : k + 512]
        p, q = np.nonzero(x[part] @ x[others].T >= cosine)
        if cols is None:
            p, q = p[q > p + k], q[q > p + k]
        if len(p):
            yield part[p], others[q]


def link_block(x: np.ndarray, side: np.ndarray | None, fine: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places) that link, each once: those with an equal value in a column of ``fine``, and of different sides if
    there are sides."""
    for t in range(fine.shape[1]):
        order = np.argsort(fine[:, t], kind="stable")
        value = fine[order, t]
        edge = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
        size = np.diff(edge)
        found = []
        small = edge[:-1][size == 2]  # most buckets of long segments
        if len(small):
            p, q = order[small], order[small + 1]
            if side is not None:
                p, q = p[side[p] != side[q]], q[side[p] != side[q]]
            hit = (x[p] * x[q]).sum(axis=1) >= cosine
            found.append((p[hit], q[hit]))
        for k in np.flatnonzero(size > 2).tolist():
            rows = order[edge[k] : edge[k + 1]]
            found += _hits(x, rows, None, cosine) if side is None else _hits(x, rows[side[rows] == 0], rows[side[rows] == 1], cosine)
        for p, q in found:
            new = _apart(fine[p, :t], fine[q, :t])
            if len(new):
                yield p[new], q[new]


def _cell(dim: int, kind: str, cosine: float, coarse: tuple, fine: tuple):
    """``coarse`` and ``fine``: origin, projections, bits and tables of the two levels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks of many buckets; each is compared within itself."""
        pdf = pdf.sort_values(["table", "value", "i", "j", "rep"], kind="stable")
        x = unit(np.frombuffer(b"".join(pdf["v"]), dtype=kind).reshape(-1, dim))
        near = segments(x, *fine)
        key = pdf[["table", "value", "i", "j"]].to_numpy()
        rep, copies, chunk = (pdf[c].to_numpy() for c in ("rep", "copies", "chunk"))
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
        links, root, some = np.zeros(len(x), dtype=np.int64), rep.copy(), np.zeros(len(x), dtype=bool)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            s, (table, _, i, j) = slice(lo, hi), key[lo].tolist()
            side = None if i == j else (chunk[s] == j).astype(np.int8)
            label = np.arange(hi - lo)
            for p, q in link_block(x[s], side, near[s], cosine):
                if table:  # pairs that an earlier table has count there
                    mine, at = np.unique(np.concatenate([p, q]), return_inverse=True)
                    before = segments(x[s][mine], coarse[0], coarse[1], coarse[2], table)
                    new = _apart(before[at[: len(p)]], before[at[len(p) :]])
                    p, q = p[new], q[new]
                links[s] += (np.bincount(p, weights=copies[s][q], minlength=hi - lo) + np.bincount(q, weights=copies[s][p], minlength=hi - lo)).astype(np.int64)
                label = local_groups(np.concatenate([p, np.arange(hi - lo)]), np.concatenate([q, label]), hi - lo)
            root[s], some[s] = rep[s][label], links[s] > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    dim, kind = common_length(vectors), number_kind(vectors)
    good = vectors.where(usable(F.col("embedding"), dim) & F.col("vec_id").isNotNull())
    rows = cut(packed(good, kind).withColumn("row", F.monotonically_increasing_id()))
    # a class is named by one of its rows: a vec_id may stand for several vectors
    reps = cut(rows.groupBy("digest").agg(F.min("row").alias("rep"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    n = reps.count()
    everyone = vectors.select(F.col("vec_id"), usable(F.col("embedding"), dim).alias("good"), "embedding")
    if not n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    sample = reps.orderBy(F.xxhash64("digest")).limit(SAMPLE_ROWS).select("v").collect()  # bounded
    directions = unit(np.frombuffer(b"".join(r["v"] for r in sample), dtype=kind).reshape(-1, dim))
    origin, seen = origin_and_cosine(directions, cosine)
    block = max(2, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    tasks = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (bits, tables, turns), (long_bits, long_tables, more) = plan_levels(n, dim, seen, max(2 * n // block, min(n // LEAST_BUCKET, tasks)), recall)
    rotations = turns + more
    projections = learn(directions, origin, rotations, max(3, min(ITERATIONS, 300 // max(rotations, 1))))
    coarse, fine = (origin, projections[:turns], bits, tables), (origin, projections[turns:], long_bits, long_tables)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = unit(np.frombuffer(b"".join(pdf["v"]), dtype=kind).reshape(-1, dim))
                yield pd.DataFrame({"rep": pdf["rep"], "seg": list(segments(x, *coarse).astype(np.int32))})

    placed = cut(reps.select("rep", "v").mapInPandas(code, "rep long, seg array<int>")).select("rep", F.posexplode("seg").alias("table", "value"))
    full = cut(placed.groupBy("table", "value").agg(F.count("*").alias("n")).where("n > 1"))
    placed = placed.join(full, ["table", "value"]).withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("rep", "table", "value", "chunk", F.least("chunk", "other").cast("int").alias("i"), F.greatest("chunk", "other").cast("int").alias("j"))
    cell = F.pmod(F.xxhash64("table", "value", "i", "j"), F.lit(parts_for(n * tables, ROWS_A_CELL))).cast("int")
    members = placed.withColumn("cell", cell).join(reps.select("rep", "copies", "v"), "rep")
    found = cut(members.groupBy("cell").applyInPandas(_cell(dim, kind, cosine, coarse, fine), "rep long, links long, root long"))

    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = reps.select("digest", "rep", "vec_id", "copies").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    classes = cut(classes.select("digest", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    names = cut(classes.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    classes = cut(classes.join(names, "component").select("digest", "n_links", "component_id"))
    linked = rows.select("vec_id", "digest").join(classes, "digest").select("vec_id", "n_links", "component_id")
    rest = everyone.where(~F.col("good") | F.col("vec_id").isNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
