"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are the signs of the components about their centre (``centre``; about 0 without one), cut into segments of about
log2(n) bits. Where all vectors share a direction, signs about 0 are nearly the same for all of them and a few table
entries hold most rows; about the centre each bit halves them. Every distinct code is entered once a segment in a table
keyed by segment and value. Queries grow their radius together: at radius r a query probes every
segment with all values that differ from its own in r bits. After radius r each code not met yet differs by more than r
bits in every segment, so by ``segments * (r + 1)`` bits at least; a query whose k-th verified distance is smaller has
its answer and goes on no more, the others go to the next radius. A code is counted where it is met first, which its
segments' distances tell, so nothing is listed twice.

Distinct codes and queries are dealt to blocks of bounded size; a tile is one block of codes with its tables against
one block of queries, which probes them in arrays. A tile hands on at most k rows a query and leaves out what is farther
than the query's k-th so far. No table, probe or pair is shuffled or broadcast and nothing but counts reaches the driver;
per radius a code travels once a block of queries and a query once a block of codes. Rows with equal codes are one entry
with their k + 1 smallest ids, as no answer needs more of them.

Defined cases: neighbours exclude the query's own id; equal distances go by the smaller id; repeated equal rows count
once; of an id that is repeated with other vectors each is a query and each may be found; vectors that are null, of
another length than most, or hold null or non-finite components are neither queries nor found; fewer than k rows give
fewer neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for

MOST_SEGMENT_BITS = 16
#: Components count towards the centre within these limits.
CENTRE_LIMIT = 1000.0
#: Entries (distinct codes times segments) in the tables of one block, which go to each block of queries.
BROADCAST_ENTRIES = 4_000_000
#: Codes that make a block of their own while there are fewer blocks than cores, and while there are fewer than tiles to
#: be made; queries of a block at most.
LEAST_CODES, FAIR_CODES, MOST_QUERIES = 1 << 13, 1 << 18, 1 << 16
#: Probes and codes met that make a tile of their own, while there are fewer than ``MOST_TILES``.
PAIRS_A_TILE, MOST_TILES = 1 << 26, 1024
#: Probes looked up, and codes met compared, at once in a tile.
PROBES_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 17


def segment_lengths(dim: int, bits: int) -> list[int]:
    """Lengths of the segments of ``dim`` bits: at most ``bits``, longer ones first, at most one apart."""
    return split(dim, max(1, -(-dim // bits)))


def split(dim: int, segments: int) -> list[int]:
    return [dim // segments + (j < dim % segments) for j in range(segments)]


def ring(bits: int, radius: int) -> list[int]:
    """All ``bits``-bit masks with ``radius`` bits set."""
    return [sum(1 << b for b in c) for c in combinations(range(bits), radius)]


def centre(vectors: DataFrame, dim: int) -> np.ndarray:
    """Mean of each component, limited to ``CENTRE_LIMIT`` either way and taken in whole millionths (rounded down), so that
    sums are exact in any order; zeros if there are no vectors. Only ``dim`` sums reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dim, dtype=np.int64), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(list(pdf["embedding"])).astype(np.float64)
                total += np.floor(np.clip(x, -CENTRE_LIMIT, CENTRE_LIMIT) * 1e6).astype(np.int64).sum(axis=0)
                n += len(pdf)
        yield pd.DataFrame({"place": np.arange(dim), "total": total, "n": n})

    out = np.zeros(dim)
    if dim:
        sums = vectors.select("embedding").mapInPandas(run, "place long, total long, n long").groupBy("place")
        for row in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
            out[row["place"]] = float(row["total"]) / row["n"] / 1e6
    return out


def sign_codes(vectors: DataFrame, dim: int, about: np.ndarray | None = None) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, code): one segment a number, a bit set where the component is above ``about`` (0)."""
    lengths = segment_lengths(dim, max(4, min(MOST_SEGMENT_BITS, round(math.log2(max(vectors.count(), 2))))))
    edges = np.cumsum([0, *lengths])[:-1]
    bar = np.zeros(dim) if about is None else about

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = np.concatenate([1 << np.arange(n) for n in lengths]).astype(np.int64)
        for pdf in batches:
            if len(pdf):
                code = np.add.reduceat((np.stack(list(pdf["embedding"])).astype(np.float64) > bar) * weight, edges, axis=1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "code": list(code.astype(np.int32))})

    if not dim:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.array().cast("array<int>").alias("code")).limit(0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "vec_id long, code array<int>")


def smallest(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of every key; the limit works before the shuffle too."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


class Index(NamedTuple):
    """Distinct codes (code, ids: ascending), how many, and the neighbours that a query wants."""

    classes: DataFrame
    size: int
    k: int


class Codes(NamedTuple):
    """Distinct codes of a tile, a segment a column, and their ids: those of row i from ``start[i]`` to ``start[i + 1]``."""

    code: np.ndarray
    start: np.ndarray
    ids: np.ndarray


def words(code: np.ndarray) -> np.ndarray:
    """The segments of each row, four to a 64-bit word."""
    out = np.zeros((code.shape[1] + 3 >> 2, len(code)), dtype=np.uint64)
    for j in range(code.shape[1]):
        out[j >> 2] |= code[:, j].astype(np.uint64) << np.uint64(MOST_SEGMENT_BITS * (j & 3))
    return out


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def first_of(query: np.ndarray, distance: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest (distance, name) of every query, in order."""
    order = np.lexsort((name, distance, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def search_tile(names: np.ndarray, asked: np.ndarray, bound: np.ndarray, codes: Codes, lengths: list[int], radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, distances and ids of the ``k`` nearest ids of every query among the codes that it meets first at
    this radius, none farther than its ``bound``."""
    own, other, bound = words(asked), words(codes.code), bound.copy()
    kind = np.uint8 if sum(lengths) < 256 else np.int32
    masks = np.array(ring(lengths[0], radius), dtype=np.int32)
    best = [np.empty(0, dtype=np.int64) for _ in range(4)]  # query, distance, first id, code
    fresh: list[list[np.ndarray]] = []

    def met(q: np.ndarray, at: np.ndarray, size: np.ndarray, j: int) -> None:
        """Take in the ``size`` codes from place ``at`` on that each query of ``q`` meets in segment ``j``."""
        place = runs(at, size)
        d = sum(np.bitwise_count(np.repeat(x[q], size) ^ y[place]).astype(kind, copy=False) for x, y in zip(own, table, strict=True))
        near = np.flatnonzero(d <= np.repeat(bound[q].astype(kind), size))
        q, d, c = q[np.searchsorted(np.cumsum(size), near, side="right")], d[near].astype(np.int64), order[place[near]]
        apart = np.bitwise_count(asked[q] ^ codes.code[c])
        new = (apart[:, :j] > radius).all(axis=1) & (apart[:, j:] >= radius).all(axis=1)
        q, d, c = q[new], d[new], c[new]
        first = codes.ids[codes.start[c]]
        mine = first == names[q]  # the next id stands for the code then, if there is one
        spare = codes.start[c + 1] - codes.start[c] > 1
        first = np.where(mine, codes.ids[np.minimum(codes.start[c] + 1, len(codes.ids) - 1)], first)
        some = ~mine | spare
        fresh.append([x[some] for x in (q, d, first, c)])
        if sum(len(x[0]) for x in fresh) > max(PAIRS_AT_ONCE, len(best[0])):
            merge()

    def merge() -> None:
        """Keep the nearest of what was taken in, and tighten bounds."""
        nonlocal best
        pool = [np.concatenate(x) for x in zip(best, *fresh, strict=True)]
        fresh.clear()
        kept = first_of(*pool[:3], k)
        best = [a[kept] for a in pool]
        if len(kept):
            full = np.flatnonzero(np.bincount(best[0]) == k)
            last = np.searchsorted(best[0], full, side="right") - 1
            bound[full] = np.minimum(bound[full], best[1][last])

    for j, bits in enumerate(lengths):
        order = np.argsort(codes.code[:, j].astype(np.uint16), kind="stable")  # by radix
        table = other[:, order]
        begin = np.concatenate([[0], np.cumsum(np.bincount(codes.code[:, j], minlength=1 << bits))])
        ours = masks[masks < 1 << bits]
        step = max(1, PROBES_AT_ONCE // max(1, len(ours)))
        # what is met first here differs by radius + 1 bits in the segments before, by radius bits in this and those after
        going = np.flatnonzero(bound >= len(lengths) * radius + j)
        for lo in range(0, len(going), step):
            value = asked[going[lo : lo + step], j, None] ^ ours
            size = (begin[value + 1] - begin[value]).ravel()
            some = np.flatnonzero(size)
            size, q, at = size[some], going[some // max(1, len(ours)) + lo], begin[value.ravel()[some]]
            ends = np.cumsum(size)
            a = 0
            while a < len(size):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
                met(q[a:b], at[a:b], size[a:b], j)
                a = b
        merge()
    q, d, _, c = best
    size = codes.start[c + 1] - codes.start[c]
    q, d, name = np.repeat(q, size), np.repeat(d, size), codes.ids[runs(codes.start[c], size)]
    others = name != names[q]
    q, d, name = q[others], d[others], name[others]
    kept = first_of(q, d, name, k)
    return q[kept], d[kept], name[kept]


def _tile(lengths: list[int], radius: int, k: int):
    m = len(lengths)

    def run(tile: pa.Table) -> pa.Table:
        code = tile["code"].combine_chunks().flatten().to_numpy().reshape(-1, m)
        asks = tile["query_id"].is_valid().to_numpy()
        asked, names = code[asks], tile["query_id"].drop_null().to_numpy()
        bound = tile["bound"].drop_null().to_numpy()
        ids = tile["ids"].combine_chunks().drop_null()
        start = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        codes = Codes(code[~asks], start, ids.flatten().to_numpy())
        if len(names) and len(codes.code):
            q, d, name = search_tile(names, asked, bound, codes, lengths, radius, k)
        else:
            q = d = name = np.empty(0, dtype=np.int64)
        qcode = pa.ListArray.from_arrays(np.arange(0, len(q) * m + 1, m, dtype=np.int32), pa.array(asked[q].ravel(), pa.int32()))
        return pa.table({"query_id": pa.array(names[q], pa.int64()), "qcode": qcode, "distance": pa.array(d, pa.int64()), "vec_id": pa.array(name, pa.int64())})

    return run


def _met(active: DataFrame, index: Index, lengths: list[int], radius: int) -> DataFrame:
    """(query_id, qcode, distance, vec_id): for each query and block of codes the nearest of those met first at this radius."""
    m, asking = len(lengths), active.count()
    probes = asking * m * math.comb(lengths[0], radius)
    tiles = min(MOST_TILES, parts_for(probes + probes * index.size // (1 << lengths[0]), PAIRS_A_TILE))
    cores = active.sparkSession.sparkContext.defaultParallelism
    across = max(parts_for(index.size * m, max(BROADCAST_ENTRIES, 64 * m)), min(parts_for(index.size, LEAST_CODES), cores), min(parts_for(index.size, FAIR_CODES), tiles))
    down = max(parts_for(tiles, across), parts_for(asking, MOST_QUERIES))
    block = lambda parts, *names: F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = active.select(block(down, "query_id", "qcode").alias("row"), each(across).alias("column"), "query_id", "bound", F.col("qcode").alias("code"), F.lit(None).cast("array<long>").alias("ids"))
    right = index.classes.select(each(down).alias("row"), block(across, "code").alias("column"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("bound"), "code", "ids")
    # tiles are alike in work, not in bytes: twice as many tasks, so that few get more than one
    dealt = left.unionByName(right).repartition(2 * across * down if across * down > 1 else 1, "row", "column")
    return dealt.groupBy("row", "column").applyInArrow(_tile(lengths, radius, index.k), "query_id long, qcode array<int>, distance long, vec_id long")


def top_k(codes: DataFrame, dim: int, is_query: Column, k: int = 10) -> DataFrame:
    """(vec_id, code) -> query_id, rank, vec_id, distance; queries are the rows where ``is_query`` holds."""
    codes = cut(codes.distinct())
    sample = codes.first()
    if sample is None:
        return codes.select(F.col("vec_id").alias("query_id"), F.lit(0).cast("long").alias("rank"), "vec_id", F.lit(0).cast("long").alias("distance"))
    lengths = split(dim, len(sample["code"]))
    classes = cut(smallest(codes, ["code"], ["vec_id"], k + 1).groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # k + 1 at most
    index = Index(classes, classes.count(), k)
    active = cut(codes.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("code").alias("qcode"), F.lit(dim).cast("long").alias("bound")))
    best, keys = None, ["query_id", "qcode"]
    for radius in range(lengths[-1] + 1):
        near = _met(active, index, lengths, radius)
        best = cut(smallest(near if best is None else near.unionByName(best), keys, ["distance", "vec_id"], k))
        # what is not met yet is at least this far away
        unseen = len(lengths) * (radius + 1)
        full = best.groupBy(*keys).agg(F.count("*").alias("n"), F.max("distance").alias("worst")).where(F.col("n") == k)
        active = active.join(full, keys, "left").where(F.col("worst").isNull() | (F.col("worst") >= unseen))
        active = cut(active.select(*keys, F.coalesce("worst", "bound").alias("bound")))
        if active.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "vec_id"))
    return best.withColumn("rank", rank.cast("long")).select("query_id", "rank", "vec_id", "distance")
