"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors in double precision, heaps.

Query rows and candidate rows are dealt to blocks of bounded size; a tile is one block of queries against one block of
candidates, so each row travels once a block of the other side and no pair leaves a tile. In a tile rows are taken about
the candidates' mean and rounded to int8 with a scale a row. Products of the codes are exact (float32 holds sums of up to
``EXACT_TERMS`` of them), so by the norms of what rounding left each distance lies within known bounds. A pair whose
lower bound is above the (k + 1)-th upper bound, or above the k-th distance in the query's heap, cannot be an answer;
the distances of all others are computed anew from the original numbers. Tiles hand on at most k rows a query, which a
ranked window merges. The result is exact.

The work is that of a query set against all rows, n * n / 100 products for queries of one in a hundred. Candidates with
equal vectors are one row with their k + 1 smallest ids, so copies cost nothing.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor does a null vec_id; a query's own id is no answer; equal distances go by the smaller id; repeated equal rows
count once; of an id that is repeated with other vectors each is a query and each may be found; with fewer than k
candidates all are given; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for
from .hamming import smallest
from .itq import common_length, number_kind, packed, usable

#: Products of two int8 codes that float32 adds up exactly: 127 * 127 * 1024 < 2**24.
EXACT_TERMS = 1024
#: Bytes of vectors in the blocks of a tile.
QUERY_BLOCK_BYTES, CANDIDATE_BLOCK_BYTES = 16 << 20, 32 << 20
#: Candidates that make a block of their own while there are fewer blocks than tasks.
LEAST_CANDIDATES = 256
#: Rows of a tile that are multiplied at once.
ROWS, COLUMNS = 256, 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows of ``x``, their scales, and the norms of what the codes leave over."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two int8 matrices."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT_TERMS):
        out += a[:, k : k + EXACT_TERMS].astype(np.float32) @ b[:, k : k + EXACT_TERMS].astype(np.float32).T
    return out


class Side:
    """One side of a tile: codes about ``mean`` and what the bounds need."""

    def __init__(self, rows: np.ndarray, mean: np.ndarray) -> None:
        x = rows.astype(np.float64) - mean
        self.codes, self.scale, self.rest = quantise(x)
        self.squares = (x * x).sum(axis=1)
        self.norm = np.sqrt(self.squares)

    def part(self, s: slice) -> tuple[np.ndarray, ...]:
        return self.codes[s], self.scale[s], self.rest[s], self.squares[s], self.norm[s]


def bounds(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all squared distances between two parts; ``slack`` covers the rounding of doubles."""
    codes, scale, rest, squares, norm = (x[:, None] if x.ndim == 1 else x for x in a)
    o_codes, o_scale, o_rest, o_squares, o_norm = b
    near = squares + o_squares - 2 * scale * o_scale * products(codes, o_codes)
    # a.b = qa.qb + qa.rb + ra.b, with |qa| <= |a| + |ra|
    off = 2 * ((norm + rest) * o_rest + rest * o_norm) + slack * (squares + o_squares)
    return near - off, near + off


def distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (i, j) from the original numbers."""
    out = np.empty(len(i))
    for k in range(0, len(i), ROWS * 64):
        s = slice(k, k + ROWS * 64)
        d = a[i[s]].astype(np.float64) - b[j[s]].astype(np.float64)
        out[s] = np.sqrt((d * d).sum(axis=1))
    return out


def search_tile(queries: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: list[np.ndarray], k: int) -> list[list[tuple[float, int]]]:
    """For each query at most ``k`` (distance, id) of the candidates ``rows``, whose ascending ids are ``ids``."""
    mean = rows.astype(np.float64).mean(axis=0)
    left, right = Side(queries, mean), Side(rows, mean)
    slack = 1e-12 * (1 + float(mean @ mean) / max(float(right.squares.mean()), 1e-300))
    first = np.array([x[0] for x in ids])
    heaps: list[list[tuple[float, int]]] = [[] for _ in names]  # of (-distance, -id): the worst on top
    worst = np.full(len(names), np.inf)
    for lo in range(0, len(rows), COLUMNS):
        b = right.part(slice(lo, lo + COLUMNS))
        for at in range(0, len(names), ROWS):
            low, high = bounds(left.part(slice(at, at + ROWS)), b, slack)
            bar = worst[at : at + ROWS] ** 2 * (1 + 1e-12)
            if high.shape[1] > k + 1:  # one of the k + 1 may be the query itself
                bar = np.minimum(bar, np.partition(high, k, axis=1)[:, k])
            i, j = np.nonzero(~(low > bar[:, None]))
            i, j = i + at, j + lo
            d = distances(queries, i, rows, j)
            order = np.lexsort((first[j], d, i))
            i, j, d = i[order], j[order], d[order]
            start = np.searchsorted(i, i)
            for p in np.flatnonzero(np.arange(len(i)) - start <= k).tolist():
                heap = heaps[i[p]]
                for name in ids[j[p]].tolist():
                    if name == names[i[p]]:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, (-d[p], -name))
                    elif heapq.heappushpop(heap, (-d[p], -name)) == (-d[p], -name):
                        break  # the ids that follow are no better
            for q in range(at, min(at + ROWS, len(names))):
                if len(heaps[q]) == k:
                    worst[q] = -heaps[q][0][0]
    return [[(-d, -name) for d, name in heap] for heap in heaps]


def _tile(dim: int, kind: str, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["ids"].isna().to_numpy()
        q, c = pdf[asks], pdf[~asks]
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "digest": [], "vec_id": [], "score": []})
        x, y = (np.frombuffer(b"".join(part["v"]), dtype=kind).reshape(-1, dim) for part in (q, c))
        found = search_tile(x, q["query_id"].to_numpy(dtype=np.int64), y, list(c["ids"]), k)
        out = [(n, g, name, d) for n, g, heap in zip(q["query_id"], q["digest"], found, strict=True) for d, name in heap]
        return pd.DataFrame(out, columns=["query_id", "digest", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score for the rows where ``is_query`` holds, over all rows."""
    spark = vectors.sparkSession
    dim, kind = common_length(vectors), number_kind(vectors)
    good = vectors.where(usable(F.col("embedding"), dim) & F.col("vec_id").isNotNull())
    rows = cut(packed(good, kind).dropDuplicates(["vec_id", "digest"]))
    classes = smallest(rows, ["digest"], ["vec_id"], k + 1).groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))  # k + 1 ids at most
    classes = cut(classes)
    queries = cut(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "digest", "v"))
    n, width = classes.count(), max(dim, 1) * int(kind[-1])
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(parts_for(n * width, CANDIDATE_BLOCK_BYTES), min(parts_for(n, LEAST_CANDIDATES), tasks))
    down = parts_for(queries.count() * width, QUERY_BLOCK_BYTES, 1)
    block = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = classes.select(F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("binary").alias("digest"), "v", "ids", block("digest", across).alias("column"), each(down).alias("row"))
    left = queries.select("query_id", "digest", "v", F.lit(None).cast("array<long>").alias("ids"), block("query_id", down).alias("row"), each(across).alias("column"))
    tiles = left.unionByName(right).groupBy("row", "column").applyInPandas(_tile(dim, kind, k), "query_id long, digest binary, vec_id long, score double")
    own = ["query_id", "digest"]
    best = smallest(cut(tiles), own, ["score", "vec_id"], k)
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
