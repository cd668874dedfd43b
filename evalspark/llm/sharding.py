"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups are dealt into chunks; inside a chunk the differencing method keeps a heap of partial partitions (one sum per
shard) and always joins the two of largest spread in opposite order. A chunk ends as one partial partition, and those
are differenced again in the same way, node by node of a tree, so that no task holds more than a chunk or a node.

Defined cases: size is the UTF-8 bytes of the text plus 1 (null text: 1); null texts form one group, empty texts
another; groups are never divided, so one group larger than a shard's share bounds the balance that is possible;
repeated rows are separate rows of one group, and a null doc_id is a row like others; groups of equal size go by digest, so
reruns agree; a very long text is one size and one digest, read once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ordered_sums, parts_for

SHARDS = 8
GROUPS_A_CHUNK = 20_000
PARTS_A_NODE = 2_000


def difference(parts: list[list[tuple[int, int]]], shards: int) -> list[dict[int, int]]:
    """Karmarkar-Karp over partial partitions.

    ``parts[i]`` lists (sum, bin of part i). Returns for every part the shard of each of its bins.
    """
    heap: list[tuple] = []
    nodes: list[tuple] = []
    for i, sums in enumerate(parts):
        row = sorted(sums, reverse=True)[:shards]
        row += [(0, -1)] * (shards - len(row))
        nodes.append((i, None, [b for _, b in row]))
        values = [v for v, _ in row]
        heap.append((values[-1] - values[0], i, values))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        joined = sorted(((a[k] + b[shards - 1 - k], k) for k in range(shards)), reverse=True)
        low = joined[-1][0]
        n = len(nodes)
        nodes.append((x, y, [k for _, k in joined]))
        values = [v - low for v, _ in joined]
        heapq.heappush(heap, (values[-1] - values[0], n, values))
    places: list[dict[int, int]] = [{} for _ in parts]
    if not heap:
        return places
    todo = [(heap[0][1], list(range(shards)))]  # a node and the shard of each of its sorted bins
    while todo:
        n, at = todo.pop()
        x, y, order = nodes[n]
        if n < len(parts):
            places[n] = {b: at[k] for k, b in enumerate(order) if b >= 0}
            continue
        left, right = [0] * shards, [0] * shards
        for k, was in enumerate(order):
            left[was], right[shards - 1 - was] = at[k], at[k]
        todo += [(x, left), (y, right)]
    return places


def _chunk_bins(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "group"], ascending=[False, True], kind="stable")
        places = difference([[(int(w), 0)] for w in pdf["weight"]], shards)
        return pd.DataFrame({"group": pdf["group"], "chunk": pdf["chunk"], "weight": pdf["weight"], "bin": np.array([p[0] for p in places], dtype=np.int32)})

    return run


def _join_bins(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The partial partitions of one node, differenced: where each bin of each of its parts goes."""
        parts, ids = [], []
        for part, g in pdf.sort_values(["part", "bin"]).groupby("part"):
            ids.append(part)
            parts.append([(int(w), int(b)) for w, b in zip(g["weight"], g["bin"], strict=True)])
        node = int(pdf["node"].iloc[0])
        out = [(c, b, node, s) for c, place in zip(ids, difference(parts, shards), strict=True) for b, s in place.items()]
        return pd.DataFrame(out, columns=["part", "bin", "node", "to"])

    return run


def assign_groups(groups: DataFrame, shards: int = SHARDS, per_chunk: int = GROUPS_A_CHUNK, per_node: int = PARTS_A_NODE) -> DataFrame:
    """(group, weight) -> (group, shard). Chunks are joined in a tree whose nodes difference ``per_node`` partial partitions
    each, so no task holds more than a chunk's groups or a node's ``per_node * shards`` sums."""
    n = parts_for(groups.count(), per_chunk)
    chunked = groups.withColumn("chunk", F.pmod(F.xxhash64("group"), F.lit(n)).cast("int"))
    placed = cut(chunked.groupBy("chunk").applyInPandas(_chunk_bins(shards), "group binary, chunk int, weight long, bin int"))
    placed = placed.withColumnRenamed("chunk", "part")
    while n > 1:
        n = parts_for(n, per_node)
        sums = placed.groupBy("part", "bin").agg(F.sum("weight").alias("weight")).withColumn("node", F.pmod("part", F.lit(n)).cast("int"))
        moves = cut(sums.groupBy("node").applyInPandas(_join_bins(shards), "part int, bin int, node int, to int"))
        placed = cut(placed.join(moves, ["part", "bin"]).select("group", F.col("node").alias("part"), "weight", F.col("to").alias("bin")))
    return placed.select("group", F.col("bin").alias("shard"))


def number_rows(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within ``key``, over ranges of the rows."""
    return ordered_sums(rows, [key], order, {out: F.lit(1).cast("long")})


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    raw = F.col("text").cast("binary")
    group = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(raw, 256)))
    slim = cut(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), group.alias("group")))
    groups = cut(slim.groupBy("group").agg(F.sum("size").alias("weight")))
    placed = cut(slim.join(assign_groups(groups, shards), "group").select("doc_id", "size", "text_crc32", "shard"))
    out = number_rows(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
