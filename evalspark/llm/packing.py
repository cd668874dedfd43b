"""Best-fit packing with large-item matching.

Lengths are whole numbers up to the capacity, so the packing is decided on the histogram of lengths, which has at most
``capacity`` rows however large the corpus is: pieces above a third of the capacity go at most two to a sequence,
matched greedily (the largest with the largest that still fits), and smaller pieces fill the smallest gap that takes
them. The outcome is a list of patterns with multiplicities; pieces are ranked within their length and look their
pattern up, so every row finds its sequence and offset by itself.

Ranks are counted over ranges of the rows, so neither a common length nor a repeated row is one task.

Defined cases: a null text packs as an empty one (its end id alone); documents above the capacity are cut into pieces
of the capacity, the last one shorter; equal rows are packed each for itself; an empty table packs to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .sharding import number_rows
from .tokens import WordEncoder, encoder

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def match_lengths(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of sequences, [(length, how many in each)]) that use ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    third = capacity // 3  # a piece is large if three of its kind overflow a sequence
    open_bins: dict[int, list[list]] = {}  # gap -> [number of sequences, contents]
    gaps: list[int] = []  # in ascending order

    def put(gap: int, n: int, contents: list[tuple[int, int]]) -> None:
        if gap not in open_bins:
            open_bins[gap] = []
            at = np.searchsorted(gaps, gap) if gaps else 0
            gaps.insert(int(at), gap)
        open_bins[gap].append([n, contents])

    large = [x for x in range(capacity, third, -1) if left[x]]
    large_up = sorted(large)
    for a in large:
        while left[a]:
            # the largest partner that fits beside a
            at = int(np.searchsorted(large_up, min(capacity - a, a), side="right")) - 1
            while at >= 0 and (left[large_up[at]] == 0 or (large_up[at] == a and left[a] < 2)):
                at -= 1
            if at < 0:
                put(capacity - a, int(left[a]), [(a, 1)])
                left[a] = 0
            elif (b := large_up[at]) == a:
                n = int(left[a]) // 2
                left[a] -= 2 * n
                put(capacity - 2 * a, n, [(a, 2)])
            else:
                n = int(min(left[a], left[b]))
                left[a] -= n
                left[b] -= n
                put(capacity - a - b, n, [(a, 1), (b, 1)])
    for s in range(third, 0, -1):
        n = int(left[s])
        while n:
            at = int(np.searchsorted(gaps, s)) if gaps else 0
            if at == len(gaps):  # no gap takes it: open sequences
                fits = capacity // s
                if full := n // fits:
                    put(capacity - fits * s, full, [(s, fits)])
                if rest := n - full * fits:
                    put(capacity - rest * s, 1, [(s, rest)])
                n = 0
                continue
            gap = gaps[at]
            group = open_bins[gap]
            bins, contents = group.pop()
            if not group:
                del open_bins[gap]
                gaps.pop(at)
            fits = gap // s
            full = min(bins, n // fits)
            if full:
                put(gap - fits * s, full, [*contents, (s, fits)])
                n -= full * fits
                bins -= full
            elif n:
                put(gap - n * s, 1, [*contents, (s, n)])
                n, bins = 0, bins - 1
            if bins:
                put(gap, bins, contents)
    return [(n, contents) for gap in gaps for n, contents in open_bins[gap]]


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of ranks of one length that share a pattern: where they begin and which sequences and offsets they get."""
    rows, used, first = [], {}, 0
    for n, contents in patterns:
        offset = 0
        for length, each in contents:
            rank = used.get(length, 0)
            rows.append((length, rank, first, each, offset))
            used[length] = rank + n * each
            offset += length * each
        first += n
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "each": a[:, 3], "offset": a[:, 4]}


def place(lengths: np.ndarray, ranks: np.ndarray, slots: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each (length, rank within length)."""
    shift = 1 << 44  # ranks of one length stay below
    at = np.searchsorted(slots["length"] * shift + slots["rank"], lengths * shift + ranks, side="right") - 1
    inside = ranks - slots["rank"][at]
    each = slots["each"][at]
    return slots["sequence"][at] + inside // each, slots["offset"][at] + (inside % each) * lengths


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> one row per piece; with ``with_ids`` the ids themselves (little-endian 32-bit) come along."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path, WordEncoder)
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], enc.encode(list(pdf["text"])), strict=True):
                ids += end
                for k, i in enumerate(range(0, len(ids), step)):
                    part = ids[i : i + step]
                    rows.append((doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, PIECES + (", ids binary" if with_ids else ""))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length (and whatever else they carry)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    slots = slot_table(match_lengths(counts, capacity))
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = number_rows(pieces, "length", order, "_rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, off = place(pdf["length"].to_numpy(np.int64), pdf.pop("_rank").to_numpy(np.int64), slots)
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf.assign(sequence_id=seq, offset=off)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(cut(cut_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
