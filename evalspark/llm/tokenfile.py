"""Token files with Re-Pair grammar compression.

Documents go in ascending order of doc_id over range partitions. A partition writes shards of about a million ids, each
with a grammar of its own. In a shard the pairs of neighbouring symbols that occur most often are replaced by new
symbols until no pair occurs twice: a round counts the non-overlapping occurrences of every pair, replaces those of all
pairs at or above a falling bar (of overlapping pairs the more frequent wins), and ends at the bar two. There is no
bound on rounds, rules or the length of a rule. Pairs that occur once can never occur more often unless a neighbour is
replaced, so a round sorts only the places that are still open. A shard stores the rules, the expansion length of every
rule and where each document begins among the symbols, so one document, or any range of ids, is decoded without the
rest. Shards are rows of a Parquet table, which Spark commits as a whole; nothing is written beside it.

Shard: b"RPG2", counts (little-endian u32: ids, symbols, rules, documents, first new symbol, rounds), first new symbol of
each round, left and right symbols of the rules, expansion lengths, start of each document among symbols and ids,
symbols (all u32).

Defined cases: a null text encodes as an empty one (its end id alone); equal doc_ids keep each their own row, in order
of the texts' hashes; null doc_ids come first; every long is a sound doc_id; a document longer than a shard has one of
its own; an empty table gives an empty file set.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, ensure_checkpoint_dir
from .tokens import SpacedEncoder, encoder, spread

END_ID = 2
SHARD_IDS = 1 << 20
#: Least count of a pair in the first round, and the factor by which it falls from round to round down to two.
FIRST_COUNT, FALL = 16, 8
#: Rules up to this many ids are laid out for decoding; longer ones are opened down to these.
LAID_OUT = 64
MAGIC = b"RPG2"
_FREE = np.int32(2**31 - 1)


def _sorted_pairs(x: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left << bits | right) that begin at the places ``at``, in order, and their places."""
    key = x[at].astype(np.uint64)
    key <<= np.uint64(bits)
    key |= x[at + 1]
    place_bits = int(len(x)).bit_length()
    if place_bits + 2 * bits > 64:
        order = np.argsort(key, kind="stable")
        return key[order], at[order]
    key <<= np.uint64(place_bits)  # pair and place in one number need one sort
    key |= at.view(np.uint64)
    key.sort()
    at = (key & np.uint64((1 << place_bits) - 1)).view(np.int64)
    key >>= np.uint64(place_bits)
    return key, at


def _apart(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without every second place of a run in which a pair overlaps itself."""
    touch = np.flatnonzero((key[1:] == key[:-1]) & (at[1:] - at[:-1] == 1)) + 1
    if not len(touch):
        return key, at
    run = np.flatnonzero(np.append(True, np.diff(touch) != 1))
    inside = np.arange(len(touch)) - np.repeat(run, np.diff(np.append(run, len(touch))))
    fine = np.ones(len(key), dtype=bool)
    fine[touch[inside % 2 == 0]] = False
    return key[fine], at[fine]


def _winners(place: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places that overlap, those whose pair ranks first; in a second pass those that lost to none of the winners."""
    best = np.full(n + 2, _FREE, dtype=np.int32)  # best[i + 1]: rank of the pair at i
    best[place + 1] = rank
    out = []
    for _ in range(2):
        wins = (rank < best[place]) & (rank < best[place + 2])
        w = place[wins]
        out.append((w, rank[wins]))
        best[w] = best[w + 1] = best[w + 2] = _FREE
        open_ = ~wins & (best[place + 1] != _FREE)
        place, rank = place[open_], rank[open_]
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def compress(ids: np.ndarray, ends: np.ndarray, first: int = FIRST_COUNT, fall: int = FALL) -> bytes:
    """A shard of ``ids`` whose documents end before the places ``ends``; rules never cross a document."""
    x = ids.astype(np.uint32)
    last = np.zeros(len(x), dtype=bool)
    last[ends - 1] = True
    open_ = ~last  # places whose pair may occur again
    base = symbols = int(x.max(initial=0)) + 1
    bases, lefts, rights = [], [], []
    bar = first
    while len(at := np.flatnonzero(open_)) > 1:
        bits = symbols.bit_length()
        key, at = _apart(*_sorted_pairs(x, at, bits))
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(edge, len(key)))
        if (most := int(count.max())) < 2:
            break
        bar = max(2, min(bar, most))
        open_[at[edge[count < 2]]] = False
        good = np.flatnonzero(count >= bar)
        good = good[np.argsort(-count[good], kind="stable")]  # most frequent first
        n = count[good]
        place, rank = _winners(spread(at, edge[good], n), np.repeat(np.arange(len(good), dtype=np.int32), n), len(x))
        real = np.bincount(rank, minlength=len(good)) >= 2  # the first always is
        fine = real[rank]
        place, rank = place[fine], rank[fine]
        pair = key[edge[good[real]]]
        bases.append(symbols)
        lefts.append((pair >> np.uint64(bits)).astype("<u4"))
        rights.append((pair & np.uint64((1 << bits) - 1)).astype("<u4"))
        x[place] = (np.cumsum(real, dtype=np.uint32) + np.uint32(symbols - 1))[rank]
        last[place] = last[place + 1]
        before = place[place > 0] - 1
        open_[place], open_[before] = ~last[place], ~last[before]
        keep = np.ones(len(x), dtype=bool)
        keep[place + 1] = False
        x, last, open_ = x[keep], last[keep], open_[keep]
        symbols += len(pair)
        bar //= fall
    left, right = (np.concatenate(z) if z else np.zeros(0, dtype="<u4") for z in (lefts, rights))
    length = np.ones(len(left) + 1, dtype="<u4")  # the last stands for all ids
    for lo, hi in pairwise([*bases, symbols]):
        part = slice(lo - base, hi - base)
        length[part] = sum(length[np.where(side[part] >= base, side[part] - np.uint32(base), len(left))] for side in (left, right))
    starts = np.append(0, np.flatnonzero(last) + 1)[: len(ends)]
    id_starts = np.append(0, ends)[: len(ends)]
    head = [len(ids), len(x), len(left), len(ends), base, len(bases)]
    return MAGIC + b"".join(np.asarray(part).astype("<u4").tobytes() for part in (head, bases, left, right, length[:-1], starts, id_starts, x))


class Shard:
    """Random access to a written shard."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        words = np.frombuffer(raw, "<u4", offset=4)
        self.n_ids, n_symbols, n_rules, self.n_docs, self.base, n_rounds = map(int, words[:6])
        cuts = np.cumsum([6, n_rounds, n_rules, n_rules, n_rules, self.n_docs, self.n_docs])
        self.bases, self.left, self.right, self.rule_length, self.starts, self.id_starts, self.symbols = np.split(words, cuts)[1:]
        self.flat = self.offsets = None

    def _lay_out(self) -> None:
        """Expansions of all rules of at most ``LAID_OUT`` ids, in order; a rule's parts are older than itself."""
        width = np.where(self.rule_length <= LAID_OUT, self.rule_length, 0).astype(np.int64)
        self.offsets = np.cumsum(width) - width
        self.flat = np.empty(int(width.sum()), dtype="<u4")
        for lo, hi in pairwise([*(self.bases - self.base).tolist(), len(self.left)]):
            rules = np.flatnonzero(width[lo:hi]) + lo
            shift = self.offsets[rules]
            for part in (self.left[rules], self.right[rules]):
                new = part >= self.base
                self.flat[shift[~new]] = part[~new]
                older = part[new].astype(np.int64) - self.base
                w = width[older]
                copied = spread(self.flat, self.offsets[older], w)
                self.flat[spread(np.arange(len(self.flat)), shift[new], w)] = copied
                shift = shift + np.where(new, width[np.where(new, part.astype(np.int64) - self.base, 0)], 1)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols."""
        if self.flat is None:
            self._lay_out()
        x = symbols
        while len(long := np.flatnonzero(x >= self.base)) and len(long := long[self.rule_length[x[long] - self.base] > LAID_OUT]):
            rule = x[long] - self.base
            x = np.insert(x, long + 1, self.right[rule])
            x[long + np.arange(len(long))] = self.left[rule]
        new = np.flatnonzero(x >= self.base)
        rule = x[new].astype(np.int64) - self.base
        width = np.ones(len(x), dtype=np.int64)
        width[new] = self.rule_length[rule]
        # terminals lie behind the rules' expansions, so that one gather serves both
        start = np.arange(len(x), dtype=np.int64) + len(self.flat)
        start[new] = self.offsets[rule]
        return spread(np.concatenate((self.flat, x)), start, width)

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard alone."""
        stop = self.starts[k + 1] if k + 1 < self.n_docs else len(self.symbols)
        return self.expand(self.symbols[self.starts[k] : stop])

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard: expansion lengths tell which symbols cover them."""
        length = np.ones(len(self.symbols), dtype=np.int64)
        new = self.symbols >= self.base
        length[new] = self.rule_length[self.symbols[new] - self.base]
        upto = np.cumsum(length)
        a, b = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left") + 1
        skip = start - (int(upto[a - 1]) if a else 0)
        return self.expand(self.symbols[a:b])[skip : skip + stop - start]


SCHEMA = "part int, shard int, n_docs long, n_ids long, doc_ids array<long>, blob binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encode every text, append ``end_id`` and write the shards to the Parquet table ``path`` in order of doc_id.

    Ranges are cut by id, hash of the text and place in the scan, so that no id, however many rows it has, is one task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("doc_id", "_hash", "_place")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part, shard = encoder(tokenizer_path, SpacedEncoder), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, names, held = [], [], 0

        def flush() -> pd.DataFrame:
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            blob = compress(np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(lengths))
            return pd.DataFrame({"part": [part], "shard": [shard], "n_docs": [len(ids)], "n_ids": [int(lengths.sum())], "doc_ids": [names], "blob": [blob]})

        for pdf in batches:
            doc_ids = pdf["doc_id"].astype("Int64")
            for doc_id, x in zip(doc_ids, enc.encode(list(pdf["text"])), strict=True):
                ids.append(x + end)
                names.append(None if doc_id is pd.NA else int(doc_id))
                held += len(x) // 4 + 1
                if held >= SHARD_IDS:
                    yield flush()
                    ids, names, held, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    rows.mapInPandas(run, SCHEMA).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for part, shard, names, blob in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("doc_ids"), b.column("blob"), strict=True):
                s = Shard(blob.as_py())
                cuts = np.append(s.id_starts, s.n_ids).astype(np.int64)
                raw = memoryview(s.all_ids().tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                n = s.n_docs
                columns = [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), names.values, cuts[:-1], np.diff(cuts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "shard", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    offsets = shards.join(parts, "part").select("part", "shard", (F.col("ahead") + F.col("before")).alias("offset"))
    rows = files.select("part", "shard", "doc_ids", "blob").mapInArrow(run, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
