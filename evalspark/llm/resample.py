"""Resampling documents towards a target distribution by importance weights of hashed word runs, drawn with Gumbel keys.

Features are all runs of 1 to 3 consecutive words, hashed by crc32 into ``BUCKETS``; a run's crc goes on from that of the
run before it, so no run is ever put together. Counts of all documents and of the target's texts, one row a task and
bucket, give each bucket an integer gain; a second pass adds up gains with one array look-up a feature. Scores are whole
numbers, so the draw needs no sort of the documents: a histogram of scores, summed from the top over ranges, gives each
score the rank at which it begins; scores that begin below the number to draw survive, and only their documents are
numbered, by doc_id within a score.

Defined cases: a null or empty text has no words; a null doc_id hashes as an empty one and comes first among ties;
repeated rows are drawn each for itself (of wholly equal rows any may come first); documents of fewer than ``LEAST_WORDS``
words are scored but never drawn; very long texts are cut into words piece by piece; without target texts every gain
follows from the documents' counts alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, ordered_sums

BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = "42"
#: Words of a text that are held at once.
PIECE = 1 << 16
#: Bytes to what they stand for: ASCII letters in lower case, digits and parts of other characters; all else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def run_buckets(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and buckets of the runs that end in them, for each piece of a text in UTF-8."""
    rest, one, two = text.translate(_LETTERS), None, None
    while rest:
        words = rest.split(None, PIECE)
        rest = words.pop() if len(words) > PIECE else b""
        if not words:
            return
        after = [b" " + w for w in words]
        ones = list(map(crc32, words))
        # a run goes on from the next shorter one that ends one word before
        twos = list(map(crc32, after[one is None :], ones if one is None else [one, *ones]))
        threes = list(map(crc32, after[(one is None) + (two is None) :], twos if two is None else [two, *twos]))
        one, two = ones[-1], (twos[-1] if twos else two)
        yield len(words), np.array(ones + twos + threes, dtype=np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of each bucket in all of ``texts``; the driver gets BUCKETS sums."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, held, features = np.zeros(BUCKETS, dtype=np.int64), [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                for _, found in run_buckets(text):
                    held.append(found)
                    features += len(found)
                    if features > 16 * PIECE:
                        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, features = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *held]), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = texts.where("text is not null").select(F.col("text").cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found.collect():  # BUCKETS at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from its counts in the documents and in the target, rounded down to thousandths."""
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """The document's Gumbel key in thousandths, from the first 32 bits of sha256(seed:doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def score_documents(docs: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = features = weight = 0
                for n, found in run_buckets(text or b""):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                out.append((words, features, weight))
            columns = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(columns[:, k]) for k in range(3)]], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def draw(scored: DataFrame, percent: int = DRAWN_PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score, ...) with rank: 1, 2, 3, ... of the drawn rows, null for the others."""
    fit = scored.where(F.col("n_words") >= least)
    histogram = cut(fit.groupBy("score").agg(F.count("*").alias("n")).withColumn("down", -F.col("score")))
    number = (histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * percent // 100
    above = ordered_sums(histogram, [], ["down"], {"above": F.col("n")}).where(F.col("above") < number)
    above = cut(above.select(F.col("score").alias("of_score"), "above"))
    cutoff = above.agg(F.min("of_score")).first()[0]
    unranked = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select("*", unranked)
    high = (F.col("n_words") >= least) & (F.col("score") >= cutoff)
    placed = ordered_sums(cut(scored.where(high)), ["score"], ["doc_id"], {"place": F.lit(1).cast("long")})  # row numbers of a score, over ranges of its rows
    ranked = placed.join(above, F.col("score") == F.col("of_score")).withColumn("rank", F.col("above") + F.col("place") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= number, F.col("rank"))).select(*scored.columns, "rank")
    return scored.where(~high).select("*", unranked).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(cut(score_documents(docs, gain)), percent).select("doc_id", "n_features", "weight", "score", "rank")
