"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are shares and rates taken from the whole text, never labels, language, source or id. Trees are grown
level by level on binned features and flattened into arrays (feature, threshold, value; children at 2i+1 and 2i+2), so
scoring a batch is one gather per level and tree. Training uses a bounded sample of labelled rows.

Defined cases: null text scores as the empty text, and an empty text has a score like any other; a very long text is read
whole; with no labelled row at all (an empty table, too) every score is the prior 0.5, and an empty table gives an empty
result; of rows that repeat a doc_id each is scored for itself, and one, that of the least text hash, is trained on;
labels that repeat a doc_id count as 1 if one of them is; of splits of equal gain the first feature and lowest threshold
win; a null doc_id is not held out and not trained on; other columns stay out, whatever their names.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Labelled rows that training may use, the documented bound of its sample: those with the least hash of their id.
SAMPLE_ROWS = 12_000
FOLDS, HELD_OUT_FOLD = 5, 0
ACCEPT = 0.3
TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 80, 4, 64, 0.15, 10, 1.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "top_word", "repeated_next", "letters", "digits", "spaces", "upper",
    "exclaim", "pipes", "stars", "percent", "amp", "dollar", "hash", "other_marks", "commas", "stops", "high_bytes", "lines", "distinct_lines",
    "words_a_line", "top_line", "short_lines", "marked_words", "upper_words", "pipe_lines", "repeat_run", "sentence_words", "license_words",
)

_CLASS = np.full(256, 9, dtype=np.uint8)  # marks not named below
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\v\f\r", 3), (b"!", 4), (b"|", 5), (b"*", 6), (b"%", 7), (b"&", 8), (b"$", 10), (b"#", 11), (b",", 12), (b".", 13)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 14
_MARKED = re.compile(r"[!*%&$#]{2,}(?=\s|$)")
_LICENSE = re.compile(r"(?i)\b(?:licen[sc]e|licensed|copyright|all rights reserved)\b")


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    c = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=15)
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    same = list(map(operator.eq, words, words[1:]))
    run = best = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            if run > best:
                best = run
    lines = [x for x in text.split("\n") if x]
    k = max(len(lines), 1)
    line_counts = Counter(lines)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), n / w, sum(v for x, v in counts.items() if len(x) > 15) / w, len(counts) / w, max(counts.values(), default=0) / w, sum(same) / w,
        (c[0] + c[1]) / n, c[2] / n, c[3] / n, c[1] / n, c[4] / n, c[5] / n, c[6] / n, c[7] / n, c[8] / n, c[10] / n, c[11] / n, c[9] / n, c[12] / n, c[13] / n, c[14] / n,
        np.log1p(len(lines)), len(line_counts) / k, w / k, max(line_counts.values(), default=0) / k, sum(len(x) < 20 for x in lines) / k,
        len(_MARKED.findall(text)) / w, sum(v for x, v in counts.items() if len(x) > 1 and x.isupper()) / w, sum("|" in x for x in lines) / k,
        np.log1p(best), w / max(c[13] + c[4], 1), len(_LICENSE.findall(text)) / k,
    ]


@dataclass(frozen=True)
class Model:
    """Flattened trees: ``feature`` and ``threshold`` of inner nodes, ``value`` of leaves, one row a tree."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(np.log2(self.feature.shape[1] + 1)) if self.feature.size else 0
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            raw += v[node - len(f)]
        return 1.0 / (1.0 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Model:
    """Logistic boosting on histograms of gradients; equal input gives an equal model."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Model(0.0, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    usable = np.stack([np.arange(bins) < len(e) for e in edges])
    raw = np.full(len(y), prior)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)  # place within its level
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            k = 2**level
            key = ((node[:, None] * d + np.arange(d)) * bins + binned).ravel()
            G, H, N = (np.bincount(key, weights=np.repeat(z, d), minlength=k * d * bins).reshape(k, d, bins).cumsum(axis=2) for z in (g, h, np.ones(len(y))))
            tot = lambda a: a[:, :1, -1:]
            gain = G**2 / (H + L2) + (tot(G) - G) ** 2 / (tot(H) - H + L2) - tot(G) ** 2 / (tot(H) + L2)
            gain[(N < LEAST_ROWS) | (tot(N) - N < LEAST_ROWS) | ~usable[None]] = -np.inf
            flat = gain.reshape(k, -1)
            best = flat.argmax(axis=1)
            ok = flat[np.arange(k), best] > 1e-9
            bf, bb = np.where(ok, best // bins, 0), np.where(ok, best % bins, bins)
            for i in range(k):
                f[k - 1 + i] = bf[i]
                t[k - 1 + i] = edges[bf[i]][bb[i]] if ok[i] else np.inf
            node = 2 * node + (binned[np.arange(len(y)), bf[node]] > bb[node])
        v = -rate * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + L2)
        raw += v[node]
        fs.append(f)
        ts.append(t)
        vs.append(v)
    return Model(prior, np.array(fs), np.array(ts), np.array(vs))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled documents outside the held-out fold."""
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("hash")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["text"]], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"].astype("int32"), "hash": pdf["hash"], "x": list(x)})

    found = texts.mapInPandas(run, "doc_id long, quality int, hash long, x array<double>")
    # one row an id, so that the driver gets ``rows`` rows at most however often an id is repeated
    pdf = found.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "hash").alias("r")).select("doc_id", "r.*").toPandas()
    pdf = pdf.sort_values("doc_id", kind="stable")
    x = np.array(list(pdf["x"]), dtype=np.float64).reshape(-1, len(FEATURES))
    return x, pdf["quality"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return fit(*training_rows(docs, labels, rows))


def score_documents(docs: DataFrame, model: Model, accept: float = ACCEPT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns named in ``keep``, for every row of ``docs``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["_text"]], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pdf.drop(columns="_text").assign(score=model.score(x))

    rows = docs.select(*keep, F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[: len(keep)])
    scored = rows.mapInPandas(run, f"{fields}_id string, score double")
    held = F.coalesce(F.crc32(F.col("_id").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    return scored.select(F.col("_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"), *keep)


def keep_good(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns, in one pass."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= accept))

    return docs.mapInArrow(run, docs.schema)
