"""Near-duplicate documents by min-max hashing, banding and exact confirmation on shingle sets.

Under each of ``PERMUTATIONS`` hash permutations both the minimum and the maximum of a document's shingles are kept, so
64 signature values cost 32 hash evaluations. Rows with equal sets are one class from the start, told apart by the
digest of the set. Candidates come from bands in two steps: first every class is held against the smallest member of
each of its bands, which settles large groups with one link a member; then the members of a band that are still in
different components are compared in blocks, likeliest pairs first. A pair is confirmed if its one-byte signatures agree
often enough; links are decided on the full sets. A block gives only links that join components, so no list of all
pairs of a group ever exists. Words are hashed for many documents at once, and no worker keeps anything from batch to
batch.

Defined cases: a text without words, or null, has the empty set, links with nothing and is kept; with one to four words
the whole sequence is the one shingle; rows that repeat a doc_id are judged each by its own text, so one may go and the
other stay; rows of one doc_id in one group share their fate, for they are one document; a null doc_id keeps a null
component_id and links with nothing; a very long text is hashed in windows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, free_prefix, parts_for
from .components import connected_components

SHINGLE_WORDS = 5
PERMUTATIONS = 32
VALUES = 2 * PERMUTATIONS
LINK_PERCENT = 85
#: Chance that no band holds a pair just at the threshold, at most; standard deviations that confirmation leaves below the mean.
MISS, DEVIATIONS = 1e-5, 4.3
#: Members of a band, and bytes of their sets, that one block of comparisons holds; larger bands are cut into block pairs.
BLOCK, BLOCK_BYTES = 1500, 8_000_000
#: Band members that are handed to Python together.
ROWS_A_CELL = 5000
#: Ids that may be broadcast to pick candidate texts in the scan (16 MB); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of the filter that picks texts when ids are more: 2^27, so at most 2^21 broadcast rows of 16 bytes.
FILTER_BITS = 1 << 27
#: Bytes that are hashed at once, and the longest word that the rolling hash takes; longer ones are hashed one by one.
WINDOW, LONG_WORD = 1 << 20, 64
_BLANKS = b" \t\n\v\f\r"

_rng = np.random.Generator(np.random.PCG64(20240607))
_POWERS = _rng.integers(1, 2**63, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None]
_ODD = (_rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_FOLD = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _rng.integers(1, 2**63, VALUES, dtype=np.uint64)


@lru_cache
def banding(percent: int) -> tuple[int, int, int]:
    """Bands, values a band, and agreeing signature bytes that a pair needs for confirmation, for links at ``percent``.

    Bands are as long as ``MISS`` allows, so that few pairs below the threshold meet: 16 of 4 at 85, 21 of 3 at 80.
    """
    p = percent / 100
    rows = max((r for r in range(1, VALUES + 1) if (1 - p**r) ** (VALUES // r) <= MISS), default=1)
    return VALUES // rows, rows, max(0, math.floor(VALUES * p - DEVIATIONS * math.sqrt(VALUES * p * (1 - p))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _rolling() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number a byte, and the powers of an odd base and of its inverse, all modulo 2**64."""
    rng = np.random.Generator(np.random.PCG64(20240608))
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 2**62)) * 4 + 1
    powers = [np.cumprod(np.append(np.uint64(1), np.full(WINDOW, x, dtype=np.uint64))) for x in (base, pow(base, -1, 2**64))]
    return table, *powers


def _window_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of at most ``WINDOW`` bytes; of more, if they are all one word."""
    import xxhash

    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.empty(len(b) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    hashes = np.zeros(len(start), dtype=np.uint64)
    if len(b) <= WINDOW:
        table, power, back = _rolling()
        upto = np.append(np.uint64(0), np.cumsum(table[b] * power[: len(b)], dtype=np.uint64))
        hashes = _mix((upto[end] - upto[start]) * back[start] ^ (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return start, hashes


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all words, window by window; a window ends at white space."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(at + WINDOW, len(raw))
        if end < len(raw):
            end = max(raw.rfind(c, at, end) for c in _BLANKS) + 1
            if end <= at:  # one word fills the window
                end = min((x for c in _BLANKS if (x := raw.find(c, at)) >= 0), default=len(raw))
        start, h = _window_words(raw[at:end])
        starts.append(start + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    h = np.full(max(n, 0), np.uint64(size) * _POWERS[-1], dtype=np.uint64)
    for k in range(size):
        h += words[k : k + max(n, 0)] * _POWERS[k]
    return _mix(h)


def shingle_sets_of(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    raw, held, at = [], 0, 0
    for i, t in enumerate(texts):
        # bytes: only A-Z become lower case, only ASCII white space parts words
        raw.append((t or "").encode("utf-8", "surrogatepass").lower())
        held += len(raw[-1])
        if held >= WINDOW or i + 1 == len(texts):
            first = np.cumsum([0, *(len(r) + 1 for r in raw)])
            starts, words = word_hashes(b" ".join(raw))
            every = _shingles(words, SHINGLE_WORDS)
            cut_at = np.searchsorted(starts, first).tolist()
            for lo, hi in pairwise(cut_at):
                n = hi - lo
                yield np.unique(every[lo : hi - SHINGLE_WORDS + 1] if n >= SHINGLE_WORDS else _shingles(words[lo:hi], n)) if n else np.zeros(0, dtype=np.uint64)
            raw, held = [], 0


def min_max(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under every permutation, side by side; ``shingles`` must not be empty."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        x = (shingles[None, i : i + 2048] ^ _MASK) * _ODD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((values[: bands * rows].reshape(bands, rows) * _FOLD[:rows]).sum(axis=1, dtype=np.uint64) ^ _BAND_SALT[:bands])


def text_key(text: Column) -> tuple[Column, Column]:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_bytes")


def signatures(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, text_hash, text_bytes, n_shingles, digest of the set, band keys, one-byte signature (the last three null for empty sets)."""
    bound_batches(docs.sparkSession)
    n_bands, band_rows, _ = banding(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            rows = []
            for s in shingle_sets_of(pdf.pop("text")):
                if len(s):
                    v = min_max(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(v, n_bands, band_rows).view(np.int64), (v >> np.uint64(17)).astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            pdf[["n_shingles", "digest", "bands", "sig"]] = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sig"], index=pdf.index)
            yield pdf.astype({"doc_id": "Int64", "text_bytes": "Int32"})

    text = docs["text"]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), *text_key(text))
    return rows.mapInPandas(run, "doc_id long, text_hash long, text_bytes int, n_shingles long, digest binary, bands array<long>, sig binary")


def _agree(a: pd.Series, b: pd.Series, least: int) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return (x == y).sum(axis=1) >= least


def _likely(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[_agree(pdf["sa"], pdf["sb"], least), ["a", "b"]]

    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long").distinct()


def shared_at_least(x: np.ndarray, y: np.ndarray, percent: int = LINK_PERCENT) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y| for sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def shingle_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, shingles) of ``classes`` (rep, digest, doc_id), from any text that has the set.

    Texts are picked in the scan by id if the ids are few; a doc_id that others share brings texts that the digest sorts out.
    If they are many, a bit filter of fixed size leaves out in the scan most texts that nobody asks for, and what it lets
    through is shuffled once; of repeated rows each task hands on one set.
    """
    ids = cut(classes.select("doc_id").distinct())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            raw = [s.tobytes() for s in shingle_sets_of(pdf["text"])]
            yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(r) for r in raw], "shingles": raw})

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    if ids.count() <= BROADCAST_IDS:
        made = texts.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInPandas(sets, "digest binary, shingles binary")
        made = made.join(classes.select("digest", "rep"), "digest").select("rep", "shingles")
        return cut(made.groupBy("rep").agg(F.first("shingles").alias("shingles")))
    texts = likely_among(texts, ids, "doc_id").join(ids, "doc_id", "left_semi")
    made = texts.select("text").mapInPandas(sets, "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return cut(made.join(classes.select("digest", "rep"), "digest").select("rep", "shingles"))


def likely_among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` and a few others: a filter of ``FILTER_BITS`` bits with one hash, broadcast as at
    most ``FILTER_BITS / 64`` words whatever the ids. Of n ids it lets through about n / ``FILTER_BITS`` of all other rows."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, mask = F.shiftrightunsigned(bit, 6), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    words = ids.select(bit.alias("bit")).select(F.shiftrightunsigned("bit", 6).alias("filter_word"), mask.alias("mask")).groupBy("filter_word").agg(F.bit_or("mask").alias("filter_mask"))
    hit = (word == F.col("filter_word")) & F.expr(f"getbit(filter_mask, CAST(pmod(xxhash64({key}), {FILTER_BITS}) % 64 AS INT)) = 1")
    return rows.join(F.broadcast(words), hit, "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets share enough; a hub's set meets its members without being moved for each."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [shared_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf["xa"], pdf["xb"], strict=True)]
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    built = shingle_sets(docs, cut(reps.join(ids, "rep", "left_semi").select("rep", "digest", "doc_id")))
    left = built.select(F.col("rep").alias("a"), F.col("shingles").alias("xa"))
    right = built.select(F.col("rep").alias("b"), F.col("shingles").alias("xb"))
    return pairs.join(right, "b").join(left, "a").mapInPandas(decide, "a long, b long").distinct()


def _likely_across(pdf: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of likely pairs of one block of a band that lie in different components, and how often they agree."""
    i_chunk, j_chunk = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(pdf), -1)
    comp, chunk = pdf["component"].to_numpy(), pdf["chunk"].to_numpy()
    left = np.flatnonzero(chunk == i_chunk)
    right = left if i_chunk == j_chunk else np.flatnonzero(chunk == j_chunk)
    out = []
    if (comp == comp[0]).all():
        left = left[:0]
    for k, i in enumerate(left):
        others = left[k + 1 :] if i_chunk == j_chunk else right
        others = others[comp[others] != comp[i]]
        if len(others):
            agree = (sig[others] == sig[i]).sum(axis=1)
            near = agree >= least
            if near.any():
                out.append((np.full(int(near.sum()), i), others[near], agree[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3


def _first_met(pdf: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the likely pairs those whose first band in common is this one, so that a pair is met once."""
    a, b, agree = _likely_across(pdf, least)
    if not len(a):
        return a, b, agree
    bands = np.stack(list(pdf["bands"]))
    mine = bands[a, (bands[a] == bands[b]).argmax(axis=1)] == int(pdf["band"].iloc[0])
    return a[mine], b[mine], agree[mine]


def _open_cells(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The members of many blocks that have a likely partner in another component."""
        cols = ["band", "rep", "component", "chunk", "i", "j"]
        pdf = pdf.sort_values(["band", "i", "j", "rep"], kind="stable")
        key = pdf[["band", "i", "j"]].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
        parts = [pdf.iloc[:0]]
        for lo, hi in pairwise(edge.tolist()):
            if hi - lo > 1:
                block = pdf.iloc[lo:hi]
                parts.append(block.iloc[np.unique(np.concatenate(_first_met(block, least)[:2]))])
        return pd.concat(parts)[cols]

    return run


def _link_block(percent: int):
    least = banding(percent)[2]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that join components, likeliest pairs first; what is joined already is not compared."""
        a, b, agree = _first_met(pdf, least)
        rep = pdf["rep"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        comp = pdf["component"].tolist()
        parent = {c: c for c in comp}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for k in np.argsort(-agree, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            x, y = root(comp[i]), root(comp[j])
            if x != y and shared_at_least(sets[i], sets[j], percent):
                parent[max(x, y)] = min(x, y)
                links.append((int(rep[i]), int(rep[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def judged(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, text_hash, text_bytes, n_shingles, component_id, kept for every row of ``docs``.

    A class is named by one of its rows, never by its doc_id, which other texts may share.
    """
    least = banding(percent)[2]
    rows = cut(signatures(docs, percent).withColumn("row", F.monotonically_increasing_id()))
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    reps = cut(classes.agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    members = reps.select("rep", "size", F.explode("bands").alias("band"))
    full = cut(members.groupBy("band").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("weight"), F.min("rep").alias("first")).where("n > 1"))
    members = cut(members.join(full, "band"))

    stars = cut(_likely(members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), reps, least))
    links = cut(confirm(stars, docs, reps, percent))
    parts = connected_components(links)

    placed = cut(members.join(parts, members["rep"] == parts["node"], "left").select("band", "n", "weight", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = cut(placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_BYTES)).cast("int")
    rows_open = placed.join(mixed, "band").withColumn("chunks", blocks)
    rows_open = rows_open.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows_open = rows_open.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows_open = rows_open.select("band", "rep", "component", "chunk", F.least("chunk", "other").cast("int").alias("i"), F.greatest("chunk", "other").cast("int").alias("j"))
    rows_open = rows_open.withColumn("cell", F.pmod(F.xxhash64("band", "i", "j"), F.lit(parts_for(members.count(), ROWS_A_CELL))).cast("int"))
    signed = reps.select("rep", "sig", "bands")
    near = rows_open.join(signed, "rep").groupBy("cell").applyInPandas(_open_cells(least), "band long, rep long, component long, chunk int, i int, j int")
    near = cut(near)
    if not near.isEmpty():
        wanted = cut(reps.join(near.select("rep").distinct(), "rep", "left_semi").select("rep", "digest", "doc_id"))
        blocks_open = near.join(signed, "rep").join(shingle_sets(docs, wanted), "rep")
        more = cut(blocks_open.groupBy("band", "i", "j").applyInPandas(_link_block(percent), "a long, b long").distinct())
        if not more.isEmpty():
            parts = connected_components(links.unionByName(more))
    found = cut(reps.join(parts, reps["rep"] == parts["node"], "left").select("digest", "doc_id", F.coalesce("component", "rep").alias("component")))
    names = cut(found.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    found = cut(found.join(names, "component").select("digest", "component_id"))
    out = rows.drop("bands", "sig", "row").join(found, "digest", "left").drop("digest")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return judged(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """``docs`` without the near-duplicates of a smaller doc_id; all columns stay.

    Only what goes is joined back, by id and text: it is broadcast if it is little, else the join shuffles.
    """
    p = free_prefix(docs, "_gone_")
    named = {c: f"{p}{c}" for c in ("doc_id", "text_hash", "text_bytes")}
    gone = cut(judged(docs, percent).where(~F.col("kept")).select(*[F.col(c).alias(n) for c, n in named.items()]).distinct())
    few = gone.count() <= BROADCAST_IDS
    text_hash, text_bytes = text_key(docs["text"])
    same = (docs["doc_id"].cast("long") == F.col(named["doc_id"])) & (text_hash == F.col(named["text_hash"])) & (text_bytes == F.col(named["text_bytes"]))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
