"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, blockjoin, hamming, itq, minhash, mixing, packing, pii, quality, resample, secretscan, sharding, tokenfile
from .common import read
from .tokens import public_vocabulary


#: Key of the registered query, which runs on generated tables; whoever keeps pseudonyms of real values has one of their own.
TEST_KEY = b"evalspark-demo-key"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "picked")


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), TEST_KEY)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.scratch_path(spark, "tokens")
    tokenfile.write_token_files(read(spark, sf_dir, "documents"), path, public_vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_token_files(spark, path)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_digest(read(spark, sf_dir, "documents"))


def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    dim = itq.common_length(vectors)
    good = vectors.where(itq.usable_numbers(F.col("embedding"), dim) & F.col("vec_id").isNotNull())
    return hamming.top_k(hamming.sign_codes(good, dim, hamming.centre(good, dim)), dim, F.col("vec_id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockjoin.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can express: counts and digest of the base spans."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_shard_documents, op3_quality, op4_embedding_neighbours, op5_pack_documents, op6_pseudonyms, op7_token_files, op8_secret_scan, op9_hamming_top_k, op10_near_duplicates, op11_filter_audit, op12_nearest_vectors, op13_importance_resample, secret_base_counts)
}

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_OP1 = rf"""
WITH base AS (
    SELECT doc_id, source, {_SIZE}::BIGINT AS size,
        -ln(((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT))::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) AS e,
        1.0::DOUBLE - length(regexp_replace(text, '[\p{{L}}\x20\x09-\x0D]+', '', 'g'))::DOUBLE / greatest(length(text), 1)::DOUBLE AS share
    FROM documents),
keyed AS (SELECT doc_id, source, size, e / coalesce(0.25::DOUBLE + 0.75::DOUBLE * share * share, 0.25::DOUBLE) AS key FROM base),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM src),
lev AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
    FROM ranked WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, source_size, least(cap, weight * (max(level) OVER ())) AS target FROM lev),
ep AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM tgt),
row_plan AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, (coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS ahead
    FROM keyed k JOIN ep ON k.source IS NOT DISTINCT FROM ep.source),
picks AS (SELECT *, rest > 0 AND ahead + size / 2.0::DOUBLE <= rest AS picked FROM row_plan)
SELECT doc_id, size, source_size, target, (size * (epochs + picked::INT))::BIGINT AS taken, source, epochs, picked FROM picks
"""

_OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN comp ON vec_id = comp.a LEFT JOIN n ON vec_id = n.a
"""

_OP9 = """
WITH good AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT unnest(range(1, len(e) + 1)) AS j, unnest(e) AS x FROM good),
means AS (SELECT j, sum(floor(greatest(-1000, least(1000, x)) * 1000000.0::DOUBLE)::BIGINT)::DOUBLE / count(*)::DOUBLE / 1000000.0::DOUBLE AS bar FROM parts GROUP BY j),
centre AS (SELECT list(bar ORDER BY j) AS bars FROM means),
v AS (SELECT vec_id, list_transform(list_zip(e, bars), lambda z: z[1] > z[2]) AS bits FROM good, centre),
d AS (SELECT q.vec_id AS query_id, v.vec_id, len(list_filter(list_zip(q.bits, v.bits), lambda z: z[1] <> z[2]))::BIGINT AS distance FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""

_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
half AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 85 * (na.n_shingles + nb.n_shingles - shared)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(m, n.doc_id)) AS kept FROM n LEFT JOIN comp ON n.doc_id = comp.a
"""

_OP11 = r"""
WITH labelled AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM t GROUP BY t),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_sort(list_distinct(
    CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END
    || CASE WHEN 100 * len(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 2 * len(t.t) THEN ['C'] ELSE [] END || CASE WHEN regexp_matches(t.t, '[#$%&*|]') THEN ['D'] ELSE [] END
    || CASE WHEN doc_id > least THEN ['E'] ELSE [] END)) AS fails FROM t JOIN first USING (t) LEFT JOIN labelled USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS earlier FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE NOT list_has_any(fails, earlier) AND NOT list_contains(fails, own)) AS kept,
    sum(n) FILTER (WHERE NOT list_has_any(fails, earlier) AND list_contains(fails, own)) AS removed,
    sum(n) FILTER (WHERE list_has_any(fails, earlier) AND list_contains(fails, own)) AS redundant,
    sum(n) FILTER (WHERE fails = [own]) AS unique_fails,
    sum(good) FILTER (WHERE NOT list_has_any(fails, earlier) AND list_contains(fails, own)) AS good_lost,
    sum(toxic) FILTER (WHERE NOT list_has_any(fails, earlier) AND list_contains(fails, own)) AS toxic_lost
    FROM kinds, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r
"""

_OP12 = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP13 = r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS v FROM step WHERE k = 8),
texts AS (SELECT doc_id, false AS target, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
w AS (SELECT doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT doc_id, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w),
g AS (SELECT doc_id, target, s, count(*) AS n FROM f GROUP BY doc_id, target, s),
u AS (SELECT DISTINCT s FROM g),
b AS (SELECT s, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(encode(s))) // 2 + 1), lambda j: ('0x' || substr(hex(encode(s)), 2 * j - 1, 2))::BIGINT)),
    lambda x, y: xor(x >> 8, v[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
h AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE target), 0)::DOUBLE AS t FROM g JOIN b USING (s) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM h) + 10000) / ((s + 1) * ((SELECT sum(t) FROM h) + 10000))))::BIGINT AS gain FROM h),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN b USING (s) JOIN gain USING (bucket) WHERE NOT target GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d USING (doc_id) WHERE NOT target),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(kind: str, order: int, pattern: str, keep: str) -> str:
    """Spans of one kind: lengths between and of the matches add up to every start."""
    return f"""SELECT doc_id, {order} AS ord, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))) AS start,
        unnest(list_transform(m, lambda x: len(x))) AS n, unnest({keep}) AS ok
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {2 if kind == "assign" else 0}) AS v FROM d)"""


_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql("assign", 0, _ASSIGN, "list_transform(v, lambda x: len(x) >= 6)")} UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", "list_transform(v, lambda x: len(x) >= 20)")} UNION ALL {_spans_sql("hex", 2, "[0-9a-f]+", "list_transform(v, lambda x: len(x) >= 24)")}),
k AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS a, count(*) FILTER (WHERE ord = 1) AS c, count(*) FILTER (WHERE ord = 2) AS h,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, ord) AS spans FROM s WHERE ok GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: The others need trees, a tokenizer, a keyed permutation or a differencing heap; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_mix_sources": _OP1, "op4_embedding_neighbours": _OP4, "op9_hamming_top_k": _OP9, "op10_near_duplicates": _OP10, "op11_filter_audit": _OP11, "op12_nearest_vectors": _OP12, "op13_importance_resample": _OP13, "secret_base_counts": _BASE}
