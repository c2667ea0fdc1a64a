"""Registered queries of the corpus operators, each over its whole table, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probita.llm import ann, decontam, gam, kdshard, langid, licenses, negatives, phrases, pieces, pii, secrets, simhash, warc
from probita.llm.common import table
from probita.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: For the registered query only; a real run takes its own from a store of secrets.
PSEUDONYM_KEY = "registered query, not a secret"


def _is(name: str) -> Callable[[Column], Column]:
    return lambda value: value == name


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS phrase
        FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(s) WHERE len(w) > 0),
     grams AS (SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
        FROM d, (SELECT DISTINCT size FROM windows) AS sizes, unnest(range(1, len(w) - size + 2)) AS u(s)),
     found AS (SELECT r, s, g.size, item_id FROM grams AS g JOIN windows USING (size, phrase)),
     hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + size)) AS u(p) GROUP BY r),
     named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


def _located(kind: str, rank: int, pattern: str, group: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, i, match, part, CAST(sum(gap + length(match)) OVER (PARTITION BY r ORDER BY i) - length(match) AS BIGINT) AS first
 FROM (SELECT r, i, m[i] AS match, v[i] AS part, length(p[i]) AS gap FROM (SELECT r, string_split_regex(x, {quoted}) AS p, regexp_extract_all(x, {quoted}, 0) AS m, regexp_extract_all(x, {quoted}, {group}) AS v FROM t),
  unnest(range(1, len(m) + 1)) AS u(i))"""


_ALLOWED = " OR ".join(f"regexp_full_match(match, '{a}')" for a in secrets.ALLOWED if "\\1" not in a) + " OR replace(match, left(match, 1), '') = ''"
_HOT = " UNION ALL ".join(f"""SELECT r, '{c.kind}' AS kind, {3 + n} AS rank, {c.window} AS w, i, k, first FROM ({_located(c.kind, 3 + n, c.pattern.replace(chr(92) + '=', '=').replace(chr(92) + '_', '_'), 0)}),
 unnest(range(0, length(match) - {c.window} + 1)) AS u2(k) WHERE regexp_matches(match, '{c.needs}') AND NOT ({_ALLOWED})
 AND list_sum(list_transform(list_distinct(string_split(substr(match, k + 1, {c.window}), '')), lambda c: -(({c.window} - length(replace(substr(match, k + 1, {c.window}), c, ''))) / {c.window}.0)
  * log2(({c.window} - length(replace(substr(match, k + 1, {c.window}), c, ''))) / {c.window}.0))) >= {c.threshold - 1e-9!r}""" for n, c in enumerate(secrets.CLASSES))
SQL["op8_secret_scan"] = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
     base AS (SELECT r, kind, rank, first, first + length(match) AS past FROM ({_located('assign', 0, secrets.ASSIGN, 2)}) WHERE length(part) >= 8
        UNION ALL SELECT r, kind, rank, first, first + length(match) FROM ({_located('access', 1, 'AKIA[A-Z0-9]+', 0)}) WHERE length(match) >= 16
        UNION ALL SELECT r, kind, rank, first, first + length(match) FROM ({_located('hex', 2, '[0-9a-f]+', 0)}) WHERE length(match) >= 32),
     hot AS ({_HOT}),
     islands AS (SELECT *, sum(fresh) OVER (PARTITION BY r, kind, i ORDER BY k) AS island FROM (
        SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY r, kind, i ORDER BY k) <= w THEN 0 ELSE 1 END AS fresh FROM hot)),
     added AS (SELECT r, kind, rank, min(first + k) AS first, max(first + k + w) AS past FROM islands GROUP BY r, kind, rank, i, island),
     listed AS (SELECT r, string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, rank, past) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY r),
     counted AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, rank) AS listed FROM base GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN counted USING (r) LEFT JOIN listed USING (r)"""


@query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


@query
def op5_web_archives(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    manifest = warc.write_archives(table(spark, folder, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("bigint")
    return warc.read_archives(spark, path, manifest, payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "problem")


SQL["op5_web_archives"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
     digests AS (SELECT h, max(page_id) AS last, list_transform(range(20), lambda i: (strpos('0123456789abcdef', h[2 * i + 1]) - 1) * 16 + strpos('0123456789abcdef', h[2 * i + 2]) - 1) AS bytes FROM p GROUP BY h),
     coded AS (SELECT h, last, list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + (((bytes[1 + (5 * i) // 8] * 256 + coalesce(bytes[2 + (5 * i) // 8], 0)) >> (11 - (5 * i) % 8)) & 31)]) AS letters FROM digests)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p JOIN coded USING (h)
"""


@query
def op9_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query
def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = kdshard.assign(table(spark, folder, "documents"), shards=16)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op10_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kinds = F.col("pii_kinds")
    return pii.pseudonymized(docs, PSEUDONYM_KEY).select(
        "doc_id", "text", *[F.size(F.filter(kinds, _is(name))).cast("bigint").alias(f"n_{name}") for name in pii.FORMS])


@query
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), pieces.Model.load(), keep=["doc_id"])


@query
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i : i + {m - 1}], ' ') AS phrase FROM p, unnest(range(1, len(w) - {m - 2})) AS u(i)" for m in range(1, 5))
_SUBS = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i : i + {k - 1}], ' ') AS phrase, a AS longer FROM c, unnest(range(1, m - {k - 2})) AS u(i) WHERE m > {k}" for k in (2, 3))
SQL["op11_collocations"] = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
     f AS (SELECT lang, m, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 30),
     totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
     c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
     cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y FROM c, unnest(range(1, m)) AS u(k)),
     scored AS (SELECT cuts.lang, cuts.m, cuts.phrase, cuts.a, fx.a AS l, fy.a AS r, CAST((2000000 * CAST(cuts.a AS HUGEINT)) // (CAST(fx.a AS HUGEINT) + fy.a) AS BIGINT) AS score
        FROM cuts JOIN f AS fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f AS fy ON fy.lang = cuts.lang AND fy.phrase = y
        QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000 * CAST(cuts.a AS HUGEINT)) // (CAST(fx.a AS HUGEINT) + fy.a), k) = 1),
     held AS (SELECT lang, phrase, max(longer) AS longer FROM ({_SUBS}) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN totals USING (lang) LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
QUALIFY rank <= 2000
"""


@query
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    return gam.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(table(spark, folder, "embeddings")), F.col("id") % 100 == 0)


SQL["op13_hard_negatives"] = """
WITH taken AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
        FROM taken AS a JOIN taken AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
     positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
