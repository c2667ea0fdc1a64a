"""Queries of the screening operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions import scalars as S
from probita.functions import similarity as sim
from probita.operators import matching, risk, tally
from probita.plans.catalog import query
from probita.plans.portfolio import payloads
from probita.plans.views_sql import VIEWS, he, with_views
from probita.sources import tables

# --- SQL twins --------------------------------------------------------------------------------

KEY_SQL = "left(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 4)"

VIEWS["asked"] = (["screen_queries"], f"""
SELECT *, list_sort(list_distinct(list_filter([{KEY_SQL.format('name')}] || list_transform(string_split_regex(name, '\\s+'), lambda w: {KEY_SQL.format('w')}), lambda k: k <> ''))) AS keys
FROM screen_queries""")
VIEWS["filed"] = (["watchlist"], f"""
SELECT *, list_sort(list_distinct(list_filter([{KEY_SQL.format('name')}] || list_transform(aliases, lambda w: {KEY_SQL.format('w')}), lambda k: k <> ''))) AS keys FROM watchlist""")
VIEWS["candidates"] = (["asked", "filed"], """
SELECT DISTINCT q.entity_id, w.row_id FROM (SELECT entity_id, unnest(keys) AS k FROM asked) q JOIN (SELECT row_id, unnest(keys) AS k FROM filed) w ON w.k = q.k""")

# Longest common subsequence of all text pairs at once: one recursion step per letter of the left text,
# the state is the row of the usual table. cur[j] is the running maximum of prev[j] and prev[j-1] + match.
VIEWS["text_pairs"] = (["candidates", "asked", "filed"], """
SELECT DISTINCT lower(q.name) AS a, lower(w.name) AS b FROM candidates c JOIN asked q USING (entity_id) JOIN filed w USING (row_id)
UNION SELECT DISTINCT lower(q.name), lower(unnest(w.aliases)) FROM candidates c JOIN asked q USING (entity_id) JOIN filed w USING (row_id)
UNION SELECT DISTINCT lower(q.company), lower(w.company) FROM candidates c JOIN asked q USING (entity_id) JOIN filed w USING (row_id) WHERE q.company <> '' AND w.company <> ''
UNION SELECT DISTINCT lower(q.context), lower(w.context) FROM candidates c JOIN asked q USING (entity_id) JOIN filed w USING (row_id) WHERE q.context <> '' AND w.context <> ''""")
VIEWS["pair_forms"] = (["text_pairs"], """
SELECT a, b, a AS x, b AS y FROM text_pairs
UNION SELECT a, b, array_to_string(list_sort(string_split_regex(trim(a), '\\s+')), ' '), array_to_string(list_sort(string_split_regex(trim(b), '\\s+')), ' ') FROM text_pairs""")
VIEWS["lcs_steps"] = (["pair_forms"], """
SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda j: 0) AS row FROM (SELECT DISTINCT x, y FROM pair_forms)
UNION ALL SELECT x, y, i + 1, list_transform(range(1, length(y) + 2), lambda m: list_max(
  list_transform(range(1, m + 1), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(row[j], row[j - 1] + (substr(x, i + 1, 1) = substr(y, j - 1, 1))::INT) END)))
FROM lcs_steps WHERE i < length(x)""")
VIEWS["sims"] = (["pair_forms", "lcs_steps"], """
SELECT p.a, p.b, max(2.0::DOUBLE * s.row[length(p.y) + 1] / (length(p.x) + length(p.y))) AS sim FROM pair_forms p JOIN lcs_steps s ON s.x = p.x AND s.y = p.y AND s.i = length(p.x) GROUP BY p.a, p.b""")
VIEWS["alias_sims"] = (["candidates", "asked", "filed", "sims"], """
SELECT c.entity_id, c.row_id, max(s.sim) AS sim FROM candidates c JOIN asked q USING (entity_id)
JOIN (SELECT row_id, unnest(aliases) AS alias FROM filed) w USING (row_id) JOIN sims s ON s.a = lower(q.name) AND s.b = lower(w.alias) GROUP BY ALL""")
VIEWS["parts"] = (["candidates", "asked", "filed", "sims", "alias_sims"], """
SELECT c.entity_id, c.row_id, w.name AS candidate_name, w.source_list AS source, n.sim AS s_name, coalesce(al.sim, 0.0) AS s_alias,
  CASE WHEN q.dob IS NULL OR w.dob IS NULL THEN 0.5 ELSE (q.dob = w.dob)::INT END::DOUBLE AS s_dob,
  (upper(q.nationality) = upper(w.nationality))::INT::DOUBLE AS s_nationality,
  CASE WHEN q.company = '' OR w.company IS NULL THEN 0.5 ELSE co.sim END::DOUBLE AS s_company,
  CASE WHEN q.context IS NULL OR w.context IS NULL THEN 0.3 ELSE cx.sim END::DOUBLE AS context_sim
FROM candidates c JOIN asked q USING (entity_id) JOIN filed w USING (row_id)
JOIN sims n ON n.a = lower(q.name) AND n.b = lower(w.name)
LEFT JOIN alias_sims al ON al.entity_id = c.entity_id AND al.row_id = c.row_id
LEFT JOIN sims co ON co.a = lower(q.company) AND co.b = lower(w.company)
LEFT JOIN sims cx ON cx.a = lower(q.context) AND cx.b = lower(w.context)""")
_w = "0.30::DOUBLE * s_name + 0.15::DOUBLE * s_alias + 0.15::DOUBLE * s_dob + 0.10::DOUBLE * s_nationality + 0.15::DOUBLE * s_company + 0.15::DOUBLE * "
VIEWS["gated"] = (["parts"], f"""
SELECT *, CASE WHEN {he(_w + "0.3::DOUBLE", 4)} - 0.045::DOUBLE + 0.15::DOUBLE >= 0.55 THEN context_sim ELSE 0.3::DOUBLE END AS s_context FROM parts""")
VIEWS["evaluated"] = (["gated"], f"""
SELECT *, {he(_w + "s_context", 4)} AS match_score,
  CASE WHEN {he(_w + "s_context", 4)} >= 0.85 THEN 'CONFIRMED_MATCH' WHEN {he(_w + "s_context", 4)} >= 0.55 THEN 'POSSIBLE_MATCH' ELSE 'LIKELY_FALSE_POSITIVE' END AS classification
FROM gated""")
VIEWS["matches"] = (["evaluated"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY match_score DESC, row_id) AS rank FROM evaluated WHERE match_score >= 0.55) WHERE rank <= 25""")


def _queries(spark, d):
    return tables.screen_queries(spark, d)


def _pairs(spark, d):
    """Every pair of a profile and a class of ``w_n`` entries, the scores of its texts known."""
    return matching.every_pair(_queries(spark, d), tables.watchlist(spark, d))


def _alike_pairs(spark, d, *fields):
    """Pairs of profiles and groups of entries that are told apart by keys and ``fields`` only; ``w_n`` entries, the first and the last by id, are one group."""
    distinct, keyed = matching.profiles(_queries(spark, d).select("entity_id", "name", *fields))
    alike = tables.watchlist(spark, d).groupBy("name", "aliases", *fields).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
    others = [c for c in matching.QUERY_FIELDS if c not in alike.columns]
    return matching.blocking_pairs(distinct, alike.withColumns({c: F.lit(None).cast("string") for c in others})), keyed


def _matches(spark, d, limit=V.MATCH_LIMIT):
    return matching.screen(_queries(spark, d), tables.watchlist(spark, d), limit)


@query("e3_batch_screen", with_views("""
SELECT m.entity_id, row_id AS matched_against, candidate_name, source, match_score, classification, m.rank, n AS candidates_scored,
  round(s_name, 6) AS s_name, round(s_alias, 6) AS s_alias, s_dob, s_nationality, round(s_company, 6) AS s_company, round(s_context, 6) AS s_context
FROM matches m JOIN (SELECT entity_id, count(*) AS n FROM candidates GROUP BY entity_id) k ON k.entity_id = m.entity_id""", "matches", "candidates"))
def batch_screen(spark, d):
    rounded = {f"s_{p}": F.round(f"s_{p}", 6) for p in matching.PARTS}
    return _matches(spark, d).withColumns(rounded).drop("row_id", "evidence_id")


@query("e1_component_scores", with_views("""
SELECT entity_id, count(*) AS pairs, round(sum(s_name), 4) AS s_name, round(sum(s_alias), 4) AS s_alias, round(sum(s_dob), 4) AS s_dob, round(sum(s_nationality), 4) AS s_nationality,
  round(sum(s_company), 4) AS s_company, round(sum(s_context), 4) AS s_context FROM gated GROUP BY entity_id""", "gated"))
def component_scores(spark, d):
    """Scores of every pair, summed up per customer."""
    sums, keyed = tally.tallies(_queries(spark, d), tables.watchlist(spark, d))
    sums = sums.select("profile_id", (F.col("n0") + F.col("n1") + F.col("n2")).alias("pairs"), *[F.round(f"s_{p}", 4).alias(f"s_{p}") for p in matching.PARTS])
    return keyed.join(sums, "profile_id").drop("profile_id", "evidence_id")


@query("e2_pair_classes", with_views("""
SELECT entity_id, classification, count(*) AS pairs, round(max(match_score), 4) AS best FROM evaluated GROUP BY ALL""", "evaluated"))
def pair_classes(spark, d):
    found, keyed = tally.tallies(_queries(spark, d), tables.watchlist(spark, d))
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("classification"), F.col(f"n{k}").alias("pairs"), F.col(f"best{k}").alias("best")) for k, c in enumerate(tally.CLASSES)]))
    classes = found.select("profile_id", each).where(F.col("pairs") > 0)
    return keyed.join(classes, "profile_id").drop("profile_id", "evidence_id")


@query("j2_blocking_join", with_views("SELECT entity_id, count(*) AS candidates, min(row_id) AS first_row, max(row_id) AS last_row FROM candidates GROUP BY entity_id", "candidates"))
def blocking_join(spark, d):
    pairs, keyed = _alike_pairs(spark, d)
    counts = pairs.groupBy(F.col("q_profile_id").alias("profile_id")).agg(
        F.sum("w_n").alias("candidates"), F.min("w_first_row").alias("first_row"), F.max("w_last_row").alias("last_row"))
    return keyed.join(counts, "profile_id").drop("profile_id", "evidence_id")


@query("w2_candidate_counts", with_views("""
SELECT a.entity_id, count(c.row_id) AS candidates_scored FROM asked a LEFT JOIN candidates c ON c.entity_id = a.entity_id GROUP BY a.entity_id""", "asked", "candidates"))
def candidate_counts(spark, d):
    distinct, keyed = matching.profiles(_queries(spark, d))
    return keyed.join(matching.candidate_counts(distinct, tables.watchlist(spark, d)), "profile_id").drop("profile_id", "evidence_id")


@query("w1_top_matches", with_views("SELECT entity_id, row_id AS matched_against, match_score, rank FROM matches WHERE rank <= 3", "matches"))
def top_matches(spark, d):
    return _matches(spark, d, 3).select("entity_id", "matched_against", "match_score", "rank")


@query("p14_blocking_keys", with_views(f"SELECT row_id, {KEY_SQL.format('name')} AS key FROM watchlist", "watchlist"))
def blocking_keys(spark, d):
    return tables.watchlist(spark, d).select("row_id", S.blocking_key("name").alias("key"))


@query("p15_key_lists", with_views("""
SELECT 'query' AS side, entity_id AS id, array_to_string(keys, '|') AS keys FROM asked UNION ALL SELECT 'entry', row_id, array_to_string(keys, '|') FROM filed""", "asked", "filed"))
def key_lists(spark, d):
    asked = _queries(spark, d).select(F.lit("query").alias("side"), F.col("entity_id").alias("id"), F.array_join(S.query_keys("name"), "|").alias("keys"))
    filed = tables.watchlist(spark, d).select(F.lit("entry").alias("side"), F.col("row_id").alias("id"), F.array_join(S.index_keys("name", "aliases"), "|").alias("keys"))
    return asked.unionByName(filed)


@query("p16_client_queries", with_views("""
SELECT client_id::VARCHAR AS entity_id, client_name AS name, country AS nationality, CASE WHEN client_type <> 'Individual' THEN client_name END AS company,
  client_type || ' ' || sector || ' ' || country AS context FROM clients""", "clients"))
def client_queries(spark, d):
    return matching.client_queries(tables.clients(spark, d))


@query("p22_same_or_unknown", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.5 WHEN c_custkey % 3 = 0 THEN 1.0 ELSE (c_mktsegment = 'MACHINERY')::INT END::DOUBLE AS score FROM customer""")
def same_or_unknown(spark, d):
    key = F.col("c_custkey")
    right = F.when(key % 4 == 0, F.lit("")).when(key % 3 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(F.lit("machinery"))
    return tables.table(spark, d, "customer").select(key, S.same_or_unknown(F.col("c_mktsegment"), right).alias("score"))


@query("p23_country_match", "SELECT c_custkey, [1.0, 1.0, 0.0, 0.5, 1.0, 0.0][c_custkey % 6 + 1]::DOUBLE AS score FROM customer")
def country_match(spark, d):
    at = (F.col("c_custkey") % 6 + 1).cast("int")
    left = F.element_at(F.array(*[F.lit(t) for t in ["UAE", "uk", "iran", "", "Atlantis", "US"]]), at)
    right = F.element_at(F.array(*[F.lit(t) for t in ["ae", "England", "IQ", "US", " atlantis", "russia"]]), at)
    return tables.table(spark, d, "customer").withColumns({"l": left, "r": right}).select("c_custkey", S.country_match("l", "r").alias("score"))


@query("p25_name_similarity", with_views("""
SELECT c.entity_id, count(*) AS pairs, round(sum(s.sim), 4) AS total, round(max(s.sim), 6) AS best
FROM candidates c JOIN asked q USING (entity_id) JOIN filed w USING (row_id) JOIN sims s ON s.a = lower(q.name) AND s.b = lower(w.name) GROUP BY c.entity_id""",
                                         "candidates", "asked", "filed", "sims"))
def name_similarity(spark, d):
    pairs, keyed = _alike_pairs(spark, d)
    sums = pairs.select(F.col("q_profile_id").alias("profile_id"), "w_n", sim.prepared_similarity("q_name", "w_name").alias("s")).groupBy("profile_id").agg(
        F.sum("w_n").alias("pairs"), F.round(F.sum(F.col("s") * F.col("w_n")), 4).alias("total"), F.round(F.max("s"), 6).alias("best"))
    return keyed.join(sums, "profile_id").drop("profile_id", "evidence_id")


@query("p26_alias_similarity", with_views("""
SELECT entity_id, row_id, round(sim, 6) AS score FROM alias_sims WHERE sim >= 0.5""", "alias_sims"))
def alias_similarity(spark, d):
    """Pairs whose aliases are alike, from the names and alias lists that are: each pair of these is scored once."""
    score = F.round("s_alias", 6)
    return matching.name_scores(_queries(spark, d), tables.watchlist(spark, d), score >= 0.5).select("entity_id", "row_id", score.alias("score"))


@query("p27_company_similarity", with_views("""
SELECT entity_id, round(sum(s_company), 4) AS total FROM parts GROUP BY entity_id""", "parts"))
def company_similarity(spark, d):
    pairs, keyed = _alike_pairs(spark, d, "company")
    sums = pairs.select(F.col("q_profile_id").alias("profile_id"), "w_n", F.when(F.col("q_company_low").isNull() | F.col("w_company_low").isNull(), F.lit(V.UNKNOWN_ATTRIBUTE)).otherwise(sim.prepared_similarity("q_company", "w_company")).alias("s")).groupBy("profile_id").agg(
        F.round(F.sum(F.col("s") * F.col("w_n")), 4).alias("total"))
    return keyed.join(sums, "profile_id").select("entity_id", "total")


@query("p28_context_vectors", """
SELECT a.vec_id, b.vec_id AS other_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def context_vectors(spark, d):
    left = tables.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("l"), (F.col("vec_id") + 1).alias("other_id"))
    right = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("r"))
    return left.join(right, "other_id").select("vec_id", "other_id", F.round(sim.vector_similarity("l", "r"), 5).alias("score"))


@query("p29_weighted_score", with_views("""
SELECT entity_id, round(max(match_score), 4) AS best, round(sum(match_score), 4) AS total FROM evaluated GROUP BY entity_id""", "evaluated"))
def weighted_score(spark, d):
    pairs, keyed = _pairs(spark, d)
    sums = matching.evaluate(pairs).groupBy(F.col("q_profile_id").alias("profile_id")).agg(
        F.max("match_score").alias("best"), F.round(F.sum(F.col("match_score") * F.col("w_n")), 4).alias("total"))
    return keyed.join(sums, "profile_id").select("entity_id", "best", "total")


@query("p30_match_classes", with_views("SELECT classification, count(*) AS pairs FROM evaluated GROUP BY classification", "evaluated"))
def match_classes(spark, d):
    pairs, keyed = _pairs(spark, d)
    shares = keyed.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    classes = matching.evaluate(pairs).groupBy(F.col("q_profile_id").alias("profile_id"), "classification").agg(F.sum("w_n").alias("k"))
    return classes.join(shares, "profile_id").groupBy("classification").agg(F.sum(F.col("k") * F.col("n")).alias("pairs"))


_decision_sql = """CASE WHEN match_score >= 0.85 AND greatest(s_dob, s_nationality, s_company, s_context) >= 0.55 THEN 'confirmed_match' WHEN match_score >= 0.85 THEN 'needs_review'
  WHEN match_score >= 0.55 THEN 'likely_match' ELSE 'likely_false_positive' END"""
_attributes_sql = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN s_{p} >= 0.55 THEN '{p}' END" for p in matching.PARTS) + "], lambda x: x IS NOT NULL), ',')"
_type_sql = "CASE WHEN lower(source) LIKE '%ofac%' OR lower(source) LIKE '%sanction%' THEN 'sanctions' ELSE 'watchlist' END"


@query("p31_decisions", with_views(f"SELECT entity_id, row_id, {_decision_sql} AS decision FROM matches", "matches"))
def decisions(spark, d):
    parts = {p: F.col(f"s_{p}") for p in matching.PARTS}
    return _matches(spark, d).select("entity_id", "row_id", matching.decision(F.col("match_score"), parts).alias("decision"))


@query("p32_matched_attributes", with_views(f"SELECT entity_id, row_id, {_attributes_sql} AS attributes FROM matches", "matches"))
def matched_attributes(spark, d):
    parts = {p: F.col(f"s_{p}") for p in matching.PARTS}
    return _matches(spark, d).select("entity_id", "row_id", F.array_join(matching.matched_attributes(parts), ",").alias("attributes"))


@query("p33_sources", with_views("""
SELECT row_id, CASE WHEN source_list IN ('OFAC SDN', 'opensanctions') THEN 'sanctions' ELSE 'watchlist' END AS source_type,
  CASE source_list WHEN 'OFAC SDN' THEN 'ofac sdn' WHEN 'opensanctions' THEN 'opensanctions' ELSE 'pep register' END AS risk_source,
  lower(source_list) || ' (sample fixture)' AS fixture_source FROM watchlist""", "watchlist"))
def sources(spark, d):
    source = F.col("source_list")
    return tables.watchlist(spark, d).select(
        "row_id", matching.source_type(source).alias("source_type"), matching.source_for_risk(source).alias("risk_source"),
        matching.source_for_risk(F.concat(source, F.lit(V.FIXTURE_SUFFIX))).alias("fixture_source"))


@query("p34_intelligence_results", with_views(f"""
SELECT entity_id AS client_id, candidate_name AS matched_entity_name, {_type_sql} AS source_type, source AS source_name,
  {he("match_score * 100", 2)} AS match_confidence, {_decision_sql} AS decision, {_attributes_sql} AS matched_attributes FROM matches""", "matches"))
def intelligence_results(spark, d):
    return matching.intelligence_results(matching.with_evidence_ids(_matches(spark, d))).withColumn(
        "matched_attributes", F.array_join("matched_attributes", ",")).drop("result_id", "evidence_references")


@query("p36_sanctions_signal", with_views("""
SELECT entity_id, true AS has_match, match_score AS match_confidence, candidate_name AS matched_entity,
  CASE source WHEN 'OFAC SDN' THEN 'ofac sdn' WHEN 'opensanctions' THEN 'opensanctions' ELSE 'pep register' END AS source FROM matches WHERE rank = 1""", "matches"))
def sanctions_signal(spark, d):
    best = matching.with_evidence_ids(_matches(spark, d, 1))
    return matching.sanctions_signal(best).select("entity_id", "screened.has_match", "screened.match_confidence", "screened.matched_entity", "screened.source")


def _enriched(spark, d, preserve):
    best = matching.with_evidence_ids(_matches(spark, d, 1)).withColumn("entity_id", F.regexp_replace("entity_id", "^CLIENT-", ""))
    return matching.enrich_payloads(payloads(spark, d), best, preserve)


@query("j6_enriched_sanctions", with_views("""
SELECT p.client_id, CASE WHEN m.entity_id IS NOT NULL THEN true ELSE has_match END AS has_match, CASE WHEN m.entity_id IS NOT NULL THEN NULL ELSE p.sanctions_flag = 1 END AS confirmed,
  coalesce(m.match_score, p.match_confidence) AS match_confidence, CASE WHEN m.entity_id IS NOT NULL THEN 'SAN-' || p.client_id END AS kyc_evidence_id,
  CASE WHEN m.entity_id IS NULL THEN 'Local KYC sanctions flags' WHEN m.source = 'OFAC SDN' THEN 'ofac sdn' WHEN m.source = 'opensanctions' THEN 'opensanctions' ELSE 'pep register' END AS source
FROM payload p LEFT JOIN (SELECT * FROM matches WHERE rank = 1) m ON m.entity_id = 'CLIENT-' || p.client_id""", "payload", "matches"))
def enriched_sanctions(spark, d):
    return _enriched(spark, d, False).select("client_id", "sanctions.has_match", "sanctions.confirmed", "sanctions.match_confidence",
                                             "sanctions.kyc_evidence_id", "sanctions.source")


def _rescored(kind: str, flag: str) -> str:
    """Views that score payloads with a screened sanctions section: those of the plain payload, under names that end in ``kind``."""
    VIEWS[f"payload_{kind}"] = (["payload", "matches"], f"""
SELECT p.* REPLACE (m.entity_id IS NOT NULL OR has_match AS has_match, {flag} AS sanctions_flag, coalesce(m.match_score, match_confidence) AS match_confidence), m.source AS list
FROM payload p LEFT JOIN (SELECT * FROM matches WHERE rank = 1) m ON m.entity_id = 'CLIENT-' || p.client_id""")
    chain = ["payload", "factors", "scored_factors", "components", "based", "floored"]
    for name in chain[1:]:
        needs, sql = VIEWS[name]
        if name == "factors":
            sql += """UNION ALL SELECT client_id, 8, 'sanctions_risk', 'trusted_sanctions_source', 4.0, least(match_confidence, 0.95::DOUBLE), 'Sanctions source is authoritative'
FROM payload WHERE list IN ('OFAC SDN', 'opensanctions')"""
        VIEWS[f"{name}_{kind}"] = ([f"{n}_{kind}" for n in needs], re.sub(rf"\b(FROM|JOIN) ({'|'.join(chain)})\b", rf"\1 \2_{kind}", sql))
    return f"floored_{kind}"


_plain = _rescored("plain", "CASE WHEN m.entity_id IS NULL THEN sanctions_flag ELSE 0 END")
_kept = _rescored("kept", "sanctions_flag")


@query("j6_enriched_scores", with_views(f"""
SELECT p.client_id::VARCHAR AS customer_id, p.risk_score AS score, p.escalation_floor AS floor, k.risk_score AS score_kept, k.escalation_floor AS floor_kept
FROM {_plain} p JOIN {_kept} k ON k.client_id = p.client_id""", _plain, _kept))
def enriched_scores(spark, d):
    """Scores after enrichment, with and without keeping the confirmed flag."""
    plain = risk.assess(_enriched(spark, d, False)).select("customer_id", F.col("risk_score").alias("score"), F.col("escalation_floor").alias("floor"))
    kept = risk.assess(_enriched(spark, d, True)).select("customer_id", F.col("risk_score").alias("score_kept"), F.col("escalation_floor").alias("floor_kept"))
    return plain.join(kept, "customer_id")


# --- light search -----------------------------------------------------------------------------

VIEWS["light"] = (["watchlist"], """
SELECT row_id, name, array_to_string(aliases, '; ') AS aliases, lower(name) AS n, lower(array_to_string(aliases, '; ')) AS a,
  list_distinct(regexp_extract_all(lower(name) || ' ' || lower(array_to_string(aliases, '; ')), '[a-z0-9]+')) AS tokens FROM watchlist""")
VIEWS["light_asked"] = ([], """
SELECT c_custkey AS query_id, lower(trim(q)) AS q, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) AS tokens FROM (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN substr(p_name, 2, 6) ELSE p_name || ' trading co' END AS q
  FROM customer JOIN part ON p_partkey = c_custkey * 7 % (SELECT count(*) FROM part))""")


@query("j7_light_search", with_views("""
SELECT query_id, row_id, name, score, rn AS rank FROM (
  SELECT q.query_id, l.row_id, l.name, s.score, row_number() OVER (PARTITION BY q.query_id ORDER BY s.score DESC, l.name, l.row_id) AS rn FROM light_asked q JOIN (
    SELECT q.q, l.row_id, CASE WHEN q.q = l.n THEN 100 WHEN contains(l.n, q.q) OR contains(l.a, q.q) THEN 80
      ELSE floor(len(list_intersect(q.tokens, l.tokens)) / len(q.tokens)::DOUBLE * 60)::INT END AS score
    FROM (SELECT DISTINCT q, tokens FROM light_asked) q CROSS JOIN light l) s ON s.q = q.q JOIN light l ON l.row_id = s.row_id WHERE s.score >= 40)
WHERE rn <= 10""", "light", "light_asked"))
def light_search(spark, d):
    parts = tables.table(spark, d, "part")
    total = parts.agg(F.count(F.lit(1))).scalar()
    key, name = F.col("c_custkey"), F.col("p_name")
    text = (F.when(key % 4 == 0, name)
            .when(key % 4 == 1, F.concat(F.split_part(name, F.lit(" "), F.lit(2)), F.lit(" "), F.split_part(name, F.lit(" "), F.lit(1))))
            .when(key % 4 == 2, F.substring(name, 2, 6)).otherwise(F.concat(name, F.lit(" trading co"))))
    asked = tables.table(spark, d, "customer").select("c_custkey", (key * 7 % total).alias("p_partkey")).join(parts, "p_partkey").select(
        key.alias("query_id"), text.alias("name"))
    entries = tables.watchlist(spark, d).select("row_id", "name", F.array_join("aliases", "; ").alias("aliases"))
    return matching.light_search(asked, entries)


@query("t11_tokens", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens FROM documents")
def tokens(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(S.alphanumeric_tokens("text")), " ").alias("tokens"))
