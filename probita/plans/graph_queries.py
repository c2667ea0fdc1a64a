"""Queries over ownership graphs and cited evidence."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from probita.functions import text as tx
from probita.operators import cases, graph, grounding
from probita.operators import transactions as tr
from probita.plans import match_queries  # noqa: F401  (its views are used)
from probita.plans.catalog import query
from probita.plans.risk_queries import disposition_sql
from probita.plans.views_sql import VIEWS, with_views
from probita.session import cut_lineage
from probita.sources import tables

VIEWS["walk"] = (["ownership_edges"], """
SELECT 'N-0000000000' AS node_id, 0 AS depth, ['N-0000000000'] AS path
UNION ALL SELECT e.owned_id, w.depth + 1, list_append(w.path, e.owned_id) FROM walk w JOIN ownership_edges e ON e.owner_id = w.node_id
WHERE w.depth < 5 AND NOT list_contains(w.path, e.owned_id)""")
VIEWS["reached"] = (["ownership_edges"], """
SELECT 'N-0000000000' AS node_id UNION SELECT e.owned_id FROM reached r JOIN ownership_edges e ON e.owner_id = r.node_id""")
VIEWS["below"] = (["walk"], """
SELECT node_id, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY depth, path) AS rn FROM walk WHERE depth > 0) WHERE rn = 1""")


# The screening views once more, with the nodes below the root as what is asked.
_SCREENING = ["asked", "candidates", "text_pairs", "pair_forms", "lcs_steps", "sims", "alias_sims", "parts", "gated", "evaluated", "matches"]


def _of_nodes(text: str) -> str:
    return re.sub(rf"\b({'|'.join([*_SCREENING, 'screen_queries'])})\b(?! *\()", r"node_\1", text)


VIEWS["node_screen_queries"] = (["below"], """
SELECT 'N-' || lpad(p_partkey::VARCHAR, 10, '0') AS entity_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN (1950 + p_size)::VARCHAR END AS dob, p_type AS nationality, p_brand AS company,
  'maker of ' || p_name AS context FROM part WHERE 'N-' || lpad(p_partkey::VARCHAR, 10, '0') IN (SELECT node_id FROM below)""")
for _name in _SCREENING:
    _needs, _sql = VIEWS[_name]
    VIEWS[f"node_{_name}"] = ([_of_nodes(n) for n in _needs], _of_nodes(_sql))


def _graph(spark, d):
    return tables.ownership_nodes(spark, d), tables.ownership_edges(spark, d)


@query("g1_graph", with_views("""
SELECT 'parts' AS structure, (SELECT count(*) FROM part) AS nodes, count(*) AS edges, count(DISTINCT owner_id) AS owners FROM ownership_edges""", "ownership_edges"))
def ownership_graph(spark, d):
    nodes, edges = _graph(spark, d)
    sizes = edges.groupBy("structure").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("owner_id").alias("owners"))
    return nodes.groupBy("structure").agg(F.count(F.lit(1)).alias("nodes")).join(sizes, "structure")


@query("g2_roots", with_views("""
SELECT 'parts' AS structure, min('N-' || lpad(p_partkey::VARCHAR, 10, '0')) AS root_id FROM part WHERE 'N-' || lpad(p_partkey::VARCHAR, 10, '0') NOT IN (SELECT owned_id FROM ownership_edges)""", "ownership_edges"))
def roots(spark, d):
    return graph.roots(*_graph(spark, d))


@query("g3_descendants", with_views("SELECT 'parts' AS structure, node_id, depth, array_to_string(path, '>') AS path FROM below", "below"))
def descendants(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.descendants(graph.roots(nodes, edges), edges).select("structure", "node_id", "depth", F.array_join("path", ">").alias("path"))


@query("g3_nodes_traversed", with_views("""
SELECT 'parts' AS structure, 'N-0000000000' AS root_id, count(*) - 1 AS nodes_traversed FROM reached""", "reached"))
def nodes_traversed(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.count_descendants(graph.roots(nodes, edges), edges)


@query("p17_node_queries", """
SELECT 'N-' || lpad(p_partkey::VARCHAR, 10, '0') AS node_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN (1950 + p_size)::VARCHAR END AS dob, p_type AS nationality, p_brand AS company FROM part""")
def node_queries(spark, d):
    return graph.node_queries(tables.ownership_nodes(spark, d)).select("node_id", "name", "dob", "nationality", "company")


def _chain(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.sanctioned_in_chain(nodes, edges, tables.watchlist(spark, d))


@query("g4_sanctioned_chain", with_views("""
SELECT b.node_id, depth, row_id AS matched_against, match_score, array_to_string(path, '>') AS path FROM below b JOIN node_matches m ON m.entity_id = b.node_id WHERE rank = 1""", "below", "node_matches"))
def sanctioned_chain(spark, d):
    return _chain(spark, d).select("node_id", "depth", "matched_against", "match_score", F.array_join("path", ">").alias("path"))


@query("w13_best_per_node", with_views("""
SELECT entity_id AS node_id, row_id AS matched_against, candidate_name, match_score, classification FROM node_matches WHERE rank = 1""", "node_matches"))
def best_per_node(spark, d):
    """Findings in order of score; the node decides a tie."""
    return _chain(spark, d).orderBy(F.col("match_score").desc(), "node_id").select("node_id", "matched_against", "candidate_name", "match_score", "classification")


# --- citations --------------------------------------------------------------------------------

VIEWS["citations"] = ([], """
SELECT o_orderkey AS citation_id, o_custkey AS client_id, ['kyc_profile','transaction','sanctions_list','gdpr','pep_registry','llm_analysis'][o_orderkey % 6 + 1] AS source_type,
  CASE o_orderkey % 6
    WHEN 0 THEN ['sector_risk=high', 'unheard_of=1', o_custkey::VARCHAR, (o_custkey + 1)::VARCHAR || '-00'][(o_orderkey // 6) % 4 + 1]
    WHEN 1 THEN ['txn:' || (1000000000 + o_custkey % 1000), 'txn:9' || o_custkey || '77777777', 'on ' || strftime(o_orderdate, '%Y-%m-%d') || ' paid', 'TX:a|' || (1000000000 + o_custkey % 1000) || ' |b'][(o_orderkey // 6) % 4 + 1]
    WHEN 2 THEN ['ofac:small ring', 'opensanctions:zzzz qq', 'red', 'the old bolt and the hot rod firm'][(o_orderkey // 6) % 4 + 1]
    WHEN 3 THEN ['Article 5', 'article 777', 'article17', 'paragraph 3'][(o_orderkey // 6) % 4 + 1]
    WHEN 4 THEN 'registry a' ELSE 'model note' END AS source_id
FROM orders""")
VIEWS["list_texts"] = (["watchlist"], "SELECT DISTINCT lower(name) AS n, lower(array_to_string(aliases, '; ')) AS a FROM watchlist")
VIEWS["known_accounts"] = (["bank_transfers"], 'SELECT DISTINCT "Sender_account" AS account FROM bank_transfers UNION SELECT "Receiver_account" FROM bank_transfers')
VIEWS["checked"] = (["citations", "clients", "known_accounts", "client_transfers", "list_texts", "regulation"], """
SELECT *, CASE
  WHEN source_type IN ('pep_registry', 'llm_analysis') THEN 'no_ground_truth'
  WHEN source_type = 'kyc_profile' THEN CASE WHEN client_id NOT IN (SELECT client_id FROM clients) THEN 'no profile found for client_id=' || client_id
    WHEN contains(source_id, 'sector_risk') OR (regexp_matches(replace(source_id, '-', ''), '^\\d+$') AND contains(source_id, client_id::VARCHAR)) THEN ''
    ELSE '''' || source_id || ''' does not match any known profile field' END
  WHEN source_type = 'transaction' THEN CASE WHEN regexp_extract(source_id, '\\d{6,}') IN (SELECT account FROM known_accounts) OR citation_id IN (
      SELECT c.citation_id FROM citations c JOIN client_transfers t ON t.client_id = c.client_id WHERE c.source_type = 'transaction' AND (contains(c.source_id, t."Date")
        OR contains(c.source_id, t."Sender_account") OR contains(c.source_id, t."Receiver_account") OR contains(c.source_id, t."Amount"::VARCHAR))) THEN ''
    ELSE '''' || source_id || ''' does not match any transaction record' END
  WHEN source_type = 'sanctions_list' THEN CASE WHEN source_id = 'opensanctions:zzzz qq' OR source_id = 'red' OR NOT EXISTS (SELECT 1 FROM list_texts WHERE
      contains(n, replace(source_id, 'ofac:', '')) OR contains(replace(source_id, 'ofac:', ''), n) OR contains(a, replace(source_id, 'ofac:', '')))
    THEN '''' || source_id || ''' does not match any sanctions entry' ELSE '' END
  ELSE CASE WHEN source_id = 'article 777' THEN 'article ''article777'' not found in GDPR data' WHEN source_id = 'paragraph 3' THEN '''paragraph 3'' does not match any GDPR article' ELSE '' END END AS reason
FROM citations""")


def _checked(spark, d):
    mapping, transfers = tables.account_mapping(spark, d), tables.bank_transfers(spark, d)
    entries = tables.watchlist(spark, d).select("name", F.array_join("aliases", "; ").alias("aliases"))
    return grounding.verify_citations(
        tables.citations(spark, d), tables.clients(spark, d), transfers, tr.client_transfers(transfers, mapping), entries, tables.regulation(spark, d), mapping)


@query("j8_verified_citations", with_views("""
SELECT citation_id, client_id, source_type, source_id, reason, CASE reason WHEN '' THEN 'verified' WHEN 'no_ground_truth' THEN 'skipped' ELSE 'stripped' END AS status FROM checked""", "checked"))
def verified_citations(spark, d):
    return _checked(spark, d).drop("claim")


@query("a11_verification_counts", with_views("""
SELECT client_id, count(*) FILTER (reason = '') AS verified_count, count(*) FILTER (reason NOT IN ('', 'no_ground_truth')) AS stripped_count, count(*) FILTER (reason = 'no_ground_truth') AS skipped_count
FROM checked GROUP BY client_id""", "checked"))
def verification_counts(spark, d):
    return grounding.verification_counts(_checked(spark, d))


@query("j9_debate_references", """
SELECT o.o_orderkey AS ref_id, o.o_custkey AS client_id, reference, EXISTS (SELECT 1 FROM (SELECT o_custkey, 'txn:' || o_orderkey AS source_id FROM orders WHERE o_orderkey % 2 = 0) e
  WHERE e.o_custkey = o.o_custkey AND (contains(e.source_id, reference) OR contains(reference, e.source_id))) AS verified
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'txn:' || o_orderkey WHEN 1 THEN 'see txn:' || (o_orderkey + 1) || ' too' ELSE (o_orderkey % 100)::VARCHAR END AS reference FROM orders) o""")
def debate_references(spark, d):
    orders, key = tables.table(spark, d, "orders"), F.col("o_orderkey")
    text = (F.when(key % 3 == 0, F.concat(F.lit("txn:"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("see txn:"), (key + 1).cast("string"), F.lit(" too")))
            .otherwise((key % 100).cast("string")))
    refs = orders.select(key.alias("ref_id"), F.col("o_custkey").alias("client_id"), text.alias("reference"))
    evidence = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("client_id"), F.concat(F.lit("txn:"), key.cast("string")).alias("source_id"))
    return grounding.verify_references(refs, evidence)


@query("j10_guarded_claims", with_views("""
SELECT c.conv_id, c.turn, coalesce(v.supported, false) AS kept, coalesce(v.reason, 'no guard verdict') AS guard_reason FROM claims c
LEFT JOIN (SELECT conv_id, claim, arg_max(supported, turn) AS supported, arg_max(reason, turn) AS reason FROM verdicts GROUP BY conv_id, claim) v ON v.conv_id = c.conv_id AND v.claim = c.claim""", "claims", "verdicts"))
def guarded_claims(spark, d):
    return grounding.guard_claims(tables.claims(spark, d), tables.verdicts(spark, d)).select("conv_id", "turn", "kept", "guard_reason")


@query("r18_outcomes", with_views(f"""
SELECT client_id, CASE WHEN elevated THEN 'escalate_to_sar' ELSE 'false_positive_clear' END AS outcome, greatest(len(cited), 1) AS verified_count, (client_id % 9 = 0)::INT AS stripped_count,
  greatest(len(cited), 1) AS references_verified, 1 + (client_id % 9 = 0)::INT AS references_stripped,
  CASE WHEN elevated THEN 'AI-generated demo SAR draft. The review identified indicators requiring human compliance review. Deciding evidence: '
    || array_to_string(list_transform(cited, lambda x: CASE WHEN x LIKE 'txn:%' THEN 'txn:[ACCT_REDACTED]' ELSE x END), ', ') || '.' END AS narrative,
  CASE WHEN elevated THEN len(list_filter(cited, lambda x: x LIKE 'txn:%')) END AS redactions FROM ({disposition_sql})""", "clients", "client_transfers"))
def outcomes(spark, d):
    """From finding to outcome: evidence is checked, both sides' references are checked against what survives, and escalated cases get a report.

    Every ninth finding cites an account that does not exist; each debate names all cited sources and one that nobody cited.
    The report is drawn up from surviving evidence and redacted.
    """
    transfers, mapping = tables.bank_transfers(spark, d), tables.account_mapping(spark, d)
    own = tr.client_transfers(transfers, mapping)
    clients = tables.clients(spark, d)
    made = cases.dispositions(clients, tr.largest_client_transfer(transfers, mapping))
    invented = F.array(F.struct(F.lit("Unlisted account.").alias("claim"), F.lit("transaction").alias("source_type"),
                                F.concat(F.lit("txn:9"), F.col("client_id").cast("string"), F.lit("77777777")).alias("source_id"), F.lit("low").alias("confidence")))
    findings = cut_lineage(made.withColumn("evidence", F.when(F.col("client_id") % 9 == 0, F.concat("evidence", invented)).otherwise(F.col("evidence"))))
    items = findings.select("client_id", F.posexplode("evidence").alias("at", "e")).withColumn("citation_id", F.concat_ws("/", F.col("client_id").cast("string"), F.col("at").cast("string")))
    entries = tables.watchlist(spark, d).select("name", F.array_join("aliases", "; ").alias("aliases"))
    cited = items.select("citation_id", "client_id", "e.source_type", "e.source_id")
    checked = cut_lineage(grounding.verify_citations(cited, clients, transfers, own, entries, tables.regulation(spark, d), mapping).select("citation_id", "client_id", "status"))
    kept = items.join(checked.where("status <> 'stripped'").select("citation_id"), "citation_id")
    surviving = kept.groupBy("client_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("evidence"))
    grounded = findings.drop("evidence").join(surviving, "client_id", "left").withColumn("evidence", F.coalesce("evidence", F.filter(invented, lambda e: F.lit(False))))
    references = findings.select("client_id", F.explode(F.concat(F.transform("evidence", lambda e: e["source_id"]), F.array(F.lit("no such page")))).alias("reference"))
    debated = grounding.verify_references(references, kept.select("client_id", "e.source_id")).groupBy("client_id").agg(
        F.count_if("verified").alias("references_verified"), F.count_if(~F.col("verified")).alias("references_stripped"))
    text, log = tx.redact_report("narrative")
    reports = cases.reports(grounded).select("client_id", text.alias("narrative"), F.size(log).alias("redactions"))
    counts = grounding.verification_counts(checked).drop("skipped_count")
    return findings.select("client_id", F.col("verdict").alias("outcome")).join(counts, "client_id", "left").join(debated, "client_id", "left").join(reports, "client_id", "left")
