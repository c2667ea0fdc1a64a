"""The table views of ``probita.sources.tables`` in plain SQL, for checking results on another engine."""

from __future__ import annotations

from probita.sources.tables import PLANTED

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, sql: str, needs: list[str] | None = None) -> None:
    VIEWS[name] = (needs or [], sql)


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind a WITH clause of the named views and whatever they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{name} AS (\n{VIEWS[name][1]}\n)" for name in order)
    return f"WITH RECURSIVE {body}\n{sql}" if order else sql


def he(expr: str, digits: int = 0) -> str:
    """Round half to even."""
    if digits == 0:
        return f"round_even(({expr})::DOUBLE, 0)"
    return f"format('{{:.{digits}f}}', ({expr})::DOUBLE)::DOUBLE"  # printing rounds the exact binary value


_view("clients", """
SELECT c_custkey AS client_id, c_name AS client_name,
  ['NGO','Financial Institution','Corporate','Individual'][c_custkey % 4 + 1] AS client_type,
  c_mktsegment AS sector,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'High' WHEN c_mktsegment IN ('BUILDING','HOUSEHOLD') THEN 'Medium' ELSE 'Low' END AS sector_risk,
  n_name AS country, (c_custkey % 11 = 0)::INT AS pep_flag, (c_custkey % 37 = 0)::INT AS sanctions_flag,
  (c_nationkey < 5)::INT AS fatf_country_flag, (c_nationkey IN (5,6))::INT AS ofac_country_flag,
  (c_custkey % 29 = 0)::INT AS sectoral_sanctions_flag, (c_custkey * 389 % 1000) / 1000.0::DOUBLE AS ownership_opacity_score
FROM customer JOIN nation ON n_nationkey = c_nationkey""")

_view("raw_kyc", """
SELECT client_id AS row_number,
  CASE WHEN client_id % 50 = 1 THEN '' WHEN client_id % 53 = 2 THEN (client_id - 1)::VARCHAR ELSE client_id::VARCHAR END AS client_id,
  CASE WHEN client_id % 61 = 0 THEN '   ' ELSE '  ' || client_name || '   Ltd ' END AS client_name,
  CASE WHEN client_id % 71 = 0 THEN repeat(client_type, 20) ELSE client_type END AS client_type,
  lower(country) AS country, CASE WHEN client_id % 67 = 0 THEN '' ELSE sector END AS sector,
  ['High','med','LOW','Medium','??'][client_id % 5 + 1] AS sector_risk,
  ['true','0',' YES ','n','maybe','F','1'][client_id % 7 + 1] AS pep_flag,
  sanctions_flag::VARCHAR AS sanctions_flag,
  ['true','0',' YES ','n','maybe','F','1'][(client_id // 7) % 7 + 1] AS fatf_country_flag
FROM clients""", ["clients"])

_view("transactions", """
SELECT o_orderkey AS transaction_id, o_custkey AS client_id, o_totalprice AS amount, o_orderdate AS "timestamp",
  (o_orderkey % 97 = 0)::INT AS ofac_match_flag, (o_orderkey % 31 = 0)::INT AS fatf_country_flag,
  (o_orderkey % 41 = 0)::INT AS structuring_pattern_flag, (o_orderkey % 43 = 0)::INT AS rapid_movement_flag,
  (o_orderkey % 47 = 0)::INT AS trade_mispricing_flag
FROM orders""")

_view("stats", """
SELECT client_id, count(*) AS transaction_count, sum(amount) AS total_amount, avg(amount) AS avg_amount, max(amount) AS max_amount,
  sum(ofac_match_flag)::BIGINT AS ofac_matches, sum(fatf_country_flag)::BIGINT AS fatf_hits,
  sum(structuring_pattern_flag)::BIGINT AS structuring_hits, sum(rapid_movement_flag)::BIGINT AS rapid_movement_hits,
  sum(trade_mispricing_flag)::BIGINT AS trade_mispricing_hits,
  sum(ofac_match_flag + fatf_country_flag)::BIGINT AS high_risk_country_transfers,
  sum(structuring_pattern_flag + rapid_movement_flag + trade_mispricing_flag)::BIGINT AS typology_hits
FROM transactions GROUP BY client_id""", ["transactions"])

_view("joined", """
SELECT c.*, coalesce(transaction_count,0) AS n, coalesce(avg_amount,0) AS avg_amount, coalesce(max_amount,0) AS max_amount,
  coalesce(total_amount,0) AS total_amount, coalesce(ofac_matches,0) AS ofac_matches,
  coalesce(high_risk_country_transfers,0) AS transfers, coalesce(typology_hits,0) AS typologies
FROM clients c LEFT JOIN stats s ON s.client_id = c.client_id""", ["clients", "stats"])

_view("payload", """
SELECT *, CASE upper(sector_risk) WHEN 'MEDIUM' THEN 32 WHEN 'HIGH' THEN 48 ELSE 18 END AS previous_score,
  (sanctions_flag = 1 OR ofac_country_flag = 1 OR ofac_matches > 0) AS has_match,
  CASE WHEN sanctions_flag = 1 THEN 0.92::DOUBLE WHEN ofac_matches > 0 THEN 0.78::DOUBLE ELSE 0.0::DOUBLE END AS match_confidence,
  least(0.95::DOUBLE, typologies::DOUBLE / greatest(n, 1) * 1.8::DOUBLE + ofac_matches * 0.1::DOUBLE) AS suspicious_probability,
  CASE WHEN n = 0 THEN 1.0::DOUBLE WHEN max_amount > greatest(avg_amount * 4, 10000.0::DOUBLE) THEN 3.0::DOUBLE
       WHEN max_amount > greatest(avg_amount * 2.5::DOUBLE, 5000.0::DOUBLE) THEN 2.0::DOUBLE ELSE 1.2::DOUBLE END AS volume_change,
  (sanctions_flag = 1 AND ownership_opacity_score >= 0.65) AS sanctioned_ubo,
  CASE WHEN ownership_opacity_score >= 0.75 THEN 3 WHEN ownership_opacity_score >= 0.45 THEN 2 ELSE 1 END AS shell_layers,
  least(0.95::DOUBLE, 0.55::DOUBLE + ownership_opacity_score * 0.4::DOUBLE) AS ownership_confidence
FROM joined""", ["joined"])

# One row per customer and factor, in the order of the components.
_view("factors", """
SELECT client_id, 0 AS ordinal, 'kyc_profile_risk' AS component, 'existing_kyc_high' AS name, 10.0::DOUBLE AS points, 0.88::DOUBLE AS confidence, 'Existing KYC profile is high risk' AS reason FROM payload WHERE sector_risk = 'High'
UNION ALL SELECT client_id, 1, 'kyc_profile_risk', 'existing_kyc_medium', 6.0, 0.88, 'Existing KYC profile is medium risk' FROM payload WHERE sector_risk = 'Medium'
UNION ALL SELECT client_id, 2, 'kyc_profile_risk', 'existing_kyc_low', 2.0, 0.88, 'Existing KYC profile is low risk' FROM payload WHERE sector_risk = 'Low'
UNION ALL SELECT client_id, 3, 'kyc_profile_risk', 'pep_flag', 7.0, 0.88, 'Customer or linked party is marked as PEP' FROM payload WHERE pep_flag = 1
UNION ALL SELECT client_id, 7, 'sanctions_risk', 'direct_entity_sanctions_match', 18.0, match_confidence, 'Direct entity sanctions match' FROM payload WHERE has_match
UNION ALL SELECT client_id, 9, 'sanctions_risk', 'ownership_chain_sanctions_hit', 8.0, ownership_confidence,
  CASE WHEN shell_layers >= 2 THEN 'UBO-chain sanctions match found ' || shell_layers || ' layer(s) deep' ELSE 'UBO-chain sanctions match found' END FROM payload WHERE sanctioned_ubo
UNION ALL SELECT client_id, 10, 'sanctions_risk', 'adverse_media_sanctions_mention', 4.0, 0.72, 'Adverse media mentions sanctions exposure' FROM payload WHERE sectoral_sanctions_flag = 1
UNION ALL SELECT client_id, 11, 'transaction_risk', 'transaction_model_probability', 14.0, suspicious_probability,
  CASE WHEN suspicious_probability >= 0.7 THEN 'Transaction monitoring model reports high suspicious probability'
       WHEN suspicious_probability >= 0.4 THEN 'Transaction monitoring model reports moderate suspicious probability'
       ELSE 'Transaction monitoring model reports suspicious activity probability' END FROM payload WHERE suspicious_probability <> 0
UNION ALL SELECT client_id, 12, 'transaction_risk', 'volume_spike_3x', 4.0, 0.85, 'Monthly transaction volume increased by 3x or more' FROM payload WHERE volume_change >= 3
UNION ALL SELECT client_id, 13, 'transaction_risk', 'volume_spike_2x', 3.0, 0.85, 'Monthly transaction volume increased by 2x or more' FROM payload WHERE volume_change = 2
UNION ALL SELECT client_id, 15, 'transaction_risk', 'repeated_high_risk_jurisdiction_transfers', 4.0, 0.85, 'Repeated transfers involving high-risk jurisdictions' FROM payload WHERE transfers >= 10
UNION ALL SELECT client_id, 16, 'transaction_risk', 'some_high_risk_jurisdiction_transfers', 2.0, 0.85, 'Some transfers involve high-risk jurisdictions' FROM payload WHERE transfers BETWEEN 3 AND 9
UNION ALL SELECT client_id, 17, 'transaction_risk', 'aml_typology_hits', least(3.0::DOUBLE, typologies * 1.5::DOUBLE), 0.80, typologies || ' AML typology signal(s) detected' FROM payload WHERE typologies <> 0
UNION ALL SELECT client_id, 18, 'adverse_media_risk', 'media_severity', 11.0, 0.72, 'high adverse-media signal found' FROM payload WHERE sectoral_sanctions_flag = 1
UNION ALL SELECT client_id, 21, 'adverse_media_risk', 'recent_media_event', 1.0, 0.72, 'Adverse media event is recent' FROM payload WHERE sectoral_sanctions_flag = 1
UNION ALL SELECT client_id, 22, 'jurisdiction_risk', 'fatf_high_risk_jurisdiction', 5.0, 0.90, 'Customer is linked to FATF high-risk jurisdiction' FROM payload WHERE fatf_country_flag = 1
UNION ALL SELECT client_id, 23, 'jurisdiction_risk', 'high_risk_jurisdiction', 3.0, 0.90, 'Customer is linked to high-risk jurisdiction' FROM payload WHERE fatf_country_flag = 0 AND ofac_country_flag = 1
""", ["payload"])

_view("scored_factors", """
SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence)) AS sure, points * greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence)) AS contribution
FROM factors""", ["factors"])

_view("components", """
SELECT p.client_id,
  least(25.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(list_sum(list(contribution ORDER BY ordinal) FILTER (component = 'kyc_profile_risk')), 0.0::DOUBLE))) AS kyc_profile_risk,
  least(30.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(list_sum(list(contribution ORDER BY ordinal) FILTER (component = 'sanctions_risk')), 0.0::DOUBLE))) AS sanctions_risk,
  least(25.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(list_sum(list(contribution ORDER BY ordinal) FILTER (component = 'transaction_risk')), 0.0::DOUBLE))) AS transaction_risk,
  least(15.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(list_sum(list(contribution ORDER BY ordinal) FILTER (component = 'adverse_media_risk')), 0.0::DOUBLE))) AS adverse_media_risk,
  least(5.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(list_sum(list(contribution ORDER BY ordinal) FILTER (component = 'jurisdiction_risk')), 0.0::DOUBLE))) AS jurisdiction_risk,
  count(contribution) FILTER (contribution > 0) AS n_factors,
  list_sum(list(sure * (contribution / greatest(points, 1.0::DOUBLE)) ORDER BY ordinal) FILTER (contribution > 0)) AS sum_confidence
FROM payload p LEFT JOIN scored_factors f ON f.client_id = p.client_id GROUP BY p.client_id""", ["payload", "scored_factors"])

_view("based", f"""
SELECT p.client_id, p.previous_score, p.sanctions_flag, p.sanctioned_ubo, p.match_confidence, p.ownership_confidence, c.* EXCLUDE (client_id),
  {he("least(100.0::DOUBLE, kyc_profile_risk + sanctions_risk + transaction_risk + adverse_media_risk + jurisdiction_risk)")}::INT AS base_score,
  CASE WHEN n_factors = 0 OR n_factors IS NULL THEN 0.85::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum_confidence / n_factors + 0.10::DOUBLE)) END AS confidence,
  CASE WHEN sanctions_flag = 1 THEN match_confidence WHEN sanctioned_ubo THEN ownership_confidence ELSE 0.0::DOUBLE END AS confirmed
FROM payload p JOIN components c ON c.client_id = p.client_id""", ["payload", "components"])

_view("floored", """
SELECT *, CASE WHEN confirmed >= 0.85 THEN 85 WHEN confirmed >= 0.60 THEN 65 END AS escalation_floor,
  greatest(base_score, CASE WHEN confirmed >= 0.85 THEN 85 WHEN confirmed >= 0.60 THEN 65 ELSE base_score END)::INT AS risk_score
FROM based""", ["based"])

_view("assessed", f"""
SELECT client_id, previous_score, base_score, risk_score, escalation_floor,
  CASE WHEN risk_score >= 81 THEN 'CRITICAL' WHEN risk_score >= 61 THEN 'HIGH' WHEN risk_score >= 31 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  {he("confidence", 4)} AS confidence_score, risk_score - previous_score AS risk_delta,
  CASE WHEN risk_score - previous_score >= 5 THEN 'RISING' WHEN risk_score - previous_score <= -5 THEN 'FALLING' ELSE 'STABLE' END AS risk_trend,
  risk_score >= 61 AS trigger_investigation, (risk_score >= 81 AND confidence >= 0.70) AS sar_recommended,
  (risk_score - greatest(0, previous_score - 8)) / 21.0::DOUBLE AS per_day,
  {", ".join(f'{he(c, 2)} AS {c}' for c in ["kyc_profile_risk", "sanctions_risk", "transaction_risk", "adverse_media_risk", "jurisdiction_risk"])}
FROM floored""", ["floored"])

_view("reasons", f"""
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY contribution DESC, ordinal) AS place,
  '+' || {he("contribution", 1)}::VARCHAR || ' pts: ' || reason || ' (' || {he("sure * 100")}::INT || '% confidence)' AS reason
FROM scored_factors""", ["scored_factors"])

_view("top_cases", """
SELECT * FROM assessed ORDER BY risk_score DESC, confidence_score DESC, client_id LIMIT 30""", ["assessed"])

_view("bank_transfers", """
SELECT l_orderkey * 10 + l_linenumber AS position, l_linenumber::VARCHAR AS "Time", strftime(l_shipdate, '%Y-%m-%d') AS "Date",
  (1000000000 + l_suppkey)::VARCHAR AS "Sender_account", (2000000000 + l_partkey)::VARCHAR AS "Receiver_account",
  l_extendedprice AS "Amount", (l_returnflag = 'R')::INT AS "Is_laundering"
FROM lineitem""")

_view("account_mapping", """
SELECT c_custkey AS client_id, (1000000000 + c_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS account FROM customer""")

_view("client_transfers", """
SELECT DISTINCT m.client_id, t."Date", t."Time", t."Sender_account", t."Receiver_account", t."Amount"
FROM bank_transfers t JOIN account_mapping m ON m.account IN (t."Sender_account", t."Receiver_account")""",
      ["bank_transfers", "account_mapping"])

_view("watchlist", """
SELECT 'W-' || p_partkey AS row_id, 'W-' || p_partkey AS entity_id, p_name AS name,
  CASE WHEN p_partkey % 3 = 0 THEN [split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1), p_name || ' co'] ELSE []::VARCHAR[] END AS aliases,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (1950 + p_size)::VARCHAR END AS dob, p_type AS nationality,
  CASE WHEN p_partkey % 2 = 0 THEN 'individual' ELSE 'entity' END AS entity_type,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS company,
  ['OFAC SDN','opensanctions','pep register'][p_partkey % 3 + 1] AS source_list,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'dealer in ' || p_name || ' goods' END AS context
FROM part""")

_view("screen_queries", """
SELECT 'CLIENT-' || c_custkey AS entity_id,
  CASE WHEN c_custkey % 5 = 0 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) ELSE p_name END AS name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (1950 + p_size)::VARCHAR END AS dob,
  CASE WHEN c_custkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS nationality,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE p_brand END AS company,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'maker of ' || p_name || ' in ' || lower(p_type) END AS context
FROM customer JOIN part ON p_partkey = c_custkey * 7 % (SELECT count(*) FROM part)""")

_view("ownership_edges", """
SELECT DISTINCT 'N-' || lpad(o::VARCHAR, 10, '0') AS owner_id, 'N-' || lpad(c::VARCHAR, 10, '0') AS owned_id FROM (
  SELECT p_partkey // 3 AS o, p_partkey AS c FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey % 7, p_partkey FROM part WHERE p_partkey > 0 AND p_partkey % 50 = 0) WHERE o <> c""")

_planted = ", ".join("'" + text.replace("'", "''") + "'" for text in PLANTED)
_view("articles", f"""
SELECT doc_id AS article_id, 'CLIENT-' || (doc_id % 97) AS entity_id, 'file://' || doc_id AS source_url,
  CASE WHEN doc_id % 10 < 9 THEN text || chr(10) || [{_planted}][doc_id % 10 + 1] ELSE text END AS content
FROM documents""")

_view("regulation", """
SELECT 'article' || (doc_id % 100) AS article_id, lang || ' ' || source AS article_title, text AS article_text, source AS article_recitals, doc_id AS position
FROM documents""")

_view("audit_rows", """
SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS chain_id, 'AUD-' || lpad(event_id::VARCHAR, 12, '0') AS event_id,
  'user-' || user_id AS actor, event_type AS action, 'res-' || (event_id % 13) AS resource, props AS reason,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", ts
FROM events""")

_view("score_history", """
SELECT o_custkey AS customer_id, floor(o_totalprice / 6000.0)::INT AS score, o_orderdate AS "timestamp", o_orderkey AS position FROM orders""")

_view("claims", """
SELECT conv_id, turn, text AS claim, 0.7::DOUBLE AS confidence FROM conversations WHERE role = 'user'""")

_view("verdicts", """
SELECT u.conv_id, a.turn, u.text AS claim, (u.conv_id + a.turn // 2) % 2 = 0 AS supported, substr(a.text, 1, 20) AS reason
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant' AND (u.conv_id + a.turn) % 5 <> 0""")
