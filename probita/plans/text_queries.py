"""Queries over article, regulation and feed texts; whole texts, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions import text as tx
from probita.operators import cases, matching, media
from probita.operators import transactions as tr
from probita.plans.catalog import query
from probita.plans.match_queries import _matches
from probita.plans.views_sql import VIEWS, he, with_views
from probita.sources import tables


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# This engine's word class and boundary know ASCII only and it has no look-ahead, so letters beyond
# ASCII are spelled as ASCII words while the patterns run.
_beyond = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def _spell(expr: str, back: bool = False) -> str:
    for at, letter in enumerate(_beyond):
        word = f"_q{chr(97 + at)}_"
        expr = f"replace({expr}, '{word}', '{letter}')" if back else f"replace({expr}, '{letter}', '{word}')"
    return expr


_run = "'\\b(?:[a-z]\\s+){2,}[a-z]\\b'"
_lowered = _spell("lower(content)")
_rejoined = f"CASE WHEN regexp_matches({_lowered}, {_run}) THEN " + _spell(f"""array_to_string(list_transform(list_zip(string_split_regex({_lowered}, {_run}), regexp_extract_all({_lowered}, {_run})),
  lambda x: x[1] || coalesce(replace(x[2], ' ', ''), '')), '')""", True) + " ELSE lower(content) END"
_case = "\n".join(f"CASE WHEN regexp_matches(form, {_quoted(p)}) THEN {_quoted(label)} END," for p, label in V.INJECTION_PATTERNS)
_bare = ",\n".join(f"CASE WHEN regexp_matches(bare, {_quoted(p)}) THEN {_quoted(label)} END" for p, label in V.DESPACED_PATTERNS)
VIEWS["detection"] = (["articles"], f"SELECT *, regexp_replace({_rejoined}, '[ \\t\\r\\f]+', ' ', 'g') AS form, regexp_replace(lower(content), '[^a-z0-9]', '', 'g') AS bare FROM articles")
VIEWS["flagged"] = (["detection"], f"""
SELECT article_id, entity_id, source_url, content, list_filter([{_case}
{_bare}], lambda x: x IS NOT NULL) AS raw_categories,
  array_to_string(list_filter(list_transform(range(1, 12), lambda i: CASE WHEN raw[i] IS NOT NULL AND NOT list_contains(raw[1:i-1], raw[i]) THEN raw[i] END), lambda x: x IS NOT NULL), ', ') AS categories
FROM (SELECT *, [{_case}
{_bare}] AS raw FROM detection)""")
VIEWS["sentences"] = (["articles"], """
SELECT article_id, unnest(list_filter(list_transform(string_split(regexp_replace(replace(content, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS sentence,
  unnest(range(1, 1 + len(list_filter(list_transform(string_split(regexp_replace(replace(content, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')))) AS place
FROM articles""")
_hits = " + ".join(f"contains(lower(sentence), '{t}')::INT" for t in V.ALLEGATION_TERMS)
VIEWS["claim_rows"] = (["sentences"], f"""
SELECT article_id, place, sentence AS claim, {he(f"least(0.5::DOUBLE + 0.1::DOUBLE * ({_hits}), 0.9::DOUBLE)", 2)} AS confidence FROM sentences WHERE {_hits} > 0""")
VIEWS["findings"] = (["flagged", "claim_rows"], """
SELECT f.article_id, entity_id, source_url, categories, coalesce(n, 0) AS n_claims, coalesce(best, 0.0) AS best
FROM flagged f LEFT JOIN (SELECT article_id, count(*) AS n, max(confidence) AS best FROM claim_rows GROUP BY article_id) c ON c.article_id = f.article_id""")


def articles(spark, d):
    return tables.articles(spark, d)


def findings(spark, d):
    return media.analyze_articles(articles(spark, d))


@query("t1_detection_form", with_views("SELECT article_id, length(form) AS letters, md5(form) AS digest FROM detection", "detection"))
def detection_form(spark, d):
    form = articles(spark, d).select("article_id", tx.detection_form("content").alias("form"))
    return form.select("article_id", F.length("form").alias("letters"), F.md5("form").alias("digest"))


@query("t2_injection", with_views("SELECT article_id, categories FROM flagged", "flagged"))
def injection(spark, d):
    return tx.with_injection(articles(spark, d), "content").select("article_id", F.array_join("categories", ", ").alias("categories"))


@query("t3_flagged_articles", with_views("""
SELECT article_id, categories <> '' AS flagged, CASE WHEN categories <> '' THEN 'Suspected prompt injection (' || categories || '); treated as data, not instructions.' END AS summary,
  md5(content) AS digest FROM flagged""", "flagged"))
def flagged_articles(spark, d):
    kinds = tx.with_injection(articles(spark, d), "content", "c")
    return kinds.select("article_id", (F.size("c") > 0).alias("flagged"), tx.injection_summary("c").alias("summary"), F.md5("content").alias("digest"))


@query("t4_sentences", with_views("SELECT article_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS letters FROM sentences GROUP BY article_id", "sentences"))
def sentences(spark, d):
    parts = articles(spark, d).select("article_id", tx.sentences("content").alias("s"))
    letters = F.aggregate("s", F.lit(0).cast("long"), lambda total, s: total + F.length(s))
    return parts.where(F.size("s") > 0).select("article_id", F.size("s").cast("long").alias("sentences"), letters.alias("letters"))


@query("t5_claims", with_views("SELECT article_id, claim, confidence FROM claim_rows", "claim_rows"))
def claims(spark, d):
    return articles(spark, d).select("article_id", F.inline(tx.claims("content"))).drop("supported")


@query("t6_findings", with_views("""
SELECT article_id, entity_id, source_url, n_claims, categories <> '' AS injection_attempt_detected,
  CASE WHEN categories <> '' THEN 'Suspected prompt injection (' || categories || '); treated as data, not instructions.' END AS injection_details FROM findings""", "findings"))
def all_findings(spark, d):
    return findings(spark, d).select("article_id", "entity_id", "source_url", F.size("extracted_claims").cast("long").alias("n_claims"),
                                     "injection_attempt_detected", "injection_details")


def _ahead(pattern: str) -> tuple[str, str]:
    """A pattern with what it looks ahead for, which this engine must read as a second group."""
    head, _, tail = pattern.partition("(?=")
    return (f"({head})", f"({tail[:-1]})") if tail else (f"({head})", "()")


@query("t7_identifiers", with_views(" UNION ALL ".join(
    f"SELECT article_id, '{k}' AS kind, {_spell('m', True)} AS match FROM (SELECT article_id, unnest(regexp_extract_all(spelled, {_quoted(''.join(_ahead(p)) if '(?=' in p else p)}, {int('(?=' in p)})) AS m FROM (SELECT article_id, {_spell('content')} AS spelled FROM articles))" for k, p in V.EGRESS_PATTERNS), "articles"))
def identifiers(spark, d):
    return articles(spark, d).select("article_id", F.inline(tx.identifiers("content")))


def _redacted(expr: str) -> str:
    for k, p in V.EGRESS_PATTERNS:
        if "(?=" in p:
            expr = f"regexp_replace({expr}, {_quoted(''.join(_ahead(p)))}, '[REDACTED:{k}]\\2', 'g')"
        else:
            expr = f"regexp_replace({expr}, {_quoted(p)}, '[REDACTED:{k}]', 'g')"
    return expr


#: Of ``content``: its text with identifiers taken out, and the kinds found.
REDACTED = _spell(_redacted(_spell("content")), True)
IDENTIFIER_KINDS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches({_spell('content')}, {_quoted(''.join(_ahead(p)))}) THEN '{k}' END" for k, p in V.EGRESS_PATTERNS) + "], lambda x: x IS NOT NULL), ', ')"


@query("t8_egress", with_views(f"""
SELECT article_id, CASE WHEN out = content THEN 'sent' ELSE 'redacted' END AS status, md5(out) AS digest, CASE WHEN out = content THEN 'sent' ELSE 'blocked' END AS strict_status
FROM (SELECT *, {_spell(_redacted(_spell("content")), True)} AS out FROM articles)""", "articles"))
def egress(spark, d):
    out = articles(spark, d).select("article_id", tx.egress("content", "redact").alias("r"), tx.egress("content", "block").alias("b"))
    return out.select("article_id", "r.status", F.md5("r.text").alias("digest"), F.col("b.status").alias("strict_status"))


def _reports(spark, d):
    largest = tr.largest_client_transfer(tables.bank_transfers(spark, d), tables.account_mapping(spark, d))
    made = cases.reports(cases.dispositions(tables.clients(spark, d), largest))
    client = F.col("client_id")
    extra = F.concat(F.lit(" Born on 1970-01-02, and first seen at the branch on the harbour road on 2024-05-06. Mail a"), client.cast("string"), F.lit("@mail.example.com, id 123-45-6789, passport AB1234567, call +44 20 7946 0958, client_id=12345678."))
    return made.withColumn("narrative", F.concat("narrative", extra))


@query("t9_report_redaction", with_views("""
SELECT r.client_id, 'AI-generated demo SAR draft. The review identified indicators requiring human compliance review. Deciding evidence: '
  || array_to_string(list_filter([CASE WHEN sector_risk = 'High' THEN 'sector_risk=high' END, CASE WHEN sanctions_flag = 1 THEN 'sanctions_flag' END, CASE WHEN pep_flag = 1 THEN 'pep_flag' END,
    CASE WHEN fatf_country_flag = 1 THEN 'fatf_country_flag' END, CASE WHEN sectoral_sanctions_flag = 1 THEN 'sectoral_sanctions_flag' END, CASE WHEN t.client_id IS NOT NULL THEN 'txn:[ACCT_REDACTED]' END], lambda x: x IS NOT NULL), ', ')
  || '. Born on [DOB_REDACTED], and first seen at the branch on the harbour road on 2024-05-06. Mail [EMAIL_REDACTED], id [NATIONAL_ID_REDACTED], passport [PASSPORT_REDACTED], call [PHONE_REDACTED], client_id=12345678.' AS narrative,
  5 + (t.client_id IS NOT NULL)::INT AS redactions,
  'Generic AML suspicious activity review obligation|GDPR article5 (' || (SELECT arg_min(article_title, position) FROM regulation WHERE article_id = 'article5')
    || ')|GDPR article9 (' || (SELECT arg_min(article_title, position) FROM regulation WHERE article_id = 'article9') || ')' AS regulatory_basis
FROM clients r LEFT JOIN (SELECT DISTINCT client_id FROM client_transfers) t ON t.client_id = r.client_id
WHERE sector_risk = 'High' OR sanctions_flag = 1 OR pep_flag = 1 OR fatf_country_flag = 1 OR sectoral_sanctions_flag = 1""", "clients", "client_transfers", "regulation"))
def report_redaction(spark, d):
    regulation = tables.regulation(spark, d)
    titles = {a: regulation.where(F.col("article_id") == a).agg(F.min_by("article_title", "position")).scalar() for a in ("article5", "article9")}
    text, log = tx.redact_report("narrative")
    out = _reports(spark, d).select("client_id", "regulatory_basis", text.alias("narrative"), log.alias("log"))
    return out.select("client_id", "narrative", F.size("log").alias("redactions"),
                      F.array_join(tx.merge_references(F.col("regulatory_basis"), F.col("log"), titles), "|").alias("regulatory_basis"))


@query("w11_first_texts", with_views("SELECT position, article_id, article_title FROM (SELECT *, row_number() OVER (PARTITION BY article_text ORDER BY position) AS rn FROM regulation) WHERE rn = 1", "regulation"))
def first_texts(spark, d):
    return media.first_texts(tables.regulation(spark, d)).select("position", "article_id", "article_title")


@query("t10_regulation_search", with_views("""
SELECT query_id, position, score, rn AS rank, article_id, article_title FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rn FROM (
    SELECT q.item_id AS query_id, p.position, p.article_id, p.article_title, floor(count(*)::DOUBLE / any_value(q.n) * 100)::INT AS score FROM
      (SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM benchmark) q
      JOIN (SELECT position, article_id, article_title, unnest(list_distinct(regexp_extract_all(lower(article_title || ' ' || article_text || ' ' || article_recitals), '[a-z0-9]+'))) AS w
        FROM (SELECT *, row_number() OVER (PARTITION BY article_text ORDER BY position) AS k FROM regulation) WHERE k = 1) p ON p.w = q.w
    GROUP BY ALL) WHERE score > 0) WHERE rn <= 5""", "regulation"))
def regulation_search(spark, d):
    queries = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return media.search_regulation(queries, tables.regulation(spark, d))


_news_high = " OR ".join(f"contains(t, '{w}')" for w in V.NEWS_HIGH)
_news_medium = " OR ".join(f"contains(t, '{w}')" for w in V.NEWS_MEDIUM)


@query("a9_company_news", with_views(f"""
SELECT company, true AS negative_news_found, CASE WHEN bool_or({_news_high}) THEN 'HIGH' WHEN bool_or({_news_medium}) THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  arg_min(source, rn) AS source, count(*) AS source_count, 0.72::DOUBLE AS confidence, bool_or({_news_high}) AS mentions_sanctions FROM (
  SELECT d.source AS company, lower(d.lang || ' ' || a.content) AS t, d.lang || '-wire' AS source, row_number() OVER (PARTITION BY d.source ORDER BY doc_id DESC) AS rn
  FROM documents d JOIN articles a ON a.article_id = d.doc_id) WHERE rn <= 5 GROUP BY company""", "articles"))
def company_news(spark, d):
    documents = tables.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "lang", "source")
    feed = articles(spark, d).select("article_id", "content").join(documents, "article_id").select(
        F.col("source").alias("company"), F.col("lang").alias("title"), F.col("content").alias("description"),
        F.concat("lang", F.lit("-wire")).alias("source"), F.col("article_id").alias("published_at"), F.col("article_id").alias("news_id"))
    return media.company_news(feed)


@query("t12_headlines", "SELECT page_id, 'LiveNews:' || substr(url, 1, 40) || '...' AS source_id, url AS title FROM pages")
def headlines(spark, d):
    return media.headlines(tables.table(spark, d, "pages").select("page_id", F.col("url").alias("title"))).select("page_id", "source_id", "title")


@query("a12_detector_scores", with_views("""
SELECT caught, positives, false_alarms, negatives, round_even(caught / nullif(caught + false_alarms, 0)::DOUBLE * 1e6, 0) / 1e6 AS precision, round_even(caught / nullif(positives, 0)::DOUBLE * 1e6, 0) / 1e6 AS recall FROM (
  SELECT count(*) FILTER (categories <> '' AND toxic = 1) AS caught, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (categories <> '' AND toxic = 0) AS false_alarms,
    count(*) FILTER (toxic = 0) AS negatives FROM flagged JOIN labels ON doc_id = article_id)""", "flagged"))
def detector_scores(spark, d):
    labels = tables.table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), (F.col("toxic") == 1).alias("actual"))
    predicted = tx.with_injection(articles(spark, d), "content").select("article_id", (F.size("categories") > 0).alias("predicted"))
    return media.detector_scores(predicted.join(labels, "article_id"))


_media_result = f"""SELECT entity_id AS client_id, 'adverse_media' AS source_type, source_url AS source_name, {he("best * 100", 2)} AS match_confidence,
  CASE WHEN categories <> '' THEN 'needs_review' WHEN n_claims = 0 THEN 'no_match' ELSE 'likely_match' END AS decision FROM findings"""


@query("p35_media_results", with_views(_media_result, "findings"))
def media_results(spark, d):
    return media.media_results(findings(spark, d)).select("client_id", "source_type", "source_name", "match_confidence", "decision")


_signal_sql = """SELECT entity_id, arg_max(categories = '' AND n_claims > 0, article_id) AS negative_news_found,
  arg_max(CASE WHEN categories = '' AND n_claims > 0 THEN best ELSE -1 END, article_id) AS media_confidence FROM findings GROUP BY entity_id"""


@query("p36_media_signal", with_views(f"SELECT entity_id, negative_news_found, nullif(media_confidence, -1) AS media_confidence FROM ({_signal_sql})", "findings"))
def media_signal(spark, d):
    return media.last_signal(findings(spark, d)).select(
        "entity_id", "adverse_media.negative_news_found", F.col("adverse_media.confidence").alias("media_confidence"))


@query("r19_risk_signals", with_views(f"""
SELECT q.entity_id, m.entity_id IS NOT NULL AS has_match, m.match_score AS match_confidence, coalesce(s.negative_news_found, false) AS negative_news_found
FROM asked q LEFT JOIN (SELECT * FROM matches WHERE rank = 1) m ON m.entity_id = q.entity_id LEFT JOIN ({_signal_sql}) s ON s.entity_id = q.entity_id""", "asked", "matches", "findings"))
def risk_signals(spark, d):
    best = matching.sanctions_signal(matching.with_evidence_ids(_matches(spark, d, 1)))
    customers = tables.screen_queries(spark, d).select("entity_id")
    joined = customers.join(best, "entity_id", "left").join(media.last_signal(findings(spark, d)), "entity_id", "left")
    return joined.select("entity_id", F.coalesce("screened.has_match", F.lit(False)).alias("has_match"), "screened.match_confidence",
                         F.coalesce("adverse_media.negative_news_found", F.lit(False)).alias("negative_news_found"))


@query("r20_entity_intelligence", with_views(f"""
SELECT client_id, source_type, count(*) AS results, round(sum(match_confidence), 2) AS confidence FROM (
  SELECT entity_id AS client_id, CASE WHEN source IN ('OFAC SDN', 'opensanctions') THEN 'sanctions' ELSE 'watchlist' END AS source_type, {he("match_score * 100", 2)} AS match_confidence FROM matches
  UNION ALL SELECT client_id, source_type, match_confidence FROM ({_media_result})) GROUP BY ALL""", "matches", "findings"))
def entity_intelligence(spark, d):
    screened = matching.intelligence_results(matching.with_evidence_ids(_matches(spark, d)))
    everything = screened.unionByName(media.media_results(findings(spark, d)))
    return everything.groupBy("client_id", "source_type").agg(F.count(F.lit(1)).alias("results"), F.round(F.sum("match_confidence"), 2).alias("confidence"))
