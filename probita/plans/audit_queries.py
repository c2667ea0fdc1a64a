"""Queries of the audit log and of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.operators import audit, media
from probita.operators.matching import with_evidence_ids
from probita.plans.catalog import query
from probita.plans.match_queries import _matches
from probita.plans.text_queries import IDENTIFIER_KINDS, REDACTED, findings
from probita.plans.views_sql import VIEWS, with_views
from probita.session import scratch_path
from probita.sources import tables
from probita.streaming import monitors

VIEWS["numbered"] = (["audit_rows"], "SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts, event_id) AS seq FROM audit_rows")
_content = "event_id || '|' || actor || '|' || action || '|' || resource || '|' || reason || '|' || \"timestamp\" || '|'"
VIEWS["chained"] = (["numbered"], f"""
SELECT chain_id, seq, event_id, 'GENESIS' AS previous_hash, sha256({_content} || 'GENESIS') AS hash FROM numbered WHERE seq = 1
UNION ALL SELECT n.chain_id, n.seq, n.event_id, c.hash, sha256(n.event_id || '|' || n.actor || '|' || n.action || '|' || n.resource || '|' || n.reason || '|' || n."timestamp" || '|' || c.hash)
FROM chained c JOIN numbered n ON n.chain_id = c.chain_id AND n.seq = c.seq + 1""")


def numbered(spark, d):
    return audit.number_events(tables.audit_rows(spark, d)).drop("ts")


def chained(spark, d):
    return audit.write_chain(numbered(spark, d))


def chain_log(spark, d):
    """The chain as a user keeps it: written once, read back for every check."""
    path = scratch_path(spark, "chain")
    chained(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def tampered(spark, d):
    """Every seventh event's reason is changed and every eleventh's link cut after the fact."""
    number = F.substring("event_id", 5, 12).cast("long")
    return chain_log(spark, d).withColumns({
        "reason": F.when(number % 7 == 0, F.lit("changed")).otherwise(F.col("reason")),
        "previous_hash": F.when(number % 11 == 0, F.lit("cut")).otherwise(F.col("previous_hash"))})


@query("l3_hash_chain", with_views("SELECT chain_id, seq, event_id, previous_hash, hash FROM chained", "chained"))
def hash_chain(spark, d):
    return chained(spark, d).select("chain_id", "seq", "event_id", "previous_hash", "hash")


_verified = """
SELECT chain_id, first_bad IS NULL AS valid, coalesce(first_bad, n) AS events_checked, bad_event AS broken_at, bad_reason AS reason FROM (
  SELECT chain_id, count(*) AS n, min(seq) FILTER (reason IS NOT NULL) AS first_bad, arg_min(event_id, seq) FILTER (reason IS NOT NULL) AS bad_event, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS bad_reason FROM (
    SELECT * EXCLUDE (reason), CASE WHEN substr(event_id, 5)::BIGINT % 11 = 0 THEN 'previous_hash mismatch' WHEN substr(event_id, 5)::BIGINT % 7 = 0 THEN 'content altered' END AS reason FROM numbered) GROUP BY chain_id)"""


@query("l4_verify_chain", with_views(_verified, "numbered"))
def verify_chain(spark, d):
    return audit.verify_pipe_chain(tampered(spark, d))


@query("w14_link_check", with_views("""
SELECT chain_id, seq, event_id FROM (SELECT *, CASE WHEN substr(event_id, 5)::BIGINT % 11 = 0 THEN 'cut' ELSE previous_hash END AS stored, lag(hash) OVER (PARTITION BY chain_id ORDER BY seq) AS before FROM chained)
WHERE stored <> coalesce(before, 'GENESIS')""", "chained"))
def link_check(spark, d):
    """Rows whose link does not point at the row before."""
    rows = tampered(spark, d)
    before = rows.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    linked = rows.join(before, ["chain_id", "seq"], "left")
    return linked.where(F.col("previous_hash") != F.coalesce("before", F.lit(V.WORD_GENESIS))).select("chain_id", "seq", "event_id")


def stored(spark, d):
    """The log as lines, written once and read back for every check."""
    rows = numbered(spark, d)
    bodies = rows.select("chain_id", "seq", "event_id", F.to_json(F.struct(*audit.PIPE_FIELDS)).alias("body"))
    path = scratch_path(spark, "stored")
    audit.stored_events(audit.write_chain(bodies, V.ZERO_GENESIS, kind="json")).write.parquet(path)
    return spark.read.parquet(path)


@query("l5_verify_json_chain", with_views("""
SELECT chain_id, n < 3 OR NOT bad AS valid, CASE WHEN n >= 3 AND bad THEN 2 ELSE CASE WHEN late THEN n - 1 ELSE n END END AS events_checked, NOT late AS verified_from_genesis FROM (
  SELECT chain_id, count(*) AS n, chain_id LIKE '1%' OR chain_id LIKE '4%' AS bad, chain_id LIKE '2%' AND count(*) > 1 AS late FROM numbered GROUP BY chain_id)""", "numbered"))
def verify_json_chain(spark, d):
    """Chains beginning with 1 have their second event altered, of those beginning with 4 it is gone; of those beginning with 2 the first is no longer kept."""
    rows = stored(spark, d)
    size = rows.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(size, "chain_id")
    altered = F.col("chain_id").startswith("1") & (F.col("seq") == 2) & (F.col("n") >= 3)
    lost = F.col("chain_id").startswith("2") & (F.col("seq") == 1) & (F.col("n") > 1)
    gone = F.col("chain_id").startswith("4") & (F.col("seq") == 2) & (F.col("n") >= 3)
    changed = rows.where(~lost & ~gone).withColumn("line", F.when(altered, F.regexp_replace("line", '"actor":"', '"actor":"x')).otherwise(F.col("line")))
    return audit.verify_json_chain(changed.drop("n")).select("chain_id", "valid", "events_checked", "verified_from_genesis")


@query("l6_verify_lines", with_views("""
SELECT chain_id, NOT (bad AND n >= 2) AS valid, CASE WHEN bad AND n >= 2 THEN 1 ELSE n END AS lines_checked, CASE WHEN bad AND n >= 2 THEN 4 END AS failed_line,
  CASE WHEN bad AND n >= 2 THEN 'malformed JSON line' END AS reason FROM (SELECT chain_id, count(*) AS n, chain_id LIKE '3%' AS bad FROM numbered GROUP BY chain_id)""", "numbered"))
def verify_lines(spark, d):
    """Lines with blank ones between them; the second event of chains beginning with 3 is cut short."""
    cut = F.col("chain_id").startswith("3") & (F.col("seq") == 2)
    lines = stored(spark, d).withColumn("line", F.when(cut, F.substring("line", 1, 25)).otherwise(F.col("line")))
    spaced = lines.select("chain_id", F.posexplode(F.array(F.lit("  "), "line")).alias("at", "line"), "seq")
    return audit.verify_lines(spaced.select("chain_id", (F.col("seq") * 2 + F.col("at") - 1).alias("line_number"), "line"))


def audit_events(spark, d):
    """Structured events, some of which break a rule."""
    key = F.col("event_id")
    return tables.table(spark, d, "events").select(
        key, F.when(key % 19 == 0, F.lit("OTHER")).otherwise(F.lit("INGESTION")).alias("event_type"),
        F.when(key % 5 == 0, F.col("event_type")).otherwise(F.concat(F.lit("user."), F.col("event_type"))).alias("action"),
        F.lit("SUCCESS").alias("outcome"), F.lit("INFO").alias("severity"),
        F.when(key % 23 == 0, F.repeat(F.lit("a"), 201)).otherwise(F.col("user_id").cast("string")).alias("actor_id"), F.lit("USER").alias("actor_type"),
        F.when(key % 3 == 0, F.lit("Bad Type")).when(key % 3 == 1, F.lit("api_endpoint")).alias("resource_type"),
        F.lit(None).cast("string").alias("resource_id"), F.when(key % 29 == 0, F.lit("")).alias("request_id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(key % 31 == 0, F.lit("")).otherwise(F.lit("+00:00"))).alias("timestamp"),
        (F.col("value") - F.when(key % 37 == 0, 1e6).otherwise(0.0)).alias("duration_ms"))


@query("l1_event_rules", """
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 19 = 0 THEN 'event_type' END, CASE WHEN event_id % 5 = 0 THEN 'action' END, CASE WHEN event_id % 23 = 0 THEN 'actor_id' END,
  CASE WHEN event_id % 3 = 0 THEN 'resource_type' END, CASE WHEN event_id % 29 = 0 THEN 'request_id' END, CASE WHEN event_id % 31 = 0 THEN 'timestamp' END,
  CASE WHEN value - CASE WHEN event_id % 37 = 0 THEN 1e6 ELSE 0 END < 0 THEN 'duration_ms' END], lambda x: x IS NOT NULL), ',') AS violations FROM events""")
def event_rules(spark, d):
    return audit.validate_events(audit_events(spark, d)).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("l2_sanitized_metadata", """
SELECT event_id, event_type AS kind, '[REDACTED]' AS api_token, event_id::VARCHAR AS key_id, repeat('x', 512) || '...[TRUNCATED]' AS note,
  '[REDACTED]' AS nested_password, '{"e":"[DEPTH_LIMIT_EXCEEDED]"}' AS deep, CASE WHEN event_id % 2 = 0 THEN 21 ELSE 5 END AS items FROM events""")
def sanitized_metadata(spark, d):
    key = F.col("event_id").cast("string")
    flat = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("api_token"), F.col("props"), F.lit("key_id"), key, F.lit("note"), F.repeat(F.lit("x"), 600))
    items = F.to_json(F.sequence(F.lit(1), F.when(F.col("event_id") % 2 == 0, F.lit(25)).otherwise(F.lit(5))))
    nested = F.concat(F.lit('{"a": {"password": '), key, F.lit(', "b": {"c": {"d": {"e": 1}}}}, "list": '), items, F.lit("}"))
    rows = tables.table(spark, d, "events").select("event_id", audit.sanitize_map(flat).alias("m"), audit.sanitize_json(nested).alias("j"))
    return rows.select("event_id", "m.kind", "m.api_token", "m.key_id", "m.note", F.get_json_object("j", "$.a.password").alias("nested_password"),
                       F.get_json_object("j", "$.a.b.c.d").alias("deep"), F.size(F.from_json(F.get_json_object("j", "$.list"), "array<string>")).alias("items"))


@query("l7_retained_window", with_views("""
SELECT count(*) AS kept, min(event_id) AS oldest_kept, (SELECT count(*) FROM audit_rows) - count(*) AS dropped FROM (SELECT * FROM audit_rows ORDER BY event_id DESC LIMIT 500)""", "audit_rows"))
def retained_window(spark, d):
    return audit.retained(tables.audit_rows(spark, d), 500)


@query("w12_newest_events", with_views("SELECT event_id, actor, action FROM audit_rows ORDER BY event_id DESC LIMIT 100", "audit_rows"))
def newest_events(spark, d):
    return audit.newest(tables.audit_rows(spark, d), 100).select("event_id", "actor", "action")


@query("w7_sequential_ids", """
SELECT doc_id, 'EVD-' || CASE WHEN n >= 1000 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END AS evidence_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)""")
def sequential_ids(spark, d):
    documents = tables.table(spark, d, "documents").select("doc_id")
    return audit.sequential_ids(documents, [F.col("doc_id")])


@query("l8_emitted_events", with_views("""
SELECT 'ADVERSE_MEDIA_AGENT_RUN' AS action, count(*) AS events FROM findings UNION ALL SELECT 'PROMPT_INJECTION_DETECTED', count(*) FROM findings WHERE categories <> ''
UNION ALL SELECT 'ENTITY_MATCH_CALCULATED', count(*) FROM matches""", "findings", "matches"))
def emitted_events(spark, d):
    events = audit.screening_events(with_evidence_ids(_matches(spark, d))).unionByName(audit.media_events(findings(spark, d)))
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("events"))


# --- streams ----------------------------------------------------------------------------------

@query("m1_windowed_statistics", """
SELECT o_custkey AS client_id, strftime(w, '%Y-%m-%d') AS window_start, count(*) AS transaction_count, round(sum(o_totalprice), 2) AS total_amount, max(o_totalprice) AS max_amount
FROM (SELECT *, time_bucket(INTERVAL 7 DAYS, o_orderdate, TIMESTAMP '1970-01-01') AS w FROM orders)
WHERE w + INTERVAL 7 DAYS <= (SELECT max(o_orderdate) - INTERVAL 1 DAY FROM orders) GROUP BY o_custkey, w""")
def windowed_statistics(spark, d):
    orders = monitors.file_stream(spark, d, "orders.parquet", tables.table(spark, d, "orders").schema).select(
        F.col("o_custkey").alias("client_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    closed = monitors.run_to_table(monitors.windowed_statistics(orders), "windowed")
    return closed.select("client_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "transaction_count",
                         F.round("total_amount", 2).alias("total_amount"), "max_amount")


@query("m2_screened_stream", with_views("""
SELECT m.entity_id, row_id AS matched_against, match_score, m.rank FROM matches m WHERE rank <= 5""", "matches"))
def screened_stream(spark, d):
    """Customers arrive as a stream of names and attributes and are screened batch by batch, against a list prepared once."""
    whole = tables.screen_queries(spark, d)
    landing = scratch_path(spark, "arrivals")
    whole.write.parquet(landing)
    path = scratch_path(spark, "screened")
    stream = spark.readStream.schema(whole.schema).parquet(landing)
    monitors.run_batches(stream, monitors.screening_sink(tables.watchlist(spark, d), path, 5), "screened")
    return spark.read.parquet(path).select("entity_id", "matched_against", "match_score", "rank")


@query("m3_guarded_articles", with_views(f"SELECT article_id, categories, {IDENTIFIER_KINDS} AS identifier_kinds, md5({REDACTED}) AS digest FROM flagged", "flagged"))
def guarded_articles(spark, d):
    documents = monitors.file_stream(spark, d, "documents.parquet", tables.table(spark, d, "documents").schema)
    guarded = monitors.run_to_table(monitors.guarded_articles(tables.as_articles(documents)), "guarded")
    return guarded.select("article_id", "categories", "identifier_kinds", F.md5("redacted").alias("digest"))


@query("m4_chained_stream", with_views("SELECT chain_id, seq, event_id, previous_hash, hash FROM chained", "chained"))
def chained_stream(spark, d):
    events = monitors.file_stream(spark, d, "events.parquet", tables.table(spark, d, "events").schema)
    path = scratch_path(spark, "chained")
    monitors.run_batches(tables.as_audit_rows(events), monitors.chain_sink(path), "chained")
    return spark.read.schema(monitors.CHAIN_SCHEMA).parquet(f"{path}/rows").select("chain_id", "seq", "event_id", "previous_hash", "hash")
