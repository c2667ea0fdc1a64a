"""Queries over raw customer rows and list files: loading, validation, quality, privacy."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions import privacy
from probita.functions import scalars as S
from probita.operators import quality
from probita.plans.catalog import query
from probita.plans.views_sql import VIEWS, he, with_views
from probita.session import scratch_path
from probita.sources import loaders, sinks, tables

DEMO_KEY = "pseudonym-key-for-checks"

VIEWS["normalized"] = (["raw_kyc"], """
SELECT row_number, trim(client_id) AS client_id, trim(regexp_replace(client_name, '\\s+', ' ', 'g')) AS client_name,
  trim(client_type) AS client_type, upper(trim(country)) AS country, trim(sector) AS sector,
  CASE lower(trim(sector_risk)) WHEN 'low' THEN 'low' WHEN 'medium' THEN 'medium' WHEN 'med' THEN 'medium' WHEN 'high' THEN 'high' END AS sector_risk,
  CASE WHEN lower(trim(pep_flag)) IN ('true','1','yes','y','t') THEN true WHEN lower(trim(pep_flag)) IN ('false','0','no','n','f') THEN false END AS pep_flag,
  CASE WHEN lower(trim(sanctions_flag)) IN ('true','1','yes','y','t') THEN true WHEN lower(trim(sanctions_flag)) IN ('false','0','no','n','f') THEN false END AS sanctions_flag,
  CASE WHEN lower(trim(fatf_country_flag)) IN ('true','1','yes','y','t') THEN true WHEN lower(trim(fatf_country_flag)) IN ('false','0','no','n','f') THEN false END AS fatf_country_flag
FROM raw_kyc""")
_required = "\n".join(
    f"""UNION ALL SELECT row_number, client_id, {2 * at}, '{f}', 'missing_required_field', '{f} is blank/missing' FROM normalized WHERE {f} = ''
UNION ALL SELECT row_number, client_id, {2 * at + 1}, '{f}', 'value_too_long', '{f} length ' || length({f}) || ' exceeds max {V.KYC_MAX_LENGTH[f]}' FROM normalized WHERE length({f}) > {V.KYC_MAX_LENGTH[f]}"""
    for at, f in enumerate(V.KYC_REQUIRED))
_flags = "\n".join(
    f"UNION ALL SELECT row_number, client_id, {20 + at}, '{f}', 'invalid_boolean', '{f}: unrecognized boolean value' FROM normalized WHERE {f} IS NULL"
    for at, f in enumerate(V.KYC_FLAGS))
VIEWS["own_issues"] = (["normalized"], f"""
SELECT row_number, client_id, 30 AS place, 'sector_risk' AS field, 'invalid_sector_risk' AS issue_code, 'unrecognized sector_risk category' AS message FROM normalized WHERE sector_risk IS NULL
{_required}
{_flags}""")
VIEWS["issue_rows"] = (["own_issues"], """
SELECT * FROM own_issues
UNION ALL SELECT row_number, client_id, 40, 'client_id', 'duplicate_client_id', 'client_id occurs ' || n || ' times' FROM (
  SELECT *, count(*) OVER (PARTITION BY client_id) AS n FROM normalized) WHERE client_id <> '' AND n > 1""")
VIEWS["records"] = (["clients"], """
SELECT *, CASE client_id % 4 WHEN 0 THEN [client_name || ' Trading', 'The ' || client_name] ELSE []::VARCHAR[] END AS aliases,
  CASE WHEN client_id % 3 = 0 THEN 'AE' ELSE country END AS code, client_id % 7 = 0 AS late, client_id % 13 = 0 AS doubled FROM clients""")


def raw(spark, d):
    return tables.raw_kyc(spark, d)


def records(spark, d):
    """Canonical records with aliases and timestamps, from the client view."""
    key = F.col("client_id")
    created = F.timestamp_seconds(F.lit(1704067200) + key % 100 * 86400)
    return tables.clients(spark, d).select(
        key, "client_name", "client_type", F.when(key % 3 == 0, "AE").otherwise(F.col("country")).alias("country"), "sector", "sector_risk",
        *[(F.col(c) == 1).alias(c) for c in V.KYC_FLAGS],
        F.when(key % 4 == 0, F.array(F.concat("client_name", F.lit(" Trading")), F.concat(F.lit("The "), "client_name")))
        .otherwise(F.array().cast("array<string>")).alias("aliases"),
        created.alias("created_at"), F.when(key % 7 == 0, created - F.expr("INTERVAL 1 DAY")).otherwise(created).alias("updated_at"),
        (key % 13 == 0).alias("known_duplicate"))


@query("s1_read_rows", with_views("""
SELECT count(*) AS n, count(DISTINCT client_id) AS ids, sum(length(client_name))::BIGINT AS letters, sum((sector = '')::INT)::BIGINT AS blank_sectors FROM raw_kyc""", "raw_kyc"))
def read_rows(spark, d):
    path = scratch_path(spark, "kyc-csv")
    raw(spark, d).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = loaders.read_text_csv(spark, path)
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("client_id").alias("ids"), F.sum(F.length("client_name")).alias("letters"),
                  F.count_if(F.col("sector") == "").alias("blank_sectors"))


def _landed(spark, d):
    """Customer rows as CSV files, a folder for each of four headers: the usual one, reversed with a column more, without a required one, with an extra one."""
    path = scratch_path(spark, "kyc-folder")
    rows = raw(spark, d).withColumn("ofac_country_flag", F.lit("0"))
    for at, columns in enumerate([V.KYC_COLUMNS, [*reversed(V.KYC_COLUMNS), "row_number"], [c for c in V.KYC_COLUMNS if c != "sector"], [*V.KYC_COLUMNS, "ofac_country_flag"]]):
        some = rows.where(F.col("row_number") % 4 == at).select(*columns)
        some.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/layout={at}")
    return path


def _layout(path: str):
    return F.regexp_extract(path, "layout=([0-9]+)", 1).cast("int").alias("layout")


@query("s2_mixed_folder", with_views("""
SELECT row_number % 4 AS layout, client_id, client_name, sector, sector_risk, CASE WHEN row_number % 4 = 1 THEN row_number::VARCHAR END AS row_number,
  CASE WHEN row_number % 4 = 3 THEN '0' END AS ofac_country_flag FROM raw_kyc WHERE row_number % 4 <> 2""", "raw_kyc"))
def mixed_folder(spark, d):
    rows, _ = loaders.read_mixed_folder(spark, _landed(spark, d), deep=True)
    return rows.select(_layout("source_file"), "client_id", "client_name", "sector", "sector_risk", "row_number", "ofac_country_flag")


@query("p20_header_checks", with_views("""
SELECT layout, missing, additional, missing_extra, status, n FROM (VALUES
  (0, '', '', 'ofac_country_flag,sectoral_sanctions_flag,ownership_opacity_score', 'admissible'), (1, '', 'row_number', 'ofac_country_flag,sectoral_sanctions_flag,ownership_opacity_score', 'admissible'),
  (2, 'sector', '', 'ofac_country_flag,sectoral_sanctions_flag,ownership_opacity_score', 'missing_columns'), (3, '', 'ofac_country_flag', 'sectoral_sanctions_flag,ownership_opacity_score', 'admissible')
) v(layout, missing, additional, missing_extra, status) JOIN (SELECT row_number % 4 AS k, count(*) AS n FROM raw_kyc GROUP BY k) ON k = layout""", "raw_kyc"))
def header_checks(spark, d):
    """Header findings of each folder's files, with the records below the headers."""
    path = _landed(spark, d)
    checked = loaders.check_headers(loaders.check_files(loaders.list_files(spark, path, deep=True, header=True)))
    lines = spark.read.text(path, pathGlobFilter="*.csv").groupBy(_layout("_metadata.file_path")).agg(F.count("*").alias("lines"))
    texts = [F.array_join(c, ",").alias(c) for c in ("missing", "additional", "missing_extra")]
    found = checked.select(_layout("path"), *texts, "status").groupBy("layout", "missing", "additional", "missing_extra", "status").agg(F.count("*").alias("files"))
    return found.join(lines, "layout").select("layout", "missing", "additional", "missing_extra", "status", (F.col("lines") - F.col("files")).alias("n"))


@query("q5_admissible_files", """
SELECT file, CASE WHEN file % 5 = 4 THEN digits ELSE letters END AS length,
  CASE WHEN file % 5 = 4 THEN 'unsupported_type' WHEN letters > 65536 THEN 'file_too_large' ELSE 'admissible' END AS status
FROM (SELECT doc_id // 20 AS file, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS letters, sum(length(doc_id::VARCHAR) + 12)::BIGINT AS digits FROM documents GROUP BY file)
UNION ALL SELECT -1, 0, 'empty_file'""")
def admissible_files(spark, d):
    """Files of twenty documents each, every fifth of another kind, and an empty one: which may be read by kind and size."""
    path = scratch_path(spark, "landing")
    docs = tables.table(spark, d, "documents").withColumn("file", F.floor(F.col("doc_id") / 20))
    docs.where("file % 5 <> 4").select("file", "text").repartition("file").write.partitionBy("file").text(f"{path}/texts")
    docs.where("file % 5 = 4").select("file", "doc_id").repartition("file").write.partitionBy("file").json(f"{path}/numbers")
    docs.where("false").select("text").coalesce(1).write.text(f"{path}/texts/file=-1")
    checked = loaders.check_files(loaders.list_files(spark, path, deep=True), max_mb=0.0625, kinds=("txt",))
    return checked.select(F.regexp_extract("path", "file=(-?[0-9]+)", 1).cast("long").alias("file"), "length", "status")


@query("s10_ownership_files", """
SELECT 'P-' || p_partkey AS entity_id, p_name AS name, 'maker of ' || p_name AS context, p_type AS nationality, 'P-' || (p_partkey // 100 * 100) AS owner_id, 50.0::DOUBLE AS percentage FROM part""")
def ownership_files(spark, d):
    """Structures of a hundred parts, a JSON file each, written and read back."""
    path = scratch_path(spark, "ownership")
    key, first = F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 100) * 100
    entity = F.struct(F.concat(F.lit("P-"), key).alias("entity_id"), F.col("p_name").alias("name"), F.concat(F.lit("maker of "), "p_name").alias("context"), F.col("p_type").alias("nationality"))
    edge = F.struct(F.concat(F.lit("P-"), first.cast("string")).alias("owner_id"), F.concat(F.lit("P-"), key).alias("owned_id"), F.lit(50.0).alias("percentage"))
    bodies = tables.table(spark, d, "part").groupBy(first.alias("file")).agg(F.collect_list(entity).alias("entities"), F.collect_list(edge).alias("ownership_edges"))
    bodies.select("file", F.to_json(F.struct("entities", "ownership_edges")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    nodes, edges = loaders.load_ownership(spark, path)
    return nodes.join(edges.drop("structure"), nodes.entity_id == edges.owned_id, "left").select(
        "entity_id", "name", "context", F.col("metadata")["nationality"].alias("nationality"), "owner_id", "percentage")


@query("s11_article_files", """
SELECT md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id) || chr(10)) AS digest, sum(length(text))::BIGINT + 2 * count(*) - 1 AS letters FROM documents GROUP BY doc_id // 20""")
def article_files(spark, d):
    """Text files of twenty articles each, written and read back whole."""
    path = scratch_path(spark, "articles")
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    files = tables.table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("file")).agg(ordered.alias("a"))
    files.select("file", F.array_join(F.transform("a", lambda x: x["text"]), "\n\n").alias("value")).repartition("file").write.partitionBy("file").text(path)
    return loaders.load_articles(spark, path).select(F.md5("content").alias("digest"), F.length("content").cast("long").alias("letters"))


@query("s12_regulation_file", with_views("""
SELECT article_id, article_title, md5(trim(article_text, chr(9) || chr(10) || chr(13) || ' ')) AS digest, article_recitals FROM regulation""", "regulation"))
def regulation_file(spark, d):
    """The regulation as CSV, with line breaks inside its fields, written and read back."""
    path = scratch_path(spark, "regulation")
    tables.regulation(spark, d).drop("position").write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return loaders.load_regulation(spark, path).select("article_id", "article_title", F.md5("article_text").alias("digest"), "article_recitals")


@query("s3_client_book", with_views("""
SELECT 'CLIENT-' || client_id AS entity_id, client_name AS name, client_type, sector, sector_risk, country, country AS nationality, client_name AS company,
  client_type || ' in ' || sector || ' sector, based in ' || country AS context, pep_flag, sanctions_flag, fatf_country_flag, ofac_country_flag,
  sectoral_sanctions_flag, ownership_opacity_score FROM clients""", "clients"))
def client_book(spark, d):
    return loaders.shape_clients(tables.client_texts(spark, d))


@query("s4_flagged_transactions", with_views("""
SELECT transaction_id::VARCHAR AS transaction_id, 'CLIENT-' || client_id AS client_id, amount, ofac_match_flag, fatf_country_flag, structuring_pattern_flag,
  rapid_movement_flag, trade_mispricing_flag FROM transactions""", "transactions"))
def flagged_transactions(spark, d):
    df = tables.transactions(spark, d)
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return loaders.shape_transactions(texts).drop("timestamp", "transaction_type")


@query("s5_transfers", with_views('SELECT "Date", "Time", "Sender_account", "Receiver_account", "Amount", "Is_laundering" FROM bank_transfers', "bank_transfers"))
def transfers(spark, d):
    df = tables.bank_transfers(spark, d)
    return loaders.shape_transfers(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])).drop("position")


@query("s6_account_mapping", with_views("SELECT DISTINCT client_id, account FROM account_mapping", "account_mapping"))
def account_mapping(spark, d):
    df = tables.account_mapping(spark, d)
    return loaders.shape_mapping(df.select(F.col("client_id").cast("string").alias("client_id"), F.concat(F.lit(" "), "account").alias("account")))


# --- list files, written from part and supplier as the publisher writes them ------------------

def sdn_rows(spark, d):
    key = F.col("p_partkey")
    remarks = F.concat(
        F.when(key % 3 == 0, F.concat(F.lit("DOB 15 Mar "), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit("; "))).otherwise(F.lit("")),
        F.when(key % 2 == 0, F.concat(F.lit("nationality "), F.initcap("p_type"), F.lit("; "))).otherwise(F.lit("")),
        F.when(key % 5 == 0, F.concat(F.lit("a.k.a. '"), F.upper("p_name"), F.lit("'; a.k.a. 'X "), F.col("p_brand"), F.lit("'"))).otherwise(F.lit("")))
    name = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    fixed = {c: F.lit("-0-") for c in V.SDN_COLUMNS}
    fixed.update({
        "ent_num": key.cast("string"), "SDN_Name": F.when(key % 97 == 1, F.lit("-0-")).when(key % 4 == 0, F.col("p_name")).otherwise(name),
        "SDN_Type": F.when(key % 2 == 0, F.lit("individual")).otherwise(F.lit("-0-")), "Program": F.when(key % 6 == 0, F.lit("-0-")).otherwise(F.col("p_brand")),
        "Title": F.when(key % 7 == 0, F.lit("Director")).otherwise(F.lit("-0-")), "Remarks": F.when(remarks == "", F.lit("-0- ")).otherwise(remarks)})
    return tables.table(spark, d, "part").select(*[v.alias(k) for k, v in fixed.items()])


def alt_rows(spark, d):
    key = F.col("p_partkey")
    parts = tables.table(spark, d, "part").where("p_partkey % 3 <> 1")
    names = F.array(F.upper("p_name"), F.concat(F.lit("M. "), F.col("p_brand")))
    return parts.select(key.cast("string").alias("ent_num"), F.posexplode(names).alias("at", "alt_name")).select(
        "ent_num", (F.col("at") + 1).cast("string").alias("alt_num"), F.lit("a.k.a.").alias("alt_type"), "alt_name", F.lit("").alias("alt_remarks"))


VIEWS["sdn"] = ([], """
SELECT p_partkey::VARCHAR AS ent_num,
  CASE WHEN p_partkey % 97 = 1 THEN NULL WHEN p_partkey % 4 = 0 THEN p_name ELSE split_part(p_name,' ',1) || ' ' || upper(split_part(p_name,' ',2)) END AS name,
  CASE WHEN p_partkey % 2 = 0 THEN 'individual' ELSE 'entity' END AS entity_type, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS program,
  CASE WHEN p_partkey % 7 = 0 THEN 'Director' ELSE '' END AS title,
  CASE WHEN p_partkey % 3 = 0 THEN '15 Mar ' || (1950 + p_size) END AS dob,
  CASE WHEN p_partkey % 2 = 0 THEN upper(p_type[1]) || lower(p_type[2:]) END AS nationality,
  CASE WHEN p_partkey % 5 = 0 THEN [upper(p_name), 'X ' || p_brand] ELSE [] END AS inline_aliases,
  CASE WHEN p_partkey % 3 <> 1 THEN [upper(p_name), 'M. ' || p_brand] ELSE [] END AS alt_aliases,
  trim(CASE WHEN p_partkey % 3 = 0 THEN 'DOB 15 Mar ' || (1950 + p_size) || '; ' ELSE '' END
    || CASE WHEN p_partkey % 2 = 0 THEN 'nationality ' || upper(p_type[1]) || lower(p_type[2:]) || '; ' ELSE '' END
    || CASE WHEN p_partkey % 5 = 0 THEN 'a.k.a. ''' || upper(p_name) || '''; a.k.a. ''X ' || p_brand || '''' ELSE '' END) AS remarks
FROM part""")


@query("s7_sanctions_list", with_views("""
SELECT 'OFAC_SDN_' || CASE WHEN length(ent_num) >= 6 THEN ent_num ELSE lpad(ent_num, 6, '0') END AS entity_id, name,
  array_to_string(alt_aliases || list_filter(inline_aliases, lambda a: NOT list_contains(alt_aliases, a)), '|') AS aliases,
  dob, nationality, entity_type, coalesce(program, '') AS topics, 'OFAC SDN' AS source_list,
  nullif(trim(title || ' ' || remarks), '') AS context
FROM sdn WHERE name IS NOT NULL""", "sdn"))
def sanctions_list(spark, d):
    return loaders.shape_sdn(sdn_rows(spark, d), alt_rows(spark, d)).select(
        "entity_id", "name", F.array_join("aliases", "|").alias("aliases"), "dob", "nationality", "entity_type",
        F.array_join("topics", "|").alias("topics"), "source_list", "context")


@query("j1_alias_join", with_views("""
SELECT ent_num, len(alt_aliases) AS n, array_to_string(alt_aliases, '|') AS aliases FROM sdn WHERE name IS NOT NULL""", "sdn"))
def alias_join(spark, d):
    names = sdn_rows(spark, d).select(S.clean_marker("ent_num").alias("ent_num"), S.clean_marker("SDN_Name").alias("n")).where("n is not null")
    joined = names.join(loaders.alias_lists(alt_rows(spark, d)), "ent_num", "left")
    listed = F.coalesce("alt_aliases", F.array().cast("array<string>"))
    return joined.select("ent_num", F.size(listed).cast("long").alias("n"), F.array_join(listed, "|").alias("aliases"))


@query("p4_merged_aliases", with_views("""
SELECT ent_num, array_to_string(alt_aliases || list_filter(inline_aliases, lambda a: NOT list_contains(alt_aliases, a)), '|') AS aliases FROM sdn""", "sdn"))
def merged_aliases(spark, d):
    joined = sdn_rows(spark, d).join(loaders.alias_lists(alt_rows(spark, d)), "ent_num", "left")
    return joined.select("ent_num", F.array_join(loaders.merge_aliases(F.col("alt_aliases"), S.remarks_aliases("Remarks")), "|").alias("aliases"))


@query("s8_light_list", with_views("""
SELECT 'OFAC_SDN' AS source, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE upper(split_part(p_name,' ',2)) || ', ' || split_part(p_name,' ',1) END AS name,
  CASE WHEN starts_with(remarks, 'a.k.a.') THEN remarks ELSE '' END AS aliases, coalesce(program, '') AS country, remarks AS info
FROM sdn JOIN part ON p_partkey::VARCHAR = ent_num WHERE name IS NOT NULL""", "sdn"))
def light_list(spark, d):
    return loaders.light_sdn(sdn_rows(spark, d))


def open_rows(spark, d):
    key = F.col("p_partkey")
    return tables.table(spark, d, "part").select(
        F.when(key % 89 == 3, F.lit(" ")).otherwise(F.concat(F.lit("Q"), key.cast("string"))).alias("id"),
        F.element_at(F.array(*[F.lit(s) for s in ["Person", "Company", "Vessel", "Organization", "CryptoWallet"]]), (key % 5 + 1).cast("int")).alias("schema"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("name"),
        F.concat(F.upper("p_name"), F.lit("; ;"), F.col("p_brand"), F.lit(";")).alias("aliases"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.lit("1975-03-15")).alias("birth_date"),
        F.when(key % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" ae;"), F.lower("p_type"))).alias("countries"),
        F.concat(F.lit("list "), F.col("p_brand"), F.lit("; other")).alias("sanctions"),
        F.when(key % 2 == 0, F.lit("us_ofac_sdn")).otherwise(F.lit("")).alias("dataset"))


_open_where = "p_partkey % 89 <> 3 AND p_partkey % 5 IN (0, 1, 3)"


@query("s9_open_list", f"""
SELECT 'Q' || p_partkey AS entity_id, p_name AS name, upper(p_name) || '|' || p_brand AS aliases, CASE WHEN p_partkey % 3 <> 0 THEN '1975-03-15' END AS dob,
  CASE WHEN p_partkey % 4 <> 0 THEN 'AE' END AS nationality, CASE WHEN p_partkey % 5 = 0 THEN 'individual' ELSE 'entity' END AS entity_type,
  'list ' || p_brand || '|other' AS topics, CASE WHEN p_partkey % 2 = 0 THEN 'us_ofac_sdn' ELSE 'opensanctions' END AS source_list
FROM part WHERE {_open_where}""")
def open_list(spark, d):
    return loaders.shape_open_list(open_rows(spark, d)).select(
        "entity_id", "name", F.array_join("aliases", "|").alias("aliases"), "dob", "nationality", "entity_type",
        F.array_join("topics", "|").alias("topics"), "source_list")


@query("s9_light_open_list", """
SELECT 'OpenSanctions' AS source, p_name AS name, upper(p_name) || '; ;' || p_brand || ';' AS aliases, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'ae;' || lower(p_type) END AS country,
  'list ' || p_brand || '; other' AS info FROM part""")
def light_open_list(spark, d):
    return loaders.light_open_list(open_rows(spark, d))


@query("s18_combined_lists", with_views(f"""
SELECT 'ofac_sdn' AS list, true AS real_data, count(*) AS entities, false AS truncated, 0 AS marked FROM sdn WHERE name IS NOT NULL
UNION ALL SELECT 'opensanctions', true, count(*), false, 0 FROM part WHERE {_open_where}
UNION ALL SELECT 'demo_fixtures', false, count(*), false, count(*) FROM part""", "sdn"))
def combined_lists(spark, d):
    fixtures = tables.watchlist(spark, d).withColumns({"topics": F.array(F.lit("demo")), "source_url": F.lit(None).cast("string")})
    combined = loaders.combine_lists(
        {"ofac_sdn": loaders.shape_sdn(sdn_rows(spark, d), alt_rows(spark, d)), "opensanctions": loaders.shape_open_list(open_rows(spark, d))},
        fixtures.select(*loaders.WATCHLIST_COLUMNS))
    marked = combined.groupBy("list").agg(F.count_if(F.col("source_list").endswith(V.FIXTURE_SUFFIX)).alias("marked"))
    return loaders.list_statistics(combined).join(marked, "list")


# --- payloads, sinks --------------------------------------------------------------------------

def payload_rows(spark, d):
    """Landed payloads from orders: an object with a data field, and some of other shapes."""
    key = F.col("o_orderkey")
    record = F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("status"), (key % 2 == 0).alias("pep"),
                                F.when(key % 3 == 0, F.col("o_orderpriority")).alias("note")))
    body = F.when(key % 10 == 7, F.lit('{"other": []}')).when(key % 10 == 8, F.concat(F.lit('{"data": [1,'), record, F.lit("]}"))).when(
        key % 10 == 9, F.lit("not json")).otherwise(F.concat(F.lit('{"data": ['), record, F.lit(","), record, F.lit("]}")))
    return tables.table(spark, d, "orders").select(key.alias("payload_id"), body.alias("payload"))


@query("s13_extract_records", """
SELECT o_orderkey AS payload_id, CASE WHEN o_orderkey % 10 < 7 THEN 2 ELSE 0 END AS records,
  CASE WHEN o_orderkey % 10 >= 7 THEN 'invalid_payload_shape' END AS error_code FROM orders""")
def extract_records(spark, d):
    records, rejected = loaders.extract_records(payload_rows(spark, d), "data")
    counts = records.groupBy("payload_id").agg(F.count(F.lit(1)).cast("int").alias("records"))
    return counts.select("payload_id", "records", F.lit(None).cast("string").alias("error_code")).unionByName(
        rejected.select("payload_id", F.lit(0).alias("records"), "error_code"))


@query("p19_map_records", """
SELECT o_orderkey AS payload_id, p.position, o_orderkey::VARCHAR AS client_id, o_orderstatus AS client_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS pep_flag, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS sector
FROM orders, (VALUES (0), (1)) p(position) WHERE o_orderkey % 10 < 7""")
def map_records(spark, d):
    records, _ = loaders.extract_records(payload_rows(spark, d), "data")
    return loaders.map_records(records, {"id": "client_id", "status": "client_type", "pep": "pep_flag", "note": "sector"})


@query("s14_json_lines", with_views("""
SELECT client_id, client_name, country, sector_risk, pep_flag FROM normalized
WHERE row_number NOT IN (SELECT row_number FROM issue_rows)""", "normalized", "issue_rows"))
def json_lines(spark, d):
    from probita.session import scratch_path
    path = scratch_path(spark, "entities-json")
    clean = quality.entities(quality.validate_batch(raw(spark, d)))
    sinks.write_json_lines(clean, path)
    return spark.read.schema(clean.schema).json(path).select("client_id", "client_name", "country", "sector_risk", "pep_flag")


def sealed(spark, d):
    key = F.lit(bytearray(hashlib.sha256(DEMO_KEY.encode()).digest()))
    df = tables.clients(spark, d).select("client_id", "client_name", "country", "sector")
    return sinks.seal(df, key, "demo", "normalized_kyc_entities", ["client_id"]), key


@query("s15_sealed_export", """SELECT c_custkey AS client_id, c_name AS client_name, 'AES-256-GCM' AS algorithm FROM customer""")
def sealed_export(spark, d):
    df, key = sealed(spark, d)
    body = sinks.unseal(df, key, "normalized_kyc_entities")
    return df.select("client_id", F.get_json_object(body, "$.client_name").alias("client_name"), "algorithm")


@query("s16_check_seals", "SELECT count(*) AS sealed_rows, count(*) AS opened, 0::BIGINT AS opened_after_change FROM customer")
def check_seals(spark, d):
    df, key = sealed(spark, d)
    return sinks.check_seals(df, key, "normalized_kyc_entities")


@query("s17_append_log", with_views("""
SELECT count(*) AS events, count(DISTINCT event_id) AS ids, min(event_id) AS first_id, max(event_id) AS last_id FROM audit_rows""", "audit_rows"))
def append_log(spark, d):
    """Two overlapping appends: an id already in the log is ignored."""
    from probita.session import scratch_path
    path = scratch_path(spark, "audit-log")
    rows = tables.audit_rows(spark, d)
    half = F.xxhash64("event_id") % 2 == 0
    sinks.append_events(spark, rows.where(half), path)
    sinks.append_events(spark, rows, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"),
                                        F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# --- scalar normalisers -----------------------------------------------------------------------

@query("p1_clean_marker", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS cleaned FROM part")
def clean_marker(spark, d):
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("\t "), F.col("p_name"), F.lit(" "))).when(key % 3 == 1, F.lit(" -0- ")).otherwise(F.lit("  "))
    return tables.table(spark, d, "part").select(key, S.clean_marker(text).alias("cleaned"))


@query("p2_parse_remarks", with_views("SELECT ent_num, dob, nationality, array_to_string(inline_aliases, '|') AS aliases FROM sdn", "sdn"))
def parse_remarks(spark, d):
    return sdn_rows(spark, d).select("ent_num", S.remarks_dob("Remarks").alias("dob"), S.remarks_nationality("Remarks").alias("nationality"),
                                     F.array_join(S.remarks_aliases("Remarks"), "|").alias("aliases"))


@query("p3_family_name_last", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name,' ',2) || ', Jr ' || split_part(p_name,' ',1) ELSE p_name END AS name FROM part""")
def family_name_last(spark, d):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Jr "), first, F.lit(" ,"), second, F.lit(", "))).otherwise(F.concat(F.lit(" "), "p_name"))
    # "Jr small ,ring, " becomes "ring, Jr small"
    return tables.table(spark, d, "part").select("p_partkey", S.family_name_last(text).alias("name"))


@query("p5_entity_ids", """
SELECT p_partkey, 'OFAC_SDN_' || CASE WHEN length((p_partkey * p_size * 97)::VARCHAR) >= 6 THEN (p_partkey * p_size * 97)::VARCHAR ELSE lpad((p_partkey * p_size * 97)::VARCHAR, 6, '0') END AS entity_id,
  'https://opensanctions.org/entities/Q' || p_partkey || '/' AS url FROM part""")
def entity_ids(spark, d):
    number = F.col("p_partkey") * F.col("p_size") * 97
    return tables.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("OFAC_SDN_"), S.pad_number(number, 6)).alias("entity_id"),
        loaders.entity_url(F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))).alias("url"))


@query("p6_multi_values", """
SELECT 'Q' || p_partkey AS id, upper(p_name) || '|' || p_brand AS aliases, CASE WHEN p_partkey % 4 <> 0 THEN 'AE' END AS nationality FROM part WHERE p_partkey % 89 <> 3""")
def multi_values(spark, d):
    return open_rows(spark, d).where("id <> ' '").select(
        "id", F.array_join(S.split_multi("aliases"), "|").alias("aliases"), S.first_country("countries").alias("nationality"))


@query("p7_collapse_blanks", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def collapse_blanks(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", S.collapse_blanks("text").alias("text"))


@query("p8_strict_flags", with_views("SELECT row_number, pep_flag, sanctions_flag, fatf_country_flag FROM normalized", "normalized"))
def strict_flags(spark, d):
    return raw(spark, d).select("row_number", *[S.strict_bool(c).alias(c) for c in V.KYC_FLAGS])


@query("p9_sector_risk", with_views("SELECT row_number, sector_risk FROM normalized", "normalized"))
def sector_risk(spark, d):
    return raw(spark, d).select("row_number", S.sector_risk("sector_risk").alias("sector_risk"))


_flag_texts = ["1", "0.5", " 2.0 ", "NaN", "yes", "maybe", "-1", "TRUE", "", "1e3"]


@query("p10_lenient_flags", f"""
SELECT o_orderkey, [1,0,1,0,1,0,1,1,0,1][o_orderkey % 10 + 1] AS flag FROM orders""")
def lenient_flags(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t in _flag_texts]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return tables.table(spark, d, "orders").select("o_orderkey", S.lenient_flag(text).alias("flag"))


@query("p11_lenient_numbers", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS number, greatest(1000.0, least(200000.0, o_totalprice)) AS held,
  o_orderkey % 3 <> 0 AND o_totalprice <> 0 AS truth FROM orders""")
def lenient_numbers(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return tables.table(spark, d, "orders").select(
        "o_orderkey", S.number_or(text).alias("number"), S.clamp(F.col("o_totalprice"), 1000, 200000).alias("held"), S.truthy(text).alias("truth"))


_country_texts = [" uae ", "United Kingdom", "Korea, North", "ru", "Atlantis", "viet nam", ""]


@query("p12_country_codes", """
SELECT c_custkey, ['AE','GB','KP','RU','ATLANTIS','VN',NULL][c_custkey % 7 + 1] AS code FROM customer""")
def country_codes(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t in _country_texts]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return tables.table(spark, d, "customer").select("c_custkey", S.country_code(text).alias("code"))


_dates = "strftime(o_orderdate, '%Y-%m-%d')"


@query("p13_birth_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN year(o_orderdate)::INT END AS year,
  CASE WHEN o_orderkey % 5 < 3 THEN month(o_orderdate)::INT END AS month, CASE WHEN o_orderkey % 5 IN (0, 2) THEN day(o_orderdate)::INT END AS day FROM orders""")
def birth_dates(spark, d):
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 5 == 0, F.date_format(date, "yyyy-MM-dd")).when(key % 5 == 1, F.date_format(date, "yyyy/M"))
        .when(key % 5 == 2, F.date_format(date, " d MMMM yyyy")).when(key % 5 == 3, F.concat(F.lit("circa "), F.date_format(date, "yyyy"), F.lit(" or so")))
        .otherwise(F.lit("unknown")))
    return tables.table(spark, d, "orders").select("o_orderkey", S.birth_date(text).alias("b")).select("o_orderkey", "b.*")


@query("p24_dob_match", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN (month(o_orderdate) = 3)::INT::DOUBLE WHEN 2 THEN 0.5 ELSE 0.0 END AS score FROM orders""")
def dob_match(spark, d):
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    right = (F.when(key % 4 == 0, F.date_format(date, "yyyy")).when(key % 4 == 1, F.concat(F.lit("mar "), F.date_format(date, "yyyy")))
             .when(key % 4 == 2, F.lit("")).otherwise(F.lit("unstated")))
    return tables.table(spark, d, "orders").withColumns({"l": F.date_format(date, "yyyy-MM-dd"), "r": right}).select(
        "o_orderkey", S.dob_match("l", "r").alias("score"))


# --- validation and quality -------------------------------------------------------------------

@query("q1_row_issues", with_views("""
SELECT n.row_number, coalesce(string_agg(field || ':' || issue_code || ':' || message, '; ' ORDER BY place), '') AS issues
FROM normalized n LEFT JOIN own_issues i ON i.row_number = n.row_number GROUP BY n.row_number""", "normalized", "own_issues"))
def row_issues(spark, d):
    text = F.transform("issues", lambda i: F.concat_ws(":", i["field"], i["issue_code"], i["message"]))
    return quality.normalize_rows(raw(spark, d)).select("row_number", F.array_join(text, "; ").alias("issues"))


@query("q2_batch_entities", with_views("""
SELECT client_id, client_name, client_type, country, sector, sector_risk, pep_flag, sanctions_flag, fatf_country_flag FROM normalized
WHERE row_number NOT IN (SELECT row_number FROM issue_rows)""", "normalized", "issue_rows"))
def batch_entities(spark, d):
    return quality.entities(quality.validate_batch(raw(spark, d)))


@query("q3_issue_rows", with_views("""
SELECT row_number, field, issue_code, message,
  CASE WHEN client_id = '' THEN NULL WHEN length(client_id) <= 2 THEN repeat('*', length(client_id)) ELSE repeat('*', length(client_id) - 2) || right(client_id, 2) END AS client_ref
FROM issue_rows""", "issue_rows"))
def issue_rows(spark, d):
    return quality.issues(quality.validate_batch(raw(spark, d)))


@query("w3_duplicate_flags", with_views("""
SELECT row_number, client_id <> '' AND count(*) OVER (PARTITION BY client_id) > 1 AS is_duplicate FROM normalized""", "normalized"))
def duplicate_flags(spark, d):
    flagged = quality.validate_batch(raw(spark, d))
    return flagged.select("row_number", F.exists("issues", lambda i: i["issue_code"] == "duplicate_client_id").alias("is_duplicate"))


@query("a3_duplicate_ids", with_views("""
SELECT client_id, count(*) AS occurrences FROM normalized WHERE client_id <> '' GROUP BY client_id HAVING count(*) > 1""", "normalized"))
def duplicate_ids(spark, d):
    return quality.duplicate_ids(quality.normalize_rows(raw(spark, d)))


@query("a4_quality_report", with_views("""
SELECT 'total' AS section, 'total_rows' AS name, count(*) AS value FROM normalized
UNION ALL SELECT 'total', 'valid_rows', count(*) FROM normalized WHERE row_number NOT IN (SELECT row_number FROM issue_rows)
UNION ALL SELECT 'total', 'invalid_rows', count(DISTINCT row_number) FROM issue_rows
UNION ALL SELECT 'total', 'duplicate_client_ids', count(*) FROM (SELECT client_id FROM normalized WHERE client_id <> '' GROUP BY client_id HAVING count(*) > 1)
UNION ALL SELECT 'issue', issue_code, count(*) FROM issue_rows GROUP BY issue_code
UNION ALL SELECT 'missing', field, count(*) FROM issue_rows WHERE issue_code = 'missing_required_field' GROUP BY field""", "normalized", "issue_rows"))
def quality_report(spark, d):
    return quality.quality_report(quality.validate_batch(raw(spark, d)))


_profiled = ["client_id", "client_name", "client_type", "country", "sector", "sector_risk", "pep_flag", "sanctions_flag", "fatf_country_flag"]


@query("a5_profile_columns", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (trim({c}) = '') AS blank_values, "
    + (f"min(length(trim({c})))::INT AS min_length, max(length(trim({c})))::INT AS max_length" if c in ("client_id", "client_name") else "NULL::INT AS min_length, NULL::INT AS max_length")
    + " FROM raw_kyc" for c in _profiled), "raw_kyc"))
def profile_columns(spark, d):
    return quality.profile_columns(raw(spark, d), "client_id", ["client_id", "client_name"])


@query("a5_profile_ids", with_views("""
SELECT count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicate_ids FROM (SELECT client_id, count(*) AS n FROM normalized WHERE client_id <> '' GROUP BY client_id)""", "normalized"))
def profile_ids(spark, d):
    return quality.profile_ids(raw(spark, d))


_category_sql = " UNION ALL ".join(f"SELECT '{c}' AS column_name, trim({c}) AS value, count(*) AS n FROM raw_kyc GROUP BY ALL"
                                   for c in ["client_type", "country", "client_name", "sector_risk", "pep_flag"])


@query("a5_profile_categories", with_views(f"""
SELECT column_name, value, n, cardinality FROM (
  SELECT *, count(*) OVER (PARTITION BY column_name) AS cardinality, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn FROM ({_category_sql}))
WHERE cardinality <= 25 OR rn <= 5""", "raw_kyc"))
def profile_categories(spark, d):
    return quality.profile_categories(raw(spark, d), ["client_type", "country", "client_name", "sector_risk", "pep_flag"])


_quality_sql = """
SELECT client_id, greatest(0, 100 - CASE WHEN client_id % 3 <> 0 THEN 3 ELSE 0 END - CASE WHEN late THEN 10 ELSE 0 END - CASE WHEN doubled THEN 25 ELSE 0 END)::DOUBLE AS data_quality_score,
  (4 + (client_id % 4 = 0)::INT) / 5.0::DOUBLE AS completeness_ratio,
  array_to_string(list_filter([CASE WHEN client_id % 3 <> 0 THEN 'normalization_warning' END, CASE WHEN late THEN 'inconsistent_value' END, CASE WHEN doubled THEN 'duplicate_identifier' END], lambda x: x IS NOT NULL), ',') AS quality_issues
FROM records"""


@query("q4_record_quality", with_views(_quality_sql, "records"))
def record_quality(spark, d):
    return quality.record_quality(records(spark, d)).withColumn("quality_issues", F.array_join("quality_issues", ","))


@query("a6_batch_quality", with_views(f"""
SELECT count(*) AS total_entities, {he("avg(data_quality_score)", 2)} AS avg_data_quality_score, {he("round(avg(completeness_ratio), 8)", 4)} AS avg_completeness_ratio,
  count(*) FILTER (quality_issues <> '') AS records_with_issues FROM ({_quality_sql})""", "records"))
def batch_quality(spark, d):
    return quality.batch_quality(quality.record_quality(records(spark, d)))


@query("a6_issue_counts", with_views(f"""
SELECT issue_code, count(*) AS n FROM (SELECT unnest(string_split(quality_issues, ',')) AS issue_code FROM ({_quality_sql}) WHERE quality_issues <> '') GROUP BY issue_code""", "records"))
def issue_counts(spark, d):
    return quality.batch_issue_counts(quality.record_quality(records(spark, d)))


# --- privacy ----------------------------------------------------------------------------------

def _initials(name: str) -> str:
    return f"array_to_string(list_transform(string_split({name}, ' '), lambda w: substr(w, 1, 1) || repeat('*', length(w) - 1)), ' ')"


_org = "split_part({0}, ' ', 1) || ' ' || array_to_string(list_transform(string_split({0}, ' ')[2:], lambda w: substr(w, 1, 1) || repeat('*', length(w) - 1)), ' ')"


_classed = ["client_id", "client_name", "client_type", "country", "sector", "sector_risk", "pep_flag", "sanctions_flag", "fatf_country_flag", "ofac_country_flag"]


@query("v1_field_classes", with_views("""
SELECT column_name, CASE WHEN column_name IN ('pep_flag', 'sanctions_flag') THEN 'sensitive' WHEN column_name = 'client_name' THEN 'personal' WHEN column_name LIKE 'c\\_%' ESCAPE '\\' OR column_name = 'ofac_country_flag' THEN 'highly_sensitive' ELSE 'internal' END AS data_class,
  CASE WHEN column_name = 'client_id' THEN 'pseudonymize' WHEN column_name = 'client_name' THEN 'mask_name' WHEN column_name IN ('client_type', 'country', 'sector', 'sector_risk', 'fatf_country_flag') THEN 'none' ELSE 'redact' END AS mask, n FROM (
  SELECT 'c_custkey' AS column_name, count(c_custkey) AS n FROM customer UNION ALL SELECT 'c_name', count(c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey) FROM customer
  UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer
""" + "".join(f"  UNION ALL SELECT '{c}', count({c}) FROM clients\n" for c in _classed) + ")", "clients"))
def field_classes(spark, d):
    """Classes of the columns of two tables with the values they protect; of the first table's no column is listed, of the second's all but the last."""
    found = []
    for df in (tables.table(spark, d, "customer"), tables.clients(spark, d).select(*_classed)):
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        rows = [F.struct(F.lit(c).alias("column_name"), F.lit(privacy.field_class(c)[0]).alias("data_class"),
                         F.lit(privacy.field_class(c)[1]).alias("mask"), F.col(c).alias("n")) for c in df.columns]
        found.append(counts.select(F.inline(F.array(*rows))))
    return found[0].unionByName(found[1])


@query("v2_masked_identifiers", """
SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) <= 2 THEN repeat('*', length(c_custkey::VARCHAR)) ELSE repeat('*', length(c_custkey::VARCHAR) - 2) || right(c_custkey::VARCHAR, 2) END AS masked,
  CASE WHEN c_custkey % 5 = 0 THEN '***' WHEN length(c_custkey::VARCHAR) <= 2 THEN repeat('*', length(c_custkey::VARCHAR)) ELSE repeat('*', length(c_custkey::VARCHAR) - 2) || right(c_custkey::VARCHAR, 2) END AS reference FROM customer""")
def masked_identifiers(spark, d):
    key = F.col("c_custkey").cast("string")
    return tables.table(spark, d, "customer").select(
        "c_custkey", privacy.mask_identifier(key).alias("masked"),
        privacy.report_reference(F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), key))).alias("reference"))


@query("v3_masked_names", f"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_initials("p_name")} ELSE {_org.format("p_name")} END AS masked FROM part""")
def masked_names(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", privacy.mask_name("p_name", F.col("p_partkey") % 2 == 0).alias("masked"))


@query("v4_redacted", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '[REDACTED]' END AS redacted FROM documents")
def redacted(spark, d):
    return tables.table(spark, d, "documents").select(
        "doc_id", privacy.redact(F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("text"))).alias("redacted"))


_pads = {name: bytes(b ^ pad for b in DEMO_KEY.encode().ljust(64, b"\0")).hex() for name, pad in (("inner", 0x36), ("outer", 0x5C))}


def _pseudonym(text: str) -> str:
    inner = f"sha256(unhex('{_pads['inner']}') || encode({text}))"
    return f"'anon_' || substr(sha256(unhex('{_pads['outer']}') || unhex({inner})), 1, 16)"


@query("v5_pseudonyms", f"SELECT c_custkey, {_pseudonym('c_custkey::VARCHAR')} AS pseudonym FROM customer")
def pseudonyms(spark, d):
    return tables.table(spark, d, "customer").select("c_custkey", privacy.pseudonym("c_custkey", DEMO_KEY).alias("pseudonym"))


_masked_sql = f"CASE WHEN client_type = 'Individual' THEN {_initials('client_name')} ELSE {_org.format('client_name')} END"


@query("v6_minimized_for_review", with_views(f"""
SELECT {_pseudonym('client_id::VARCHAR')} AS client_id, CASE WHEN client_type = 'Individual' THEN {_initials("client_name")} ELSE client_name END AS client_name,
  client_type, code AS country, sector, sector_risk, pep_flag = 1 AS pep_flag, sanctions_flag = 1 AS sanctions_flag, fatf_country_flag = 1 AS fatf_country_flag,
  array_to_string(list_transform(aliases, lambda a: CASE WHEN client_type = 'Individual' THEN {_initials("a")} ELSE {_org.format("a")} END), '|') AS aliases
FROM records""", "records"))
def minimized_for_review(spark, d):
    seen = privacy.minimize(records(spark, d).drop("known_duplicate"), privacy.context_for({"read"}), DEMO_KEY)
    return seen.withColumn("aliases", F.array_join("aliases", "|")).drop("created_at", "updated_at")


@query("v6_minimized_outside", with_views(f"SELECT {_pseudonym('client_id::VARCHAR')} AS client_id, client_type FROM records", "records"))
def minimized_outside(spark, d):
    return privacy.minimize(records(spark, d), "external_response", DEMO_KEY)


@query("v7_context_by_right", with_views("""
SELECT client_id::VARCHAR AS client_id, client_name, pep_flag = 1 AS pep_flag FROM records""", "records"))
def context_by_right(spark, d):
    seen = privacy.minimize(records(spark, d), privacy.context_for({"read", "sensitive"}), DEMO_KEY)
    return seen.select(F.col("client_id").cast("string").alias("client_id"), "client_name", "pep_flag")
