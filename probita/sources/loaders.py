"""Readers of the input files, each split into a read and a shaping step.

The shaping steps take any DataFrame with the file's columns, so they serve tables, streams and
files alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probita import fixed_values as V
from probita.functions import scalars as S
from probita.sources.folders import list_files

NEVER = "\u0001"  # a null marker that occurs in no file, so that empty fields stay empty text


def _csv(spark: SparkSession, header: bool, multi_line: bool = False):
    return spark.read.options(header=header, inferSchema=False, mode="PERMISSIVE", multiLine=multi_line,
                              quote='"', escape='"', maxCharsPerColumn=-1, encoding="UTF-8",
                              nullValue=NEVER, emptyValue="")


def has_open_quotes(spark: SparkSession, path: str | list[str], pattern: str = "*") -> bool:
    """Whether a line of the files has an odd number of quotes, as where a quoted field holds a line break.

    One distributed pass over the lines. Quotes inside a field are doubled, so whole records have an even number; a
    single quote inside an unquoted field is counted too, which costs time but no row.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return not lines.where(odd).isEmpty()


def read_text_csv(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """A CSV file with every column as text; a leading byte-order mark goes, short rows fill with ''.

    ``multi_line`` says whether fields hold line breaks: True is a task a file, False lets large files be split between
    tasks (and cuts such fields in two), None looks the files through first (``has_open_quotes``).
    """
    if multi_line is None:
        multi_line = has_open_quotes(spark, path)
    df = _csv(spark, True, multi_line).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.na.fill("")


def read_kyc_folder(spark: SparkSession, folder: str, multi_line: bool | None = None) -> DataFrame:
    """All CSV files of a folder, with the file each row came from; ``multi_line`` as in ``read_text_csv``.

    Files whose columns come in another order than the first one's are an error, not misread.
    """
    if multi_line is None:
        multi_line = has_open_quotes(spark, folder, "*.csv")
    reader = _csv(spark, True, multi_line).options(pathGlobFilter="*.csv", enforceSchema=False)
    df = reader.csv(folder)
    return df.na.fill("").withColumn("source_file", F.col("_metadata.file_path"))


def check_files(files: DataFrame, max_mb: float = V.MAX_FILE_MB, kinds: tuple[str, ...] = ("csv",)) -> DataFrame:
    """Which listed files may be read, and why the others may not."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn(
        "status",
        F.when(~kind.isin(*kinds), "unsupported_type").when(F.col("length") == 0, "empty_file")
        .when(F.col("length") > int(max_mb * 1024 * 1024), "file_too_large").otherwise("admissible"))


def check_headers(files: DataFrame) -> DataFrame:
    """Checked files with the required columns they lack (``missing``), unknown ones (``additional``) and known extra ones they lack.

    Takes ``columns`` and ``status`` of every file. An admissible file that lacks a required column, or names one twice,
    gets that as its status; files without a header lack everything.
    """
    names = lambda values: F.array(*[F.lit(v) for v in values])
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    repeated = F.size(F.array_distinct(F.transform(columns, F.lower))) < F.size(columns)
    checked = files.withColumns({
        "missing": F.array_except(names(V.KYC_COLUMNS), columns), "additional": F.array_except(columns, names(V.KYC_COLUMNS)),
        "missing_extra": F.array_except(names(V.KYC_EXTRA_COLUMNS), columns)})
    return checked.withColumn("status", F.when(F.col("status") != "admissible", F.col("status")).when(F.size("missing") > 0, "missing_columns")
                              .when(repeated, "repeated_columns").otherwise(F.col("status")))


def read_mixed_folder(spark: SparkSession, folder: str, deep: bool = False, max_mb: float = V.MAX_FILE_MB, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of all admissible CSV files of a folder, whatever the order of their columns, and the listing of the files that are not read.

    Files of one header are read together and united with the others by column names, a column that a file lacks being
    NULL; ``source_file`` is the file of a row. What the driver holds is the paths by header, as a reader of files does
    in any case; there are as many reads as headers. Without admissible files there are no rows. ``multi_line`` as in
    ``read_text_csv``.
    """
    checked = check_headers(check_files(list_files(spark, folder, deep=deep, header=True), max_mb))
    layouts = checked.where("status = 'admissible'").groupBy("columns").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("columns").collect()
    rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in [*V.KYC_COLUMNS, "source_file"]))
    for layout in layouts:
        whole = has_open_quotes(spark, layout.paths) if multi_line is None else multi_line
        texts = T.StructType([T.StructField(c, T.StringType()) for c in layout["columns"]])
        df = _csv(spark, True, whole).schema(texts).csv(layout.paths).na.fill("")
        rows = rows.unionByName(df.withColumn("source_file", F.col("_metadata.file_path")), allowMissingColumns=True)
    return rows, checked.where("status <> 'admissible'")


def check_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """Additional and missing optional columns; raises where a required one is absent."""
    missing = [c for c in V.KYC_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"missing required source columns: {missing}")
    return [c for c in columns if c not in V.KYC_COLUMNS], [c for c in V.KYC_EXTRA_COLUMNS if c not in columns]


# --- clients and transactions ----------------------------------------------------------------

def shape_clients(raw: DataFrame) -> DataFrame:
    """Typed client book with the fields a screening query needs."""
    def text(name: str) -> Column:
        return S.strip(F.coalesce(F.col(name), F.lit("")))
    return raw.select(
        F.concat(F.lit("CLIENT-"), F.col("client_id")).alias("entity_id"),
        text("client_name").alias("name"), text("client_type").alias("client_type"), text("sector").alias("sector"),
        text("sector_risk").alias("sector_risk"), text("country").alias("country"), text("country").alias("nationality"),
        text("client_name").alias("company"),
        F.concat(F.col("client_type"), F.lit(" in "), F.col("sector"), F.lit(" sector, based in "), F.col("country")).alias("context"),
        *[F.col(c).cast("int").alias(c) for c in ("pep_flag", "sanctions_flag", "fatf_country_flag", "ofac_country_flag", "sectoral_sanctions_flag")],
        F.col("ownership_opacity_score").cast("double").alias("ownership_opacity_score"))


def load_clients(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return shape_clients(read_text_csv(spark, path, multi_line))


def shape_transactions(raw: DataFrame) -> DataFrame:
    texts = ["transaction_id", "transaction_type", "timestamp", "client_country", "counterparty_country"]
    flags = ["ofac_match_flag", "fatf_country_flag", "structuring_pattern_flag", "rapid_movement_flag", "trade_mispricing_flag"]
    return raw.select(
        *[S.strip(c).alias(c) for c in texts if c in raw.columns],
        F.concat(F.lit("CLIENT-"), S.strip("client_id")).alias("client_id"),
        F.col("amount").cast("double").alias("amount"), *[F.col(c).cast("int").alias(c) for c in flags])


def load_transactions(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return shape_transactions(read_text_csv(spark, path, multi_line))


def shape_transfers(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "Amount": F.col("Amount").cast("double"), "Is_laundering": F.col("Is_laundering").cast("int"),
        "Sender_account": S.strip("Sender_account"), "Receiver_account": S.strip("Receiver_account")})


def load_transfers(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return shape_transfers(read_text_csv(spark, path, multi_line))


def shape_mapping(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("client_id").cast("long").alias("client_id"), S.strip("account").alias("account")).distinct()


def load_mapping(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return shape_mapping(read_text_csv(spark, path, multi_line))


# --- watch-lists -----------------------------------------------------------------------------

WATCHLIST_COLUMNS = ["row_id", "entity_id", "name", "aliases", "dob", "nationality", "entity_type", "company",
                     "topics", "source_list", "source_url", "context"]


def _positional(spark: SparkSession, path: str, columns: list[str], multi_line: bool | None) -> DataFrame:
    if multi_line is None:
        multi_line = has_open_quotes(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = _csv(spark, False, multi_line).schema(schema).csv(path)
    return df.where(F.lower(S.strip(F.coalesce(columns[0], F.lit("")))) != columns[0].lower())


def read_sdn(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The main list file, with or without a header line."""
    return _positional(spark, path, V.SDN_COLUMNS, multi_line)


def read_alt(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return _positional(spark, path, V.ALT_COLUMNS, multi_line)


def alias_lists(alt: DataFrame) -> DataFrame:
    """Alias names per entity number, in the order of their numbers."""
    clean = alt.select(S.clean_marker("ent_num").alias("ent_num"), S.clean_marker("alt_name").alias("alt_name"),
                       F.expr("try_cast(alt_num as bigint)").alias("at"))
    rows = clean.where("ent_num is not null and alt_name is not null")
    return rows.groupBy("ent_num").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "alt_name"))), lambda r: r["alt_name"]).alias("alt_aliases"))


def merge_aliases(listed: Column, inline: Column) -> Column:
    """The alias file's names, then those of the remarks that it lacks."""
    listed = F.coalesce(listed, F.array().cast("array<string>"))
    return F.concat(listed, F.array_except(inline, listed))


def shape_sdn(sdn: DataFrame, alt: DataFrame | None = None) -> DataFrame:
    fields = ["ent_num", "SDN_Name", "SDN_Type", "Program", "Title", "Remarks"]
    rows = sdn.select(*[S.clean_marker(c).alias(c) for c in fields]).where("ent_num is not null and SDN_Name is not null")
    if alt is None:
        rows = rows.withColumn("alt_aliases", F.array().cast("array<string>"))
    else:
        rows = rows.join(alias_lists(alt), "ent_num", "left")
    remarks, title = F.coalesce("Remarks", F.lit("")), F.coalesce("Title", F.lit(""))
    entity = F.concat(F.lit("OFAC_SDN_"), S.pad_number("ent_num", 6))
    return rows.select(
        entity.alias("row_id"), entity.alias("entity_id"), S.family_name_last("SDN_Name").alias("name"),
        merge_aliases(F.col("alt_aliases"), S.remarks_aliases(remarks)).alias("aliases"),
        S.remarks_dob(remarks).alias("dob"), S.remarks_nationality(remarks).alias("nationality"),
        F.when(F.lower("SDN_Type") == "individual", "individual").otherwise("entity").alias("entity_type"),
        F.lit(None).cast("string").alias("company"),
        F.array_compact(F.array("Program")).alias("topics"),
        F.lit(V.SDN_SOURCE).alias("source_list"), F.lit(V.SDN_URL).alias("source_url"),
        S.known(S.strip(F.concat(title, F.lit(" "), remarks))).alias("context"))


def load_sdn(spark: SparkSession, sdn_path: str, alt_path: str | None = None, multi_line: bool | None = None) -> DataFrame:
    return shape_sdn(read_sdn(spark, sdn_path, multi_line), read_alt(spark, alt_path, multi_line) if alt_path else None)


def light_sdn(sdn: DataFrame) -> DataFrame:
    """Five text columns for the light search; ``country`` holds the program, as published."""
    def clean(name: str) -> Column:
        text = S.strip(F.btrim(S.strip(F.coalesce(F.col(name), F.lit(""))), F.lit('"')))
        return F.when(text == V.LIST_NULL, "").otherwise(text)
    remarks = clean("Remarks")
    return sdn.where(F.col("Program").isNotNull()).select(
        F.lit("OFAC_SDN").alias("source"), clean("SDN_Name").alias("name"),
        F.when(F.lower(remarks).startswith("a.k.a."), remarks).otherwise("").alias("aliases"),
        clean("Program").alias("country"), remarks.alias("info")).where("name <> ''")


def shape_open_list(raw: DataFrame, schemas: list[str] | None = V.SCREENABLE_SCHEMAS) -> DataFrame:
    """The open list without rows that lack an id or a name, and without other schemas."""
    def text(name: str) -> Column:
        return S.strip(F.coalesce(F.col(name), F.lit("")))
    rows = raw.where((text("id") != "") & (text("name") != ""))
    if schemas is not None:
        rows = rows.where(text("schema").isin(schemas))
    return rows.select(
        text("id").alias("row_id"), text("id").alias("entity_id"), text("name").alias("name"),
        S.split_multi("aliases").alias("aliases"), S.known(text("birth_date")).alias("dob"),
        S.first_country("countries").alias("nationality"),
        F.when(text("schema") == "Person", "individual").otherwise("entity").alias("entity_type"),
        F.lit(None).cast("string").alias("company"), S.split_multi("sanctions").alias("topics"),
        F.coalesce(S.known(text("dataset")), F.lit(V.OPEN_LIST_SOURCE)).alias("source_list"),
        F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("context"))


def load_open_list(spark: SparkSession, path: str, schemas: list[str] | None = V.SCREENABLE_SCHEMAS, multi_line: bool | None = None) -> DataFrame:
    return shape_open_list(read_text_csv(spark, path, multi_line), schemas)


def light_open_list(raw: DataFrame) -> DataFrame:
    def text(name: str) -> Column:
        return S.strip(F.coalesce(F.col(name), F.lit("")))
    return raw.select(F.lit("OpenSanctions").alias("source"), text("name").alias("name"), text("aliases").alias("aliases"),
                      text("countries").alias("country"), text("sanctions").alias("info")).where("name <> ''")


def entity_url(entity_id: Column) -> Column:
    return F.concat(F.lit(V.OPEN_LIST_URL), entity_id, F.lit("/"))


def combine_lists(real: dict[str, DataFrame], fixtures: DataFrame | None, mode: str = "both") -> DataFrame:
    """Union of the lists a mode asks for; fixture rows carry a mark in their source."""
    if mode not in ("both", "real", "sample"):
        raise ValueError(f"unknown mode: {mode}")
    parts = []
    if mode in ("both", "real"):
        parts += [df.withColumns({"list": F.lit(name), "real_data": F.lit(True)}) for name, df in real.items()]
    if mode in ("both", "sample") and fixtures is not None:
        source = F.col("source_list")
        marked = F.when(source.endswith(V.FIXTURE_SUFFIX), source).otherwise(F.concat(source, F.lit(V.FIXTURE_SUFFIX)))
        parts.append(fixtures.withColumns({"source_list": marked, "list": F.lit("demo_fixtures"), "real_data": F.lit(False)}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("row_id", F.concat_ws(":", "list", "row_id"))


def list_statistics(combined: DataFrame, limits: dict[str, int | None] | None = None) -> DataFrame:
    """Entities per list, and whether a cap cut the list."""
    limits = {k: v for k, v in (limits or {}).items() if v is not None}
    truncated = F.lit(False)
    for name, limit in limits.items():
        truncated = F.when(F.col("list") == name, F.col("entities") >= limit).otherwise(truncated)
    counts = combined.groupBy("list", "real_data").agg(F.count(F.lit(1)).alias("entities"))
    return counts.withColumn("truncated", truncated)


# --- ownership, articles, regulation, payloads -------------------------------------------------

_OWNERSHIP = "entities array<map<string,string>>, ownership_edges array<struct<owner_id:string,owned_id:string,percentage:double>>"


def load_ownership(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ownership files; the file's stem names the structure."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("structure"),
        F.from_json("value", _OWNERSHIP).alias("body"))
    known = ["entity_id", "name", "context"]
    nodes = files.select("structure", F.posexplode("body.entities").alias("position", "e")).select(
        "structure", *[F.try_element_at("e", F.lit(k)).alias(k) for k in known],
        F.map_filter("e", lambda k, v: ~k.isin(known)).alias("metadata"), "position")
    edges = files.select("structure", F.explode("body.ownership_edges").alias("e")).select("structure", "e.*")
    return nodes, edges


def load_articles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(
        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))


def load_regulation(spark: SparkSession, path: str) -> DataFrame:
    """Regulation paragraphs from CSV or from one JSON array; several rows per article."""
    columns = ["article_id", "article_title", "article_text", "article_recitals"]
    if path.endswith(".json"):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = spark.read.schema(schema).json(path, multiLine=True)
    else:
        raw = read_text_csv(spark, path, multi_line=True)
    return raw.select(*[S.strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns]).withColumn(
        "position", F.monotonically_increasing_id())


def extract_records(payloads: DataFrame, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of landed payloads (``payload_id``, ``payload``): the root list, or one named field.

    Returns the records and the payloads of any other shape.
    """
    parsed = F.try_parse_json("payload")
    root = parsed if field is None else F.try_variant_get(parsed, f"$.{field}", "variant")
    shaped = payloads.withColumn("_items", F.try_variant_get(root, "$", "array<variant>")).withColumn(
        "_good", F.coalesce(F.forall("_items", lambda item: F.schema_of_variant(item).startswith("OBJECT")), F.lit(False)))
    records = shaped.where("_good").select("payload_id", F.posexplode("_items").alias("position", "record"))
    rejected = shaped.where("not _good").select("payload_id", F.lit("invalid_payload_shape").alias("error_code"))
    return records, rejected


def map_records(records: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Source fields to canonical columns, all as text; absent and null values become ''."""
    def text(source: str) -> Column:
        value = F.try_variant_get("record", f"$.{source}", "variant")
        plain = F.try_variant_get("record", f"$.{source}", "string")
        return F.coalesce(F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(plain)).otherwise(plain), F.lit(""))
    targets: dict[str, Column] = {}
    for source, target in mapping.items():
        targets[target] = text(source)
    return records.select("payload_id", "position", *[value.alias(target) for target, value in targets.items()])
