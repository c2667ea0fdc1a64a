"""Row validation, duplicate handling and quality reports for customer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions import scalars as S
from probita.functions.privacy import report_reference
from probita.operators.skew import skew_join, top_n


def _issue(applies: Column, field: str, code: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(applies, F.struct(F.lit(field).alias("field"), F.lit(code).alias("issue_code"), message.alias("message")))


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Canonical values and the ordered list of issues of every row (``row_number`` plus text columns)."""
    values: dict[str, Column] = {}
    for field in V.KYC_REQUIRED:
        text = S.strip(F.coalesce(F.col(field), F.lit(""))) if field == "client_id" else S.collapse_blanks(field)
        values[field] = F.upper(text) if field == "country" else text
    flags = {field: S.strict_bool(field) for field in V.KYC_FLAGS}
    staged = rows.select("row_number", *[v.alias(k) for k, v in {**values, **flags, "sector_risk": S.sector_risk("sector_risk")}.items()])
    issues = []
    for field in V.KYC_REQUIRED:
        size, most = F.length(field), V.KYC_MAX_LENGTH[field]
        issues.append(_issue(F.col(field) == "", field, "missing_required_field", f"{field} is blank/missing"))
        issues.append(_issue(size > most, field, "value_too_long", F.concat(
            F.lit(f"{field} length "), size.cast("string"), F.lit(f" exceeds max {most}"))))
    for field in V.KYC_FLAGS:
        issues.append(_issue(F.col(field).isNull(), field, "invalid_boolean", f"{field}: unrecognized boolean value"))
    issues.append(_issue(F.col("sector_risk").isNull(), "sector_risk", "invalid_sector_risk", "unrecognized sector_risk category"))
    return staged.withColumn("issues", F.array_compact(F.array(*issues)))


def duplicate_ids(rows: DataFrame, key: str = "client_id") -> DataFrame:
    """Non-blank ids that occur more than once, with their number of rows."""
    return rows.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def flag_duplicates(normalized: DataFrame, **skew) -> DataFrame:
    """Adds the duplicate issue to every occurrence of a repeated id; no row wins."""
    joined = skew_join(normalized, duplicate_ids(normalized), ["client_id"], how="left", **skew)
    extra = _issue(F.col("occurrences").isNotNull(), "client_id", "duplicate_client_id", F.concat(
        F.lit("client_id occurs "), F.col("occurrences").cast("string"), F.lit(" times")))
    return joined.withColumn("issues", F.concat("issues", F.array_compact(F.array(extra)))).drop("occurrences")


def validate_batch(rows: DataFrame, **skew) -> DataFrame:
    """Rows with all their issues; the clean ones are the entities."""
    return flag_duplicates(normalize_rows(rows), **skew)


def entities(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("issues") == 0).select(*V.KYC_COLUMNS)


def issues(validated: DataFrame) -> DataFrame:
    """One row per issue, with a masked reference to the client."""
    reference = F.when(F.col("client_id") != "", report_reference("client_id"))
    return validated.select("row_number", reference.alias("client_ref"), F.inline("issues"))


def quality_report(validated: DataFrame) -> DataFrame:
    """Totals, issues by code and missing values by field, as rows of section, name and value."""
    valid = (F.size("issues") == 0).cast("long")
    totals = validated.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum(valid), F.lit(0)).alias("valid_rows")).select(
        F.expr("inline(array(struct('total' AS section, 'total_rows' AS name, total_rows AS value),"
               " struct('total' AS section, 'valid_rows' AS name, valid_rows AS value),"
               " struct('total' AS section, 'invalid_rows' AS name, total_rows - valid_rows AS value)))"))
    doubled = duplicate_ids(validated).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("total").alias("section"), F.lit("duplicate_client_ids").alias("name"), "value")
    found = validated.select(F.inline("issues"))
    missing = F.col("issue_code") == "missing_required_field"
    names = F.array(F.struct(F.lit("issue").alias("section"), F.col("issue_code").alias("name")),
                    F.struct(F.when(missing, "missing").alias("section"), F.col("field").alias("name")))
    counts = found.select(F.inline(names)).where("section is not null").groupBy("section", "name").agg(F.count(F.lit(1)).alias("value"))
    return totals.unionByName(doubled).unionByName(counts)


def profile_columns(rows: DataFrame, key: str, personal: list[str]) -> DataFrame:
    """Per column: blank values and, for personal columns, the range of lengths; values are never shown."""
    columns = [c for c in rows.columns if c != "row_number"]
    text = {c: S.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns}
    measures = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(text[c] == "").alias(f"n_{c}") for c in columns],
        *[F.min(F.length(text[c])).alias(f"lo_{c}") for c in personal], *[F.max(F.length(text[c])).alias(f"hi_{c}") for c in personal])
    none = F.lit(None).cast("int")
    return measures.select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("blank_values"),
                 (F.col(f"lo_{c}") if c in personal else none).alias("min_length"),
                 (F.col(f"hi_{c}") if c in personal else none).alias("max_length")) for c in columns])))


def profile_ids(rows: DataFrame, key: str = "client_id") -> DataFrame:
    ids = rows.select(S.strip(F.coalesce(key, F.lit(""))).alias(key)).where(F.col(key) != "")
    counts = ids.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("n") > 1).alias("duplicate_ids"))


def profile_categories(rows: DataFrame, columns: list[str], full: int = 25, top: int = 5) -> DataFrame:
    """Counts of the values of category columns: all of them up to ``full``, else the ``top`` most frequent."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), S.strip(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in columns])
    counts = rows.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    cardinality = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("cardinality"))
    first = top_n(counts, ["column_name"], [F.col("n").desc(), F.col("value")], full)
    return first.join(cardinality, "column_name").where((F.col("cardinality") <= full) | (F.col("rank") <= top)).drop("rank")


def record_quality(records: DataFrame) -> DataFrame:
    """Score, completeness and issues of canonical records (``known_duplicate`` comes from ingestion)."""
    text = S.strip("country")
    found = F.array_compact(F.array(
        F.when(~text.rlike(r"^\p{L}{2}$"), F.lit("normalization_warning")),
        F.when(F.col("updated_at") < F.col("created_at"), F.lit("inconsistent_value")),
        F.when(F.col("known_duplicate"), F.lit("duplicate_identifier"))))
    penalty = (
        F.when(F.array_contains("quality_issues", "normalization_warning"), V.QUALITY_PENALTY["low"]).otherwise(0)
        + F.when(F.array_contains("quality_issues", "inconsistent_value"), V.QUALITY_PENALTY["medium"]).otherwise(0)
        + F.when(F.array_contains("quality_issues", "duplicate_identifier"), V.QUALITY_PENALTY["high"]).otherwise(0))
    kinds = dict(records.dtypes)
    filled = F.lit(0)
    for field in V.COMPLETENESS_FIELDS:
        some = F.size(field) > 0 if kinds[field].startswith("array") else F.length(F.coalesce(F.col(field), F.lit(""))) > 0
        filled = filled + F.coalesce(some, F.lit(False)).cast("int")
    return records.withColumn("quality_issues", found).select(
        "client_id", F.greatest(F.lit(0), F.lit(100) - penalty).cast("double").alias("data_quality_score"),
        (filled / len(V.COMPLETENESS_FIELDS)).alias("completeness_ratio"), "quality_issues")


def batch_quality(assessed: DataFrame) -> DataFrame:
    totals = assessed.agg(
        F.count(F.lit(1)).alias("total_entities"), F.sum("data_quality_score").alias("s"), F.sum("completeness_ratio").alias("c"),
        F.count_if(F.size("quality_issues") > 0).alias("records_with_issues"))
    n = F.greatest(F.col("total_entities"), F.lit(1))
    return totals.select("total_entities", S.half_even(F.coalesce(F.col("s") / n, F.lit(0.0)), 2).alias("avg_data_quality_score"),
                         S.half_even(F.round(F.coalesce(F.col("c") / n, F.lit(0.0)), 8), 4).alias("avg_completeness_ratio"), "records_with_issues")


def batch_issue_counts(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode("quality_issues").alias("issue_code")).groupBy("issue_code").agg(F.count(F.lit(1)).alias("n"))
