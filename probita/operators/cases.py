"""Case work on top of the risk score: ranking, summaries, status, dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions.scalars import lenient_flag, number_or, pad_number, plain_number

TOP_CASES = 30
OPEN_ROLES = ["compliance", "investigator", "admin"]


def top_cases(assessments: DataFrame, n: int = TOP_CASES) -> DataFrame:
    """Highest score first, then confidence; the smaller id decides a tie."""
    return assessments.orderBy(F.col("risk_score").desc(), F.col("confidence_score").desc(), F.col("client_id")).limit(n)


def _flag(df: DataFrame, name: str) -> Column:
    return lenient_flag(name) if dict(df.dtypes)[name] == "string" else F.coalesce(F.col(name), F.lit(0))


def false_positives_prevented(clients: DataFrame) -> Column:
    opacity = number_or("ownership_opacity_score") if dict(clients.dtypes)["ownership_opacity_score"] == "string" else F.coalesce("ownership_opacity_score", F.lit(0.0))
    return F.count_if((_flag(clients, "sanctions_flag") == 0) & (_flag(clients, "pep_flag") == 0) & (opacity < 0.25))


def portfolio_summary(clients: DataFrame, stats: DataFrame, assessments: DataFrame, transfers: DataFrame,
                      scope: str = "all", reviews: DataFrame | None = None) -> DataFrame:
    """One row of totals.

    ``scope='all'`` counts every assessed client, and as pending those that trigger an investigation.
    ``scope='top30'`` counts the shown cases only; pending is what no review has answered yet.
    """
    if scope not in ("all", "top30"):
        raise ValueError(f"unknown scope: {scope}")
    shown = assessments if scope == "all" else top_cases(assessments)
    levels = shown.agg(
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_risk"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.count_if("trigger_investigation").alias("triggered"),
        F.count_if("sar_recommended").alias("awaiting_signoff"),
    )
    if scope == "all":
        pending = F.col("triggered")
    else:
        done = reviews.agg(F.count(F.lit(1))).scalar() if reviews is not None else F.lit(0)
        pending = F.greatest(F.lit(0), F.col("critical_risk") + F.col("high_risk") - done)
    return levels.select(
        clients.agg(F.count(F.lit(1))).scalar().alias("clients_loaded"),
        stats.agg(F.sum("transaction_count")).scalar().alias("transactions_loaded"),
        transfers.agg(F.count(F.lit(1))).scalar().alias("transfer_rows"),
        "critical_risk", "high_risk", pending.alias("pending_reviews"), "awaiting_signoff",
        clients.agg(false_positives_prevented(clients)).scalar().alias("false_positives_prevented"),
    )


def case_status(customers: DataFrame, reviews: DataFrame, signoffs: DataFrame) -> DataFrame:
    """Any sign-off wins, else the last review's action, else the case still needs one."""
    last = reviews.groupBy("customer_id").agg(
        F.max_by("action", F.struct("timestamp", "review_id")).alias("last_action"), F.count(F.lit(1)).alias("reviews"))
    signed = signoffs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("signoffs"))
    joined = customers.select("customer_id").distinct().join(last, "customer_id", "left").join(signed, "customer_id", "left")
    return joined.select(
        "customer_id",
        F.when(F.col("signoffs") > 0, "SAR Draft Signed Off").otherwise(F.coalesce("last_action", F.lit("Requires Review"))).alias("status"),
        F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("signoffs", F.lit(0)).alias("signoffs"),
    )


def case_rows(clients: DataFrame, assessments: DataFrame, role: str = "compliance") -> DataFrame:
    """List view of the cases; the beneficial owner is shown to open roles only."""
    score = F.col("risk_score")
    owner = (F.concat(F.lit("Linked party for "), F.col("client_name")) if role in OPEN_ROLES
             else F.lit("Restricted - available to authorized reviewers"))
    return assessments.join(clients.select("client_id", "client_name"), "client_id").select(
        F.concat(F.lit("CASE-"), pad_number("client_id", 4)).alias("case_id"),
        "client_id", F.col("client_name").alias("name"),
        F.when(F.col("trigger_investigation"), "Requires Review").otherwise("Monitoring").alias("status"),
        "risk_score", "risk_level", "confidence_score",
        F.when(score >= V.LEVEL_CRITICAL, "Enhanced Due Diligence").when(score >= V.LEVEL_HIGH, "Risk Monitoring")
        .otherwise("Periodic Review").alias("assigned_team"),
        F.coalesce(F.get("top_reasons", F.lit(0)), F.lit("Routine monitoring profile")).alias("summary"),
        owner.alias("beneficial_owner"),
    )


def filter_cases(cases: DataFrame, level: str = "ALL", needle: str = "") -> DataFrame:
    needle = needle.strip().lower()
    if level != "ALL":
        cases = cases.where(F.col("risk_level") == level)
    if needle:
        cases = cases.where(F.contains(F.lower(F.concat_ws(" ", "name", F.col("client_id").cast("string"), "case_id")), F.lit(needle)))
    return cases


def case_details(clients: DataFrame, stats: DataFrame, assessments: DataFrame) -> DataFrame:
    """Timeline, evidence list and report draft of every case."""
    joined = (
        assessments.join(clients, "client_id")
        .join(stats.select("client_id", "transaction_count", "typology_hits", "high_risk_country_transfers"), "client_id", "left")
        .fillna(0, subset=["transaction_count", "typology_hits", "high_risk_country_transfers"])
    )
    client = F.col("client_id").cast("string")

    def point(date: str, score: Column, event: Column) -> Column:
        return F.struct(F.lit(date).alias("date"), score.cast("int").alias("score"), event.alias("event"))

    def item(prefix: str, source: str, confidence: float, claim: Column) -> Column:
        return F.struct(F.concat(F.lit(prefix), client).alias("id"), F.lit(source).alias("source"),
                        F.lit(confidence).alias("confidence"), claim.alias("claim"))

    listed = (_flag(joined, "sanctions_flag") != 0) | (_flag(joined, "ofac_country_flag") != 0)
    timeline = F.array(
        point("T-21 days", F.greatest(F.lit(0), F.col("risk_score") - F.col("risk_delta")),
              F.lit("Prior monitoring baseline from stored score history")),
        point("T-7 days", F.col("base_score"), F.concat(
            F.lit("Transaction aggregation reviewed across "), F.col("transaction_count").cast("string"), F.lit(" local transaction(s)"))),
        point("Today", F.col("risk_score"), F.col("timeline_reason")),
    )
    evidence = F.array_compact(F.array(
        item("KYC-", "KYC profile dataset", 0.88, F.concat(
            F.lit("Sector risk: "), "sector_risk", F.lit(" | Country: "), "country")),
        item("TXN-", "Transaction dataset", 0.80, F.concat(
            F.col("typology_hits").cast("string"), F.lit(" typology hit(s), "),
            F.col("high_risk_country_transfers").cast("string"), F.lit(" high-risk jurisdiction transfer(s)"))),
        F.when(listed, item("SAN-", "Sanctions flags dataset", 0.92, F.lit("Sanctions or OFAC exposure flag present"))),
        F.when(_flag(joined, "sectoral_sanctions_flag") != 0, item(
            "MEDIA-", "Sectoral sanctions signal", 0.72, F.lit("Sectoral sanctions exposure requires adverse-media review"))),
    ))
    reasons = F.slice("top_reasons", 1, 3)
    return joined.select(
        "client_id", timeline.alias("timeline"), evidence.alias("evidence"),
        F.concat(F.lit("Corporate Entity "), client, F.lit(", "), "client_name").alias("draft_subject"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("No material suspicious activity identified.").alias("draft_activity"),
        F.when(F.col("sar_recommended"), "Draft SAR recommended for human review only; no automatic filing.")
        .otherwise("Monitor and continue evidence collection.").alias("draft_recommendation"),
    )


PROFILE_INDICATORS = [
    ("sanctions_flag", "critical", "Possible sanctions exposure is present in profile flags."),
    ("pep_flag", "high", "Politically exposed person flag is present in profile."),
    ("fatf_country_flag", "high", "FATF high-risk jurisdiction flag is present in profile."),
    ("sectoral_sanctions_flag", "high", "Sectoral sanctions flag is present in profile."),
]


def dispositions(clients: DataFrame, largest: DataFrame) -> DataFrame:
    """Rule-based finding of each client: indicators, cited evidence, confidence and verdict."""
    joined = clients.join(largest.select(
        "client_id", F.col("Amount").alias("_amount"), F.col("Sender_account").alias("_sender")), "client_id", "left")

    def indicator(name: str, severity: str, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("indicator"), F.lit(severity).alias("severity"), detail.alias("detail"))

    def cited(claim: Column, kind: str, source: Column, confidence: str) -> Column:
        return F.struct(claim.alias("claim"), F.lit(kind).alias("source_type"), source.alias("source_id"), F.lit(confidence).alias("confidence"))

    sector = F.lower(F.coalesce("sector_risk", F.lit("")))
    high = sector.isin("high", "critical")
    traded = F.col("_amount").isNotNull()
    largest_text = F.concat(F.lit("Largest observed transaction amount is "), plain_number("_amount"), F.lit("."))
    indicators = [F.when(high, indicator("sector_risk", "high", F.concat(F.lit("Profile sector risk is "), sector, F.lit("."))))]
    evidence = [F.when(high, cited(F.lit("High sector risk on KYC profile."), "kyc_profile", F.lit("sector_risk=high"), "high"))]
    for name, severity, detail in PROFILE_INDICATORS:
        on = _flag(joined, name) != 0
        indicators.append(F.when(on, indicator(name, severity, F.lit(detail))))
        evidence.append(F.when(on, cited(F.lit(detail), "kyc_profile", F.lit(name), "high")))
    indicators.append(F.when(traded, indicator("transaction_review", "medium", largest_text)))
    evidence.append(F.when(traded, cited(largest_text, "transaction", F.concat(F.lit("txn:"), "_sender"), "medium")))
    found, proof = F.array_compact(F.array(*indicators)), F.array_compact(F.array(*evidence))
    baseline = F.array(indicator("baseline_review", "low", F.lit("No high-risk demo indicators were found in currently available local records.")))
    baseline_proof = F.array(cited(F.lit("Profile was available for baseline KYC review."), "kyc_profile", F.lit("client_id"), "medium"))
    staged = joined.withColumns({"_found": found, "_proof": proof}).withColumns({
        "risk_indicators": F.when(F.size("_found") > 0, F.col("_found")).otherwise(baseline),
        "evidence": F.when(F.size("_found") > 0, F.col("_proof")).otherwise(baseline_proof),
    }).withColumn("_elevated", F.exists("risk_indicators", lambda i: i["severity"].isin("high", "critical")))
    details = F.transform(F.slice("risk_indicators", 1, 3), lambda i: i["detail"])
    return staged.select(
        "client_id", "client_name", "country",
        F.concat(F.lit("Demo review for "), "client_name", F.lit(": "), F.array_join(details, "; ")).alias("summary"),
        "risk_indicators", "evidence",
        F.when(F.col("_elevated"), "high").otherwise("medium").alias("confidence"),
        F.when(F.col("_elevated"), "high").otherwise("medium").alias("prosecution_strength"),
        F.lit("medium").alias("defence_strength"),
        F.when(F.col("_elevated"), "escalate_to_sar").otherwise("false_positive_clear").alias("verdict"),
    )


def reports(findings: DataFrame) -> DataFrame:
    """Report fields of the findings whose verdict is to escalate."""
    cited = F.array_join(F.transform("evidence", lambda e: e["source_id"]), ", ")
    return findings.where(F.col("verdict") == "escalate_to_sar").select(
        "client_id",
        F.concat(F.lit("Subject: "), "client_name", F.lit("; jurisdiction: "), F.coalesce("country", F.lit("Demo jurisdiction")),
                 F.lit("; client id: "), F.col("client_id").cast("string"), F.lit(".")).alias("subject_information"),
        F.concat(F.lit("AI-generated demo SAR draft. The review identified indicators requiring human compliance review. Deciding evidence: "),
                 F.when(cited == "", "verified demo evidence").otherwise(cited), F.lit(".")).alias("narrative"),
        F.transform("risk_indicators", lambda i: i["detail"]).alias("red_flags"),
        F.array(F.lit("Generic AML suspicious activity review obligation")).alias("regulatory_basis"),
        F.lit("file SAR").alias("recommended_action"),
        F.lit("AI-generated, requires human review before filing.").alias("disclaimer"),
        "evidence",
    )


def page(clients: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of the client list in id order."""
    return clients.orderBy("client_id").offset(offset).limit(limit)


def lookup(clients: DataFrame, wanted: DataFrame) -> DataFrame:
    """Clients asked for by plain or prefixed id; an exact id wins over a prefixed one."""
    ids = clients.select(F.col("entity_id").alias("_id"))
    exact = wanted.select("asked").distinct().join(ids.withColumnRenamed("_id", "asked").withColumn("_exact", F.lit(True)), "asked", "left")
    prefixed = F.concat(F.lit("CLIENT-"), "asked")
    both = exact.withColumn("_prefixed", prefixed).join(
        ids.select(F.col("_id").alias("_prefixed"), F.lit(True).alias("_found")), "_prefixed", "left")
    return both.select("asked", F.when(F.col("_exact"), F.col("asked")).when(F.col("_found"), F.col("_prefixed"))
                       .otherwise(F.col("asked")).alias("entity_id"),
                       (F.col("_exact").isNotNull() | F.col("_found").isNotNull()).alias("known"))
