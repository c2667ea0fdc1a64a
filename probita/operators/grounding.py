"""Checks that cited evidence exists in the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions.scalars import plain_number, strip
from probita.operators.skew import contains_join
from probita.operators.transactions import under_accounts


OWN_VALUES = ["Date", "Sender_account", "Receiver_account", "Amount"]


def _as_text(transfers: DataFrame, name: str) -> Column:
    """A value as a citation would write it."""
    return plain_number(name) if transfers.schema[name].dataType.simpleString() in ("double", "float") else F.col(name).cast("string")


def _without_prefix(text: Column, prefixes: list[str]) -> Column:
    out = text
    for prefix in reversed(prefixes):
        out = F.when(F.lower(text).startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(out)
    return out


def _profile_citations(cited: DataFrame, clients: DataFrame) -> DataFrame:
    known = clients.select("client_id").distinct().withColumn("_profile", F.lit(True))
    text = F.lower(strip("source_id"))
    named = F.lit(False)
    for field in V.PROFILE_FIELDS:
        named = named | F.contains(text, F.lit(field))
    own_id = F.regexp_replace(text, "[-_]", "").rlike(r"^\d+$") & F.contains(text, F.col("client_id").cast("string"))
    reason = (F.when(F.col("client_id").isNull(), "no client_id available for profile lookup")
              .when(F.col("_profile").isNull(), F.concat(F.lit("no profile found for client_id="), F.col("client_id").cast("string")))
              .when(named | own_id, "")
              .otherwise(F.concat(F.lit("'"), "source_id", F.lit("' does not match any known profile field"))))
    return cited.join(known, "client_id", "left").withColumn("reason", reason).drop("_profile")


def _transaction_citations(cited: DataFrame, transfers: DataFrame, client_transfers: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Known account anywhere in the text, or one of the client's own dates, accounts or amounts.

    Texts are short; tables are not. The pieces of each text are looked up by equality, under the client, or with ``mapping`` under the
    client's accounts: ``client_transfers`` repeats a transfer for each client of an account, and its values would be so as well.
    """
    body = _without_prefix(strip("source_id"), V.TRANSACTION_PREFIXES)
    accounts = transfers.select(F.explode(F.array(F.trim("Sender_account"), F.trim("Receiver_account"))).alias("piece")).distinct()
    parts = F.transform(F.split(body, r"[|/]"), strip)
    pieces = F.concat(F.regexp_extract_all(body, F.lit(r"(\d{6,})"), F.lit(1)),
                      F.when(F.size(parts) >= 3, parts).otherwise(F.array().cast("array<string>")))
    by_account = cited.select("citation_id", F.explode(F.array_distinct(pieces)).alias("piece")).join(accounts, "piece", "left_semi")
    # The texts are few and short: each is cut into its pieces of the lengths that values have.
    lengths = transfers.select(F.explode(F.array(*[F.length(_as_text(transfers, c)) for c in OWN_VALUES])).alias("n")).where(
        "n >= 1").agg(F.collect_set("n")).scalar()
    bodies = cited.where("client_id is not null").select("client_id", body.alias("haystack")).distinct()
    if mapping is None:
        asked, known = bodies.withColumn("_owner", F.col("client_id")), client_transfers.withColumn("_owner", F.col("client_id"))
    else:
        owners = mapping.select("client_id", F.trim("account").alias("_owner")).distinct()
        asked, known = bodies.join(owners, "client_id"), under_accounts(transfers, mapping).withColumnRenamed("account", "_owner")
    texts = asked.select("_owner", "haystack").distinct()
    sized = texts.select("_owner", "haystack", F.explode(lengths).alias("n")).where(F.length("haystack") >= F.col("n"))
    cut = sized.select("_owner", "haystack", "n", F.explode(F.sequence(F.lit(1), F.length("haystack") - F.col("n") + 1)).alias("at"))
    cut = cut.select("_owner", "haystack", F.substring(F.col("haystack"), F.col("at"), F.col("n")).alias("needle")).distinct()
    values = known.join(texts.select("_owner").distinct(), "_owner", "left_semi").select(
        "_owner", F.explode(F.array(*[_as_text(transfers, c) for c in OWN_VALUES])).alias("needle")).distinct()
    found = cut.hint("merge").join(values.hint("merge"), ["_owner", "needle"], "left_semi").select("_owner", "haystack").distinct()
    own = asked.join(found, ["_owner", "haystack"], "left_semi")
    by_value = cited.withColumn("haystack", body).join(own.select("client_id", "haystack").distinct(), ["client_id", "haystack"], "left_semi")
    good = by_account.select("citation_id").unionByName(by_value.select("citation_id")).distinct().withColumn("_good", F.lit(True))
    wrong = F.concat(F.lit("'"), "source_id", F.lit("' does not match any transaction record"))
    return cited.join(good, "citation_id", "left").withColumn("reason", F.when(F.col("_good"), "").otherwise(wrong)).drop("_good")


def _list_citations(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Name or alias that equals, holds or is held by the text; pieces under four letters do not count."""
    body = F.lower(strip(_without_prefix(strip("source_id"), V.LIST_PREFIXES)))
    bodies = cited.select(body.alias("t")).where("t <> ''").distinct()
    names = entries.select(F.lower("name").alias("n")).distinct()
    aliases = entries.select(F.lower("aliases").alias("haystack")).where("haystack <> ''").distinct()
    long_bodies = bodies.where(F.length("t") >= V.MIN_SUBSTRING).select(F.col("t").alias("needle"))
    good = (
        bodies.join(names, F.col("t") == F.col("n"), "left_semi")
        .unionByName(contains_join(long_bodies, names.select(F.col("n").alias("haystack"))).select(F.col("needle").alias("t")))
        .unionByName(contains_join(long_bodies, aliases).select(F.col("needle").alias("t")))
        .unionByName(contains_join(names.where(F.length("n") >= V.MIN_SUBSTRING).select(F.col("n").alias("needle")),
                                   bodies.select(F.col("t").alias("haystack"))).select(F.col("haystack").alias("t")))
        .distinct().withColumn("_good", F.lit(True)))
    wrong = F.concat(F.lit("'"), "source_id", F.lit("' does not match any sanctions entry"))
    reason = F.when(F.col("t") == "", "empty sanctions reference after stripping prefix").when(F.col("_good"), "").otherwise(wrong)
    return cited.withColumn("t", body).join(good, "t", "left").withColumn("reason", reason).drop("t", "_good")


def _regulation_citations(cited: DataFrame, regulation: DataFrame) -> DataFrame:
    number = F.regexp_extract("source_id", r"(?i)article\s*(\d+)", 1)
    wanted = F.when(number != "", F.concat(F.lit("article"), number)).otherwise(strip("source_id"))
    known = regulation.select(F.col("article_id").alias("_id")).distinct()
    wrong = F.when(number != "", F.concat(F.lit("article '"), F.col("_wanted"), F.lit("' not found in GDPR data"))).otherwise(
        F.concat(F.lit("'"), "source_id", F.lit("' does not match any GDPR article")))
    joined = cited.withColumn("_wanted", wanted).join(known, F.col("_wanted") == F.col("_id"), "left")
    return joined.withColumn("reason", F.when(F.col("_id").isNotNull(), "").otherwise(wrong)).drop("_wanted", "_id")


def verify_citations(cited: DataFrame, clients: DataFrame, transfers: DataFrame, client_transfers: DataFrame,
                     entries: DataFrame, regulation: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Status (verified, stripped or skipped) and reason of every citation (``citation_id``, ``client_id``, ``source_type``, ``source_id``).

    ``mapping`` are the accounts that ``client_transfers`` was made with; where it is given, a client's own values are looked up under its accounts.
    """
    def of(kind: str) -> DataFrame:
        return cited.where(F.col("source_type") == kind)
    checked = (
        _profile_citations(of("kyc_profile"), clients)
        .unionByName(_transaction_citations(of("transaction"), transfers, client_transfers, mapping))
        .unionByName(_list_citations(of("sanctions_list"), entries))
        .unionByName(_regulation_citations(of("gdpr"), regulation))
    ).withColumn("status", F.when(F.col("reason") == "", "verified").otherwise("stripped"))
    other = cited.where(~F.col("source_type").isin("kyc_profile", "transaction", "sanctions_list", "gdpr"))
    unchecked = F.col("source_type").isin(V.UNCHECKED_SOURCES)
    passed = other.withColumn("reason", F.when(unchecked, "no_ground_truth").otherwise("unknown_source_type")).withColumn(
        "status", F.when(unchecked, "skipped").otherwise("verified"))
    return checked.unionByName(passed)


def verification_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("client_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("verified", "stripped", "skipped")])


def verify_references(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether each reference equals, holds or is held by a surviving evidence id of its client (``client_id``, ``reference`` / ``source_id``)."""
    asked = refs.select("client_id", F.col("reference").alias("needle")).distinct()
    known = evidence.select("client_id", F.col("source_id").alias("haystack")).distinct()
    inside = contains_join(asked, known, by=["client_id"]).select("client_id", F.col("needle").alias("reference"))
    around = contains_join(known.select("client_id", F.col("haystack").alias("needle")), asked.select("client_id", F.col("needle").alias("haystack")),
                           by=["client_id"]).select("client_id", F.col("haystack").alias("reference"))
    # The empty reference is part of any id; an empty id is part of any reference.
    blank = asked.where("needle = ''").join(known.select("client_id").distinct(), "client_id", "left_semi").select("client_id", F.col("needle").alias("reference"))
    open_ = asked.join(known.where("haystack = ''").select("client_id").distinct(), "client_id", "left_semi").select("client_id", F.col("needle").alias("reference"))
    good = inside.unionByName(around).unionByName(blank).unionByName(open_).distinct().withColumn("_good", F.lit(True))
    return refs.join(good, ["client_id", "reference"], "left").withColumn("verified", F.coalesce("_good", F.lit(False))).drop("_good")


def guard_claims(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims with the guard's decision; a claim without a verdict is dropped, and says so."""
    latest = verdicts.groupBy("conv_id", "claim").agg(F.max_by(F.struct("supported", "reason"), "turn").alias("v"))
    kept = F.coalesce(F.col("v.supported"), F.lit(False))
    return claims.join(latest, ["conv_id", "claim"], "left").select(
        *claims.columns, kept.alias("kept"), F.coalesce("v.reason", F.lit("no guard verdict")).alias("guard_reason"))
