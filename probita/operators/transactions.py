"""Transaction statistics per customer, account joins and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita.functions.scalars import half_even, lenient_flag, number_or
from probita.operators.skew import dense_position, top_n
from probita.session import cut_lineage

FLAGS = {
    "ofac_matches": "ofac_match_flag",
    "fatf_hits": "fatf_country_flag",
    "structuring_hits": "structuring_pattern_flag",
    "rapid_movement_hits": "rapid_movement_flag",
    "trade_mispricing_hits": "trade_mispricing_flag",
}
TRANSFER_KEYS = ["Date", "Time", "Sender_account", "Receiver_account", "Amount"]


def _typed(df: DataFrame) -> DataFrame:
    """Text columns are read leniently; typed columns pass through without a parse."""
    kinds = dict(df.dtypes)
    amount = number_or("amount") if kinds["amount"] == "string" else F.coalesce(F.col("amount"), F.lit(0.0))
    flags = {c: (lenient_flag(c) if kinds[c] == "string" else F.coalesce((F.col(c) != 0).cast("int"), F.lit(0)))
             for c in FLAGS.values()}
    return df.withColumns({"amount": amount, **flags})


def client_statistics(transactions: DataFrame) -> DataFrame:
    """Count, sum, mean, maximum and flag sums per client: one shuffle of partial aggregates."""
    stats = _typed(transactions).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        *[F.sum(flag).alias(name) for name, flag in FLAGS.items()],
    )
    return stats.withColumns({
        "high_risk_country_transfers": F.col("ofac_matches") + F.col("fatf_hits"),
        "typology_hits": F.col("structuring_hits") + F.col("rapid_movement_hits") + F.col("trade_mispricing_hits"),
    })


def statistics_detail(stats: DataFrame) -> DataFrame:
    """The view for a case page: amounts rounded to cents."""
    return stats.select(
        "client_id", "transaction_count",
        *[half_even(F.round(c, 6), 2).alias(c) for c in ("total_amount", "avg_amount", "max_amount")],
        "typology_hits", "high_risk_country_transfers",
    )


def with_statistics(clients: DataFrame, stats: DataFrame) -> DataFrame:
    """Every client, with zeros where it has no transactions."""
    joined = clients.join(stats, "client_id", "left")
    return joined.fillna(0, subset=[c for c in stats.columns if c != "client_id"])


def volume_change(count, average, largest):
    return (
        F.when(count == 0, F.lit(1.0))
        .when(largest > F.greatest(average * 4, F.lit(10000.0)), F.lit(3.0))
        .when(largest > F.greatest(average * 2.5, F.lit(5000.0)), F.lit(2.0))
        .otherwise(F.lit(1.2))
    )


def first_transactions(transactions: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` transactions of each client by time and id, as one list."""
    kept = top_n(transactions, ["client_id"], [F.col("timestamp"), F.col("transaction_id")], n)
    sample = F.struct("rank", "transaction_id", "timestamp", "amount")
    return kept.groupBy("client_id").agg(F.array_sort(F.collect_list(sample)).alias("sample_transactions"))


def client_transfers(transfers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Transfers in which a client's account sends or receives, each once per client.

    Rows that agree on the five identifying columns count as one transfer; they are made one before they are joined, so
    nothing is grouped after the join that multiplies rows. A transfer meets the clients of its sending account and then those
    of its receiving account that do not own the sending one. The engine's skew join splits an account with very many transfers.
    """
    others = [c for c in transfers.columns if c not in TRANSFER_KEYS]
    once = transfers.groupBy(*TRANSFER_KEYS).agg(F.min(F.struct(*others)).alias("_rest")).withColumns({"_from": F.trim("Sender_account"), "_to": F.trim("Receiver_account")})
    pairs = mapping.select("client_id", F.trim("account").alias("account")).distinct()
    columns = ["client_id", *TRANSFER_KEYS, "_rest.*"]
    sent = once.join(pairs.withColumnRenamed("account", "_from"), "_from").select(*columns)
    other = once.where(~F.col("_from").eqNullSafe(F.col("_to"))).join(pairs.withColumnRenamed("account", "_to"), "_to")
    received = other.join(pairs.withColumnRenamed("account", "_from"), ["client_id", "_from"], "left_anti").select(*columns)
    return sent.unionByName(received)


def _totals(transfers: DataFrame, key: str) -> DataFrame:
    return transfers.groupBy(key).agg(F.count(F.lit(1)).alias("transfers"), F.sum("Amount").alias("amount"), F.min("Date").alias("first_date"), F.max("Receiver_account").alias("last_receiver"))


def client_transfer_totals(transfers: DataFrame, mapping: DataFrame) -> DataFrame:
    """``client_transfers`` counted and summed per client: ``transfers``, ``amount``, ``first_date``, ``last_receiver``.

    Transfers are summed under each of their accounts and the accounts' totals under their clients, so a transfer is never
    repeated for an account's clients. Only a client that owns both accounts of a transfer would count it twice: the
    transfers of such clients are looked up one by one.
    """
    sides = F.array_distinct(F.array(F.trim("Sender_account"), F.trim("Receiver_account")))
    totals = _totals(transfers.select(*TRANSFER_KEYS).distinct().select("Date", "Amount", "Receiver_account", F.explode(sides).alias("account")), "account")
    pairs = mapping.select("client_id", F.trim("account").alias("account")).where("account is not null").distinct()
    several = pairs.where("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    owned = cut_lineage(pairs.join(several, "client_id", "left_semi"))
    rows = []
    if not owned.isEmpty():
        between = transfers.select(F.trim("Sender_account").alias("_from"), F.trim("Receiver_account").alias("_to")).where("_from <> _to").distinct()
        accounts = owned.select("account").distinct()
        for side in ("_from", "_to"):
            between = between.join(accounts.withColumnRenamed("account", side), side, "left_semi")
        crossed = between.join(owned.withColumnRenamed("account", "_from"), "_from").join(owned.withColumnRenamed("account", "_to"), ["client_id", "_to"])
        both = cut_lineage(crossed.select("client_id").distinct())
        rows.append(_totals(client_transfers(transfers, pairs.join(both, "client_id", "left_semi")), "client_id"))
        pairs = pairs.join(both, "client_id", "left_anti")
    summed = pairs.join(totals, "account").groupBy("client_id").agg(
        F.sum("transfers").alias("transfers"), F.sum("amount").alias("amount"), F.min("first_date").alias("first_date"), F.max("last_receiver").alias("last_receiver"))
    return summed.unionByName(rows[0]) if rows else summed


def _amount_order() -> Column:
    key = F.struct("Date", "Time", "Sender_account", "Receiver_account")
    return F.struct((-F.col("Amount")).alias("negative"), key.alias("key"))


def largest_transfer(client_transfers: DataFrame) -> DataFrame:
    """Largest transfer per client; on equal amounts the smallest key."""
    best = client_transfers.groupBy("client_id").agg(F.min(_amount_order()).alias("best"))
    return best.select("client_id", (-F.col("best.negative")).alias("Amount"), "best.key.*")


def under_accounts(transfers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Transfers under each of their accounts that a client has, once where both are the same."""
    sides = transfers.withColumn("account", F.explode(F.array_distinct(F.array(F.trim("Sender_account"), F.trim("Receiver_account")))))
    return sides.join(mapping.select(F.trim("account").alias("account")).distinct(), "account", "left_semi")


def largest_client_transfer(transfers: DataFrame, mapping: DataFrame) -> DataFrame:
    """``largest_transfer`` of ``client_transfers``, from the largest transfer of each account: a transfer is never repeated for the clients of its accounts."""
    largest = under_accounts(transfers, mapping).groupBy("account").agg(F.min(_amount_order()).alias("best"))
    pairs = mapping.select("client_id", F.trim("account").alias("account")).distinct()
    best = pairs.join(largest, "account").groupBy("client_id").agg(F.min("best").alias("best"))
    return best.select("client_id", (-F.col("best.negative")).alias("Amount"), "best.key.*")


#: Positions of transfers whose accounts are numbered together where all are.
SLOT = 100_000


def first_seen_accounts(transfers: DataFrame, per_flag: int | None = None) -> DataFrame:
    """Sending accounts of flagged and of other transfers in order of appearance, ``rank`` from 1: all, or the first ``per_flag`` of each."""
    seen = transfers.groupBy("Is_laundering", F.trim("Sender_account").alias("account")).agg(F.min("position").alias("position"))
    order = [F.col("position"), F.col("account")]
    if per_flag is not None:
        return top_n(seen, ["Is_laundering"], order, per_flag)
    return dense_position(seen, ["Is_laundering"], F.floor(F.col("position") / SLOT), order, "rank").withColumn("rank", F.col("rank").cast("int"))


def assign_accounts(clients: DataFrame, accounts: DataFrame, clients_per_group: int | None = None, accounts_per_client: int = 2) -> DataFrame:
    """Deal accounts to clients in turn: flagged clients get accounts of flagged transfers.

    All clients take part, or the first ``clients_per_group`` of each group by id. Where clients are all numbered, they are so
    within ranges of their ids, which are offset by the ranges' sizes.
    """
    risky = ((F.col("sanctions_flag") == 1) | (F.col("ofac_country_flag") == 1)).cast("int")
    grouped = clients.select("client_id", risky.alias("Is_laundering"))
    if clients_per_group is not None:
        chosen = top_n(grouped, ["Is_laundering"], [F.col("client_id")], clients_per_group)
    else:
        ranged = cut_lineage(grouped.repartitionByRange("client_id").withColumn("_range", F.spark_partition_id()))
        chosen = dense_position(ranged, ["Is_laundering"], F.col("_range"), [F.col("client_id")], "rank").drop("_range")
    copies = F.explode(F.sequence(F.lit(0), F.lit(accounts_per_client - 1)))
    turns = chosen.select("client_id", "Is_laundering", "rank", copies.alias("copy")).withColumn(
        "turn", (F.col("rank") - 1) * accounts_per_client + F.col("copy"))
    sizes = accounts.groupBy("Is_laundering").agg(F.count(F.lit(1)).alias("n"))  # a row per group
    placed = turns.join(sizes, "Is_laundering").withColumn("rank", (F.col("turn") % F.col("n") + 1).cast("int"))
    return placed.select("client_id", "Is_laundering", "turn", "rank").join(accounts, ["Is_laundering", "rank"]).select(
        "client_id", "account", "turn", "Is_laundering")
