"""What is found under accounts equals what is found in the transfers repeated for their clients."""

import random

from pyspark.sql import functions as F

from probita.operators import grounding
from probita.operators import transactions as tx
from probita.plans import match_queries

TRANSFER = "position int, Time string, Date string, Sender_account string, Receiver_account string, Amount double, Is_laundering int"


def frames(spark):
    rng = random.Random(4)
    accounts = [str(1000000000 + k) for k in range(8)]
    rows = [(i, str(i % 3), f"2024-01-{i % 9 + 1:02}", f" {rng.choice(accounts)}" if i % 5 else None, rng.choice(accounts), rng.choice([None, 12.5, 999.25, 70.0]), i % 2) for i in range(80)]
    mapping = [(c, rng.choice(accounts) + " " * (c % 2)) for c in range(12) for _ in range(2)] + [(None, accounts[0]), (50, None), (51, "1")]
    return spark.createDataFrame(rows + rows[:9], TRANSFER), spark.createDataFrame(mapping, "client_id int, account string")


def test_largest_by_account_equals_largest_by_client(spark):
    transfers, mapping = frames(spark)
    expected = sorted(map(str, tx.largest_transfer(tx.client_transfers(transfers, mapping)).collect()))
    found = tx.largest_client_transfer(transfers, mapping)
    assert sorted(map(str, found.collect())) == expected and len(expected) > 8


def test_no_account_is_joined_with_all_its_clients_transfers(spark):
    """An account of many clients: formerly its transfers were a row for each of them."""
    transfers, _ = frames(spark)
    mapping = spark.range(200).selectExpr("cast(id as int) client_id", "'1000000001' account")
    assert tx.under_accounts(transfers, mapping).count() <= transfers.count()
    assert tx.largest_client_transfer(transfers, mapping).count() == 200


def test_totals_by_account_equal_those_by_client(spark):
    """Clients with several accounts, some with both of a transfer, and no client; every transfer of the eight accounts repeated for 200 more clients."""
    transfers, mapping = frames(spark)
    for owners in (mapping, mapping.unionByName(spark.range(200).selectExpr("cast(id + 100 as int) client_id", "'1000000001' account"))):
        expected = tx._totals(tx.client_transfers(transfers, owners), "client_id")
        rounded = [sorted(str(r) for r in t.withColumn("amount", F.round("amount", 2)).collect()) for t in (expected, tx.client_transfer_totals(transfers, owners))]
        assert rounded[0] == rounded[1] and len(rounded[0]) > 8


def test_totals_join_accounts_and_not_transfers(spark):
    """Where no client has two accounts, what meets the clients is a row for each account; formerly it was one for each transfer."""
    transfers, _ = frames(spark)
    mapping = spark.range(200).selectExpr("cast(id as int) client_id", "'1000000001' account")
    found = tx.client_transfer_totals(transfers, mapping)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert plan.count("Join") == 1 and "Aggregate [account" in plan[join:] and "Generate explode" in plan[plan.index("Aggregate [account"):]
    assert found.count() == 200


def test_citations_under_accounts_equal_those_under_clients(spark):
    transfers, mapping = frames(spark)
    texts = ["on 2024-01-03 paid", "paid 999.25", "12.5", "70.0|a", "a 1000000003", "nothing", "", None, "2024-01-99"]
    cited = spark.createDataFrame([(c * 100 + k, c if c < 14 else None, "transaction", t) for c in range(15) for k, t in enumerate(texts)],
                                  "citation_id int, client_id int, source_type string, source_id string")
    others = [spark.createDataFrame([], s) for s in ("client_id int", "name string, aliases string", "article_id string")]
    own = tx.client_transfers(transfers, mapping)
    made = [sorted(map(str, grounding.verify_citations(cited, others[0], transfers, own, others[1], others[2], *extra).select("citation_id", "reason", "status").collect())) for extra in ((), (mapping,))]
    assert made[0] == made[1] and len({line.split("status=")[1] for line in made[0]}) == 2


def test_entries_alike_meet_a_profile_once(spark, monkeypatch):
    """Copies of an entry add to its group and are no pairs of their own."""
    entries = spark.createDataFrame([(f"W-{i}", f"W-{i}", "red", ["bolt, red"] if i % 2 else None, None, None, "acme" if i % 4 else None, "x", None) for i in range(40)],
                                    "row_id string, entity_id string, name string, aliases array<string>, dob string, nationality string, company string, source_list string, context string")
    queries = spark.createDataFrame([("C-1", "red ring", None, None, "acme co", None), ("C-2", "red ring", "1970", None, "", None), ("C-3", None, None, None, None, None)],
                                    "entity_id string, name string, dob string, nationality string, company string, context string")
    monkeypatch.setattr(match_queries.tables, "watchlist", lambda spark, d: entries)
    monkeypatch.setattr(match_queries.tables, "screen_queries", lambda spark, d: queries)
    assert match_queries._alike_pairs(spark, "")[0].count() == 2
    found = {r.entity_id: (r.candidates, r.first_row, r.last_row) for r in match_queries.blocking_join(spark, "").collect()}
    assert found == {"C-1": (40, "W-0", "W-9"), "C-2": (40, "W-0", "W-9")}
    assert {r.entity_id: r.pairs for r in match_queries.name_similarity(spark, "").collect()} == {"C-1": 40, "C-2": 40}
    assert {r.entity_id: r.total for r in match_queries.company_similarity(spark, "").collect()}["C-2"] == 20.0
