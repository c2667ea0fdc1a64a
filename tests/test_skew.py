"""The skew helpers give the plain operator's rows, with and without heavy keys."""

import collections
import itertools

import pytest
from pyspark.sql import functions as F

from probita.operators import quality, skew
from probita.operators.skew import contains_join, dense_position, heavy_keys, skew_join


def frames(spark):
    left = spark.createDataFrame([(("hot" if i % 3 else f"k{i}"), i) for i in range(300)] + [(None, -1)], "k string, l int")
    right = spark.createDataFrame([("hot", i) for i in range(20)] + [(f"k{i}", i) for i in range(0, 300, 6)], "k string, r int")
    return left, right


def bag(df, columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("how,both", [("inner", False), ("inner", True), ("left", False)])
def test_skew_join_equals_join(spark, how, both):
    left, right = frames(spark)
    expected = bag(left.join(right, "k", how), ["k", "l", "r"])
    assert bag(skew_join(left, right, ["k"], how, both, share=10, floor=5), ["k", "l", "r"]) == expected
    assert bag(skew_join(left, right, ["k"], how, both), ["k", "l", "r"]) == expected
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "left", both=True)


def test_heavy_keys_are_few(spark):
    left, _ = frames(spark)
    assert {(r.k, r._parts) for r in heavy_keys(left, ["k"], share=10, floor=5).collect()} == {("hot", 7)}


def test_hot_rows_spread_over_tasks(spark):
    left, right = frames(spark)
    joined = skew_join(left, right.where("r < 1"), ["k"], share=10, floor=5, spread=True)
    tasks = joined.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_contains_join_equals_brute_force(spark):
    texts = ["", "a", "ab", "abc", "abcd", "bca", "xxabcx", "aaaa", "aa", "the old bolt", "old", "bolt the", "é", "né"]
    needles, hay = spark.createDataFrame([(t,) for t in texts], "needle string"), spark.createDataFrame([(t,) for t in texts], "haystack string")
    got = {(r.needle, r.haystack) for r in contains_join(needles, hay).collect()}
    assert got == {(n, h) for n, h in itertools.product(texts, texts) if n and n in h}
    by = contains_join(needles.withColumn("c", F.length("needle") % 2), hay.withColumn("c", F.length("haystack") % 2), by=["c"])
    assert {(r.needle, r.haystack) for r in by.collect()} == {(n, h) for n, h in got if len(n) % 2 == len(h) % 2}


def test_contains_join_with_a_piece_in_a_third_of_all_texts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[(i * 7919 + k * k * (i % 13 + 1)) % 26] for k in range(6))
    hay = [f"{word(i)} {i} bolt" if i % 3 == 0 else f"{word(i)} {i} {word(i * 31 + 5)}" for i in range(6000)]
    needles = ["bolt", "olt", *hay[1:400]]
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = contains_join(spark.createDataFrame([(t,) for t in needles], "needle string"), spark.createDataFrame([(t,) for t in hay], "haystack string"), share=10_000, floor=25)
        rows = found.select("needle", "haystack", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert collections.Counter((r.needle, r.haystack) for r in rows) == collections.Counter((n, h) for n in needles for h in hay if n in h)
    tasks = sorted(collections.Counter(r.task for r in rows).values())
    assert len(tasks) == 24 and tasks[-1] <= 4 * tasks[len(tasks) // 2]


def test_dense_position_equals_rank(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    numbered = dense_position(df, ["k"], F.floor(F.col("v") / 100), [F.col("v")])
    for key, rows in itertools.groupby(sorted((r.k, r.v, r.seq) for r in numbered.collect()), key=lambda r: r[0]):
        assert [r[2] for r in rows] == list(range(1, len([1 for i in range(500) if i % 3 == key]) + 1))


def test_duplicates_with_a_hot_id(spark):
    names = ["row_number", "client_id", "client_name", "client_type", "country", "sector", "sector_risk", "pep_flag", "sanctions_flag", "fatf_country_flag"]
    rows = [(i, "7" if i % 3 == 0 else ("" if i == 1 else str(100 + i)), "n", "NGO", "ae", "s", "low", "no", "0", "f") for i in range(30)]
    df = spark.createDataFrame(rows, names)
    for options in ({}, {"share": 5, "floor": 2}):
        found = quality.validate_batch(df, **options)
        assert found.count() == 30
        assert quality.entities(found).count() == 19
        assert quality.issues(found).where("issue_code = 'duplicate_client_id'").count() == 10


def test_contains_join_compares_few_texts_of_a_key_and_indexes_many(spark, monkeypatch):
    needles = [(i % 40, t) for i in range(200) for t in (f"txn:{i}", f"{i}")] + [(0, None), (0, ""), (None, "txn")] + [(99, f"n{i}") for i in range(30)]
    hay = [(i % 40, f"txn:{i * 3}") for i in range(200)] + [(0, None), (None, "txn:1")] + [(99, f"an{i} n{i * 2}") for i in range(30)]
    expected = collections.Counter((c, n, h) for c, n in set(needles) for d, h in set(hay) if c is not None and c == d and n and h and n in h)
    frames = [spark.createDataFrame(sorted(set(rows), key=str), f"c int, {name} string") for rows, name in ((needles, "needle"), (hay, "haystack"))]
    for few in (10_000, 200, 0):
        monkeypatch.setattr(skew, "FEW", few)
        assert bag(contains_join(*frames, by=["c"]), ["c", "needle", "haystack"]) == expected


def test_pieces_are_not_broadcast(spark):
    """The engine sizes pieces by the texts they are cut from, so that it would send very many to every executor."""
    texts = spark.range(500).select((F.col("id") % 50).alias("c"), F.concat(F.lit("txn:"), "id").alias("needle"))
    joined = contains_join(texts, texts.withColumnRenamed("needle", "haystack"), by=["c"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    on_pieces = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_piece" in line]
    assert all("LeftOuter" in line for line in on_pieces)  # the short lists of heavy pieces
