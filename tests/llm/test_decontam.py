import hashlib

from corpus_cases import awkward, nothing
from oracle_check import compare, duck

from probita.llm import decontam, queries
from probita.plans import registry

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_query_matches_sql(spark, monkeypatch):
    monkeypatch.setattr(registry, "queries", lambda: queries.QUERIES)
    monkeypatch.setattr(registry, "oracle_sql", lambda: queries.SQL)
    folder = "/root/testdata/sf0.001"
    assert compare(spark, duck(folder), "op6_decontamination", folder) is None


def test_words_take_all_beyond_ascii_and_fold_only_ascii():
    assert decontam.words("Ab-C9_É é\x00x") == [b"ab", b"c9", "É".encode(), "é".encode(), b"x"]
    assert decontam.words(None) == decontam.words(" .,") == []


def test_windows_short_items_and_the_rule(spark):
    docs = spark.createDataFrame([(1, f"start {ITEM.upper()} end"), (2, "alpha beta gamma delta"), (3, "short item"), (4, "a short item b " + "z " * 100), (5, None), (6, ITEM.replace("mu", "MU!"))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.scan(docs, items(spark, [(10, ITEM), (2, "short item"), (7, None), (8, ""), (None, "delta")])).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (17, 15, ["10"]) and got[1].contaminated
    assert (got[2].n_hit, got[2]["items"], got[2].n_items) == (1, [], 0)  # an item without a name hits, and isn't listed
    assert (got[3].n_hit, got[3].contaminated) == (2, True)
    assert (got[4].n_hit, got[4].contaminated) == (2, False)
    assert (got[5].n_words, got[5].n_hit, got[5].contaminated) == (0, 0, False)
    assert got[6].n_hit == 15


def test_phrases_do_not_cross_documents_or_shards(spark):
    half = ITEM.split()
    docs = spark.createDataFrame([(1, " ".join(half[:8])), (2, " ".join(half[8:])), (3, ITEM), (4, ITEM)], "doc_id long, text string").coalesce(1)
    for size in (1, 10, 100):
        got = {r.doc_id: r.n_hit for r in decontam.scan(docs, items(spark, [(1, ITEM)]), shard_words=size).collect()}
        assert got == {1: 0, 2: 0, 3: 15, 4: 15}


def test_proximity_tolerates_shifts(spark):
    words = ITEM.split()
    docs = spark.createDataFrame([(1, " ".join([*words[:6], "other", *words[6:]])), (2, " ".join([*words[:6], *["other"] * 9, *words[6:]]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.near) for r in decontam.scan(docs, items(spark, [(1, ITEM)])).collect()}
    assert got == {1: (0, ["1"]), 2: (0, [])}


def test_blocks_of_items_give_the_same_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near)) for r in df.collect())
    assert key(decontam.scan(docs, bench)) == key(decontam.scan(docs, bench, block_bytes=600, shard_words=3000))


def test_awkward_rows(spark):
    docs, bench = awkward(spark), items(spark, [(1, "two three four")])
    got = decontam.scan(docs, bench)
    assert got.count() == docs.count() and {r.n_hit for r in got.where("doc_id in (1, 2)").collect()} == {3}
    assert decontam.scan(nothing(spark), bench).count() == 0
    assert decontam.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 5, 6, 7, 8, 9, None]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
