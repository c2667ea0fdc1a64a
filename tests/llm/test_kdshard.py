import zlib

from corpus_cases import awkward, nothing

from probita.llm import kdshard
from probita.llm.queries import QUERIES


def check(rows, sizes, shards, tolerance):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    assert all(sorted(r.slot for r in some) == list(range(len(some))) for some in by.values())
    weights = [sum(r.size for r in by.get(s, [])) for s in range(shards)]
    mean = sum(sizes) / shards
    assert max(weights) - min(weights) <= tolerance + 0.02 * mean


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op4_shards"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    check(got, [r.size for r in got], 16, 2 * max(r.size for r in got))


def test_one_text_in_a_third_of_all_rows_and_other_counts(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text number {i} " * (i % 7 + 1)) for i in range(3000)]
    docs = awkward(spark, rows)
    for shards in (1, 3, 7, 16):
        got = kdshard.assign(docs, shards).collect()
        check(got, [r.size for r in got], shards, 300)
    few = kdshard.assign(docs, target_bytes=20_000).collect()
    assert 3 <= len({r.shard for r in few}) <= 8


def test_copies_stay_together(spark):
    docs = awkward(spark, [(i, f"text {i // 2}") for i in range(2000)])
    got = kdshard.assign(docs, 4).collect()
    where = {}
    for r in got:
        where.setdefault(r.doc_id // 2, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    got = kdshard.assign(docs, 16).collect()
    assert len(got) == docs.count() and {(r.size, r.text_crc32) for r in got if r.doc_id in (3, 4)} == {(1, 0)}
    check(got, [r.size for r in got], 16, 10**7)
    assert kdshard.assign(nothing(spark), 16).count() == 0
    kdshard.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
