import numpy as np
from pyspark.sql import functions as F

from probita.llm import negatives
from probita.llm.queries import QUERIES

NAN = float("nan")


def plain(rows, every=100, k=5):
    fine = {(i, lab, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    fine = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in fine]
    out = []
    for i, lab, v in fine:
        if i % every:
            continue
        said = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m == lab) for j, m, w in fine if j != i)
        for score, j, same in [x for x in said if x[2]][:k]:
            band = [(s, n) for s, n, own in said if not own and -80 * score <= -100 * s <= -100 * score][:k]
            out += [(i, j, rank, n, -score, -s) for rank, (s, n) in enumerate(band, 1)]
    return sorted(out)


def rows_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]


def test_query_against_every_pair(spark):
    folder = "/root/testdata/sf0.1"
    got = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, folder).collect()))
    assert got and got == plain(rows_of(spark, folder))


def test_awkward_rows(spark):
    some = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in some.normal(size=6)], int(some.integers(3))) for i in range(-50, 260)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5, 0.1, 0.9], i % 2) for i in range(150)] + rows[:40]  # copies, ties and repeated rows
    rows += [(300, None, 1), (400, [0.0] * 6, 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (600, [NAN] * 6, 1), (700, [1.0] * 6, None), (None, [1.0] * 6, 1), (800, [float("inf")] * 6, 1)]
    kinds = "vec_id long, embedding array<float>, label int, anchor string, block string, slab string, cluster string, v string, id string, bands string"
    table = spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], kinds)
    mine = lambda t, **more: negatives.mine(negatives.relabelled(t), F.col("id") % 100 == 0, **more)
    wanted = plain(rows)
    assert len({r[0] for r in wanted}) > 3 and sorted(map(tuple, mine(table).collect())) == wanted
    assert sorted(map(tuple, mine(table, clusters=3, sample=4).collect())) == wanted
    odd = spark.createDataFrame([(100, [1.0, 2.0], 1, *["clash"] * 7)], kinds)
    assert sorted(map(tuple, mine(table.unionByName(odd)).collect())) == wanted  # another length takes no part
    for empty in (table.where("false"), table.where("label is null"), table.where("vec_id = 1")):
        assert mine(empty).count() == 0 and mine(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_walks_end_early_and_miss_nothing():
    some = np.random.default_rng(5)
    centres = np.eye(8)[:2]
    vectors = np.floor(256 * some.normal(size=(20_000, 8)) * some.exponential(size=(20_000, 1))).astype(np.int64)
    ids, labels = np.arange(20_000), some.integers(0, 4, 20_000)
    anchors = np.floor(256 * (centres[0] + 0.05 * some.normal(size=(6, 8)))).astype(np.int64)
    spread = np.array([negatives._angles(anchors.astype(float), centres[:1]).max() + 1e-6, 0.0])
    block = negatives.Block(ids, labels, vectors, centres, spread)
    seen = []
    scores = block.scores
    block.scores = lambda a, rows: seen.append(len(rows)) or scores(a, rows)
    who, _, found, _ = negatives.walk(block, 0, anchors, np.full(6, -1), np.zeros(6, np.int64), None, 5)
    for a in range(6):
        own = np.flatnonzero(labels == 0)
        assert found[who == a].tolist() == own[np.lexsort((own, -(vectors[own] @ anchors[a])))][:5].tolist()
    assert sum(seen) < 10_000


def test_large_components():
    block = negatives.Block(np.arange(2), np.zeros(2, int), np.array([[1 << 29, 3], [1 << 29, 2]]), np.eye(2), np.zeros(2))
    assert block.scores(np.array([[1 << 30, 1]]), np.array([0, 1])).tolist() == [[(1 << 59) + 3, (1 << 59) + 2]]
