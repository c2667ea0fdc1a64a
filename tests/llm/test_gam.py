import numpy as np
import pytest
from corpus_cases import awkward, nothing

from probita.llm import gam
from probita.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = QUERIES["op12_quality"](spark, FOLDER)
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.where("not score between 0 and 1 or predicted <> int(score >= 0.3) or held_out <> (crc32(string(doc_id)) % 5 = 0)").count() == 0
    judged = got.join(labels, "doc_id").where("held_out")
    assert judged.count() > 500 and judged.where("predicted = quality").count() >= 0.99 * judged.count()


def plain_score(tables, row):
    total = tables.constant + sum(tables.single[j][sum(c <= row[j] for c in cuts)] for j, cuts in enumerate(tables.cuts))
    place = lambda j: sum(c <= row[j] for c in tables.pair_cuts[j])
    return 1 / (1 + np.exp(-(total + sum(t[place(a)][place(b)] for (a, b), t in zip(tables.pairs, tables.double, strict=True)))))


def test_tables_learn_additions_and_interactions():
    some = np.random.default_rng(1)
    rows = np.round(some.normal(size=(4000, 4)), 2)
    rows[:, 3] = 7.0
    labels = ((rows[:, 0] * rows[:, 1] > 0) ^ (some.random(4000) < 0.02)).astype(float)
    alone, paired = (gam.boosted(rows, labels, 40, pairs, 60) for pairs in (0, 2))
    right = lambda t: ((t.scores(rows) > 0.5) == labels).mean()
    assert right(alone) < 0.65 and right(paired) > 0.9 and (0, 1) in paired.pairs
    again = gam.Tables.read(paired.dumped())
    assert np.allclose(again.scores(rows[:50]), [plain_score(paired, r) for r in rows[:50]])
    assert gam.boosted(rows, np.ones(4000)).scores(rows).min() > 0.9 and gam.boosted(rows[:0], labels[:0]).scores(rows[:2]).tolist() == [0.5, 0.5]


def test_measures_of_whole_texts():
    said = dict(zip(gam.MEASURES, gam.measures("The THE the a1 a1\n\nThe end!\nThe end!"), strict=True))
    assert said["distinct_lines"] == pytest.approx(2 / 3) and said["repeated_neighbours"] == pytest.approx(1 / 8) and said["top_word"] == pytest.approx(1 / 3)
    assert gam.measures(None) == gam.measures("") == [0.0] * len(gam.MEASURES) and len(gam.measures(" \n\t")) == len(gam.MEASURES)
    assert gam.measures("é " * (3 << 20))[0] == pytest.approx(np.log1p(9 << 20))


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, q, "clash") for i, q in [(1, 1), (1, 0), (2, 1), (3, 0), (4, None), (None, 1), (77, 1), (7, 3)]], "doc_id long, quality int, text string")
    got = gam.score(docs, labels, keep=docs.columns).collect()
    assert len(got) == docs.count() and all(0 <= r[-2] <= 1 for r in got) and len(got[0]) == len(docs.columns) + 3
    assert len({r[-2] for r in got if r.doc_id in (3, 4)}) == 1
    assert {r.score for r in gam.score(docs, labels.where("false")).collect()} == {0.5}
    assert gam.score(nothing(spark), labels).count() == 0
