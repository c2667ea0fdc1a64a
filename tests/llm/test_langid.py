import collections
import math
import re

import numpy as np
from corpus_cases import awkward, nothing

from probita.llm import langid
from probita.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op3_language"](spark, folder).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    both = got.join(docs)
    assert len(both) == len(docs) and both.score.between(0, 1).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.97
    assert both.rejected.mean() < 0.01


def test_split_is_by_checksum(spark):
    import zlib

    got = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", langid.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ein Fuchs, zwei Füchse und drei Gänse! " * 50
    whole = langid.counts(text)
    assert whole.sum() > 3000 and (langid.counts(text.upper()) == whole).all()
    assert (langid.counts("12 34 --") == langid.counts("  ")).all()


def test_foreign_scripts_are_rejected_and_short_texts_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    languages, scores, rejected = model.nearest(["Это предложение написано по-русски " * 8, "这是一个用中文写的句子" * 30, "The", None, "12 + 34", ""])
    assert rejected.tolist() == [True, True, False, True, True, True]
    assert languages[3:] == ["und"] * 3 and (scores[3:] == 0).all()


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = langid.fit(docs)
    assert model.languages == ["en"] * len(model.languages) and 1 <= len(model.languages) <= langid.CENTROIDS
    got = langid.predict(docs, model)
    assert got.count() == docs.count() and got.columns[: len(docs.columns)] == docs.columns
    assert got.columns[-3:] == langid.found_names(docs.columns) == ["_lang_pred", "_score", "_rejected"]
    assert {r["_lang_pred"] for r in got.where("doc_id in (3, 4, 5)").collect()} == {"und"}
    assert langid.predict(nothing(spark), model).count() == 0
    unlearned = langid.fit(nothing(spark))
    assert unlearned.languages == [] and langid.predict(docs, unlearned, keep=["doc_id"]).where("not rejected").count() == 0


def test_clusters_of_equal_rows():
    rows = np.ones((5, 4), np.float32) / 2
    assert np.allclose(langid._clusters(rows, 4), rows[:4])


def plain_grams(text, dimensions):
    """Counts by place of the letter groups of a text, one by one."""
    spaced = re.sub("[\x00-\x40\x5b-\x60\x7b-\x7f]+", " ", f" {text.lower()} ")
    grams = [spaced[i:i + n] for n in (1, 2, 3) for i in range(len(spaced) - n + 1) if spaced[i:i + n] != " "]

    def place(gram):
        h = 0
        for k, c in enumerate(gram):
            if k:
                h = (h ^ (h >> (29 if k == 1 else 31))) * (0xBF58476D1CE4E5B9 if k == 1 else 0x94D049BB133111EB)
            h = (h + ord(c) * 0x9E3779B97F4A7C15) % 2**64
        return (h >> 40) % dimensions

    return collections.Counter(place(g) for g in grams)


def test_answers_against_vectors_by_dictionary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held", langid.held_out())
    model = langid.fit(docs.where(~langid.held_out()))
    rows = docs.collect()
    counted = {r.doc_id: plain_grams(r.text or "", langid.DIMENSIONS) for r in rows}
    learned = [r.doc_id for r in rows if not r.held and r.lang is not None and langid.has_letter(r.text)]
    seen = collections.Counter(d for i in learned for d in counted[i])
    idf = [math.log((1 + len(learned)) / (1 + seen[d])) + 1 for d in range(langid.DIMENSIONS)]
    assert np.allclose(idf, model.idf, atol=1e-5)
    got = {r.doc_id: r for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    for r in rows:
        if not langid.has_letter(r.text):
            assert got[r.doc_id].lang_pred == langid.UNDETERMINED
            continue
        weights = {d: math.log(1 + n) * idf[d] for d, n in counted[r.doc_id].items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        near = [sum(w * c[d] for d, w in weights.items()) / norm for c in model.centroids.astype(float)]
        best = max(range(len(near)), key=near.__getitem__)
        assert abs(got[r.doc_id].score - near[best]) < 1e-4
        assert got[r.doc_id].lang_pred == model.languages[best] or sorted(near)[-1] - sorted(near)[-2] < 1e-5
        limit = model.least[best] * min(1, sum(counted[r.doc_id].values()) / langid.EVIDENCE)
        assert got[r.doc_id].rejected == (near[best] < limit) or abs(near[best] - limit) < 1e-5
