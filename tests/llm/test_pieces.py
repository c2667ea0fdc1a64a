import random

import numpy as np
import pytest
from corpus_cases import awkward, nothing

from probita.llm import pieces
from probita.llm.queries import QUERIES


def toy_model():
    """A unigram model with made-up pieces and scores, as the bytes of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    some, model, kinds = random.Random(3), proto.ModelProto(), proto.ModelProto.SentencePiece.Type
    names = set("abc") | {pieces.MARK}
    while len(names) < 40:
        names.add(some.choice(["", pieces.MARK]) + "".join(some.choices("abc", k=some.randint(1, 4))))
    rows = [("<unk>", 0.0, kinds.UNKNOWN), ("<s>", 0.0, kinds.CONTROL), *[(n, -round(some.uniform(1, 9), 3), kinds.NORMAL) for n in sorted(names)]]
    for name, score, kind in rows:
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = name, score, kind
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, False, True
    return model.SerializeToString()


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_n_best_like_the_library(n):
    from sentencepiece import SentencePieceProcessor

    raw, some = toy_model(), random.Random(n)
    library, model = SentencePieceProcessor(model_proto=raw), pieces.Model.parse(raw)
    score = lambda ids: sum(model.scores[i] if i else model.unknown_score for i in ids)
    texts = [" ".join("".join(some.choices("abc", k=some.randint(0, 6))) for _ in range(some.randint(1, 5))) for _ in range(80)] + ["a", "x", "abxc", "   "]
    for text, (ids, best, others) in zip(texts, pieces.Encoder(model, n).encode(texts), strict=True):
        if not text:
            continue
        theirs = library.nbest_encode_as_ids(text, nbest_size=n)
        mine = [ids.tolist(), *[pieces.applied(ids.tolist(), o["edits"]) for o in others]]
        assert len(mine) == len(theirs) == len({tuple(m) for m in mine})
        assert np.allclose([best, *[o["score"] for o in others]], [score(m) for m in mine])
        assert np.allclose(sorted(map(score, mine)), sorted(map(score, theirs)), atol=1e-3)


def test_every_segmentation_of_short_words():
    model = pieces.Model.parse(toy_model())
    known = {model.pieces[int(i)]: int(i) for i in model.ids[model.ids >= 0]}

    def ways(text):
        if not text:
            return [[]]
        return [[known[text[:k]], *rest] for k in range(1, len(text) + 1) if text[:k] in known for rest in ways(text[k:])]

    texts = ["abc", "aab b", "cabca", "b a c"]
    for text, (ids, best, others) in zip(texts, pieces.Encoder(model, 10_000).encode(texts), strict=True):
        every = sorted((sum(model.scores[i] for i in w) for w in ways(pieces.MARK + text.replace(" ", pieces.MARK))), reverse=True)
        assert np.allclose([best, *[o["score"] for o in others]], every)


def test_round_trips_and_ties():
    encoder = pieces.Encoder(pieces.Model.load(), 4)
    texts = ["Hello  world\nfoo\tbar é漢 ▁x ▁", "   ", "\n", "a" * 3000, " lead", "\U0001F600", "trail "]
    for text, (ids, _, _) in zip(texts, encoder.encode(texts), strict=True):
        assert encoder.decode(ids.tolist()) == text


def test_query_decodes_every_document(spark):
    got = QUERIES["op2_pieces"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got.count() == docs.count() and got.where("not round_trip or n_pieces <> size(ids)").count() == 0
    back = pieces.decode(got, pieces.Model.load(), name="back")
    assert back.join(docs, "doc_id").where("back <> text").count() == 0
    assert got.where("exists(alternatives, a -> a.score > score)").count() == 0


def test_awkward_rows(spark):
    model, docs = pieces.Model.load(), awkward(spark)
    got = pieces.encode(docs, model)
    assert got.count() == docs.count() and got.columns[: len(docs.columns)] == docs.columns
    assert [tuple(r)[-5:] for r in got.where("doc_id = 3").collect()] == [(0, None, 0.0, [], None)]
    assert [tuple(r)[-5:] for r in got.where("doc_id = 4").collect()] == [(0, [], 0.0, [], True)]
    assert got.where("not _round_trip").count() == 0 and pieces.encode(nothing(spark), model).count() == 0
    odd = spark.createDataFrame([([1, None, 10**6],), (None,)], "ids array<int>")
    assert [r.text for r in pieces.decode(odd, model).collect()] == ["<s>", None]


def test_long_texts_and_stretches():
    """Five million characters stay within some hundred MB, and a stretch without a blank is cut as its lattice says."""
    import resource

    some, model = random.Random(5), pieces.Model.load()
    encoder = pieces.Encoder(model, 3)
    text = " ".join(f"w{some.randrange(1 << 40):x}" for _ in range(450_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (ids, _, _), = encoder.encode([text])
    assert encoder.decode(ids) == text and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    stretch = "".join(some.choices("abcdefgh", k=3000))
    (ids, score, others), = pieces.Encoder(model, 3).encode([stretch])
    narrow = pieces.Lattice.of([pieces.MARK + stretch], model)
    best = {0: 0.0}
    for node in range(1, len(stretch) + 2):
        best[node] = max(best[int(a)] + float(w) for a, w in zip(narrow.start[narrow.end == node], narrow.score[narrow.end == node], strict=True))
    assert abs(best[len(stretch) + 1] - score) < 1e-6 and len(others) == 2
