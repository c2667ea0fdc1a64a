import random

import numpy as np
import pytest
from corpus_cases import awkward, nothing

import corpus_pipeline
from probita.llm import jaccard, simhash


def plain_shingles(text):
    said = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(said[i:i + 5]) for i in range(max(1, len(said) - 4))}


def near_texts():
    some = random.Random(3)
    rows = []
    for family in range(12):
        base = [f"w{some.randrange(400)}" for _ in range(200 if family % 2 else 500)]
        rows.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 6, 8, 10, 12):
            copy = list(base)
            for at in some.sample(range(len(base)), changes):
                copy[at] = f"new{some.randrange(10 ** 6)}"
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def plain_kept(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i for i in sets if top(i) == i}


def test_stage_against_brute_force(spark):
    rows = near_texts()
    want = plain_kept(rows)
    assert 12 < len(want) < len(rows)
    kept = corpus_pipeline.near_duplicates(spark, awkward(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_stage_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, 7, 8, 9, None]
    assert jaccard.deduplicated(nothing(spark)).count() == 0


def test_parity_maps_differ_in_no_more_bits_than_the_sets_in_shingles():
    some = np.random.default_rng(7)
    for size in (1, 5, 146, 3_000, 40_000):
        base = some.integers(0, 1 << 63, size, dtype=np.uint64)
        for changed in (0, 1, size // 9, size // 2, size):
            other = np.concatenate([base[changed:], some.integers(0, 1 << 63, changed + 1, dtype=np.uint64)])
            a, b = np.unique(base), np.unique(other)
            differ = len(np.setxor1d(a, b))
            maps = [jaccard.parity(x).view(np.uint64)[None, :] for x in (a, b)]
            assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= differ
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                assert jaccard._possible(np.array([len(a)]), np.array([len(b)]), *maps).all()


def one_group():
    """Copies of one text with up to eight words changed: many share a bucket and stay unlinked."""
    some = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(240):
        copy = list(base)
        for at in some.sample(range(150), n % 9):
            copy[at] = f"x{some.randrange(10 ** 6)}"
        rows.append(" ".join(copy))
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [7, 1024])
def test_large_group_in_tiles_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = one_group()
    want = plain_kept(rows)
    assert 20 < len(want) < 200
    assert {r.doc_id for r in jaccard.deduplicated(awkward(spark, rows)).collect()} == want


def test_every_pair_of_a_bucket_meets_in_one_tile_only():
    some = np.random.default_rng(2)
    fp, side = np.arange(40), some.integers(0, 3, 40)
    size, least, maps = np.full(40, 10), np.zeros((40, jaccard.BANDS * jaccard.ROWS), np.uint8), np.zeros((40, jaccard.PARITY // 64), np.uint64)
    met = []
    for low in range(3):
        for high in range(low, 3):
            in_ = (side == low) | (side == high)
            for pairs in jaccard._tile(0, low != high, side[in_], fp[in_], fp[in_], size[in_], least[in_], maps[in_]):
                met += list(zip(*pairs.tolist(), strict=True))
    assert sorted(met) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert not jaccard._tile(1, False, side, fp, fp, size, least, maps), "the pair is left to the first band that it shares"


def test_ball_hashing_of_fingerprints_links_before_minima_do(spark, monkeypatch):
    """Pairs at most four bits apart are linked by ball hashing alone, and what it links the minima don't compare again."""
    rows = near_texts()
    assert all(jaccard.fingerprint(jaccard.occurrences(t)) == simhash.fingerprint(t, jaccard.WORDS) for _, t in rows[:20] + [(0, "a b"), (1, "A b c d E f")])
    seen, close = [], jaccard._close
    monkeypatch.setattr(jaccard, "_close", lambda pairs, sketched: seen.append(close(pairs, sketched)) or seen[-1])
    jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count()
    by_print, by_minima = ({(r.u, r.v) for r in part.collect()} for part in seen)
    print_of = {int(jaccard._signed([jaccard.xxhash.xxh64_intdigest(jaccard.shingles(t).tobytes(), jaccard.SEED)])[0]): simhash.fingerprint(t, jaccard.WORDS) for _, t in rows}
    assert len(by_print) > 10 and all((print_of[u] ^ print_of[v]).bit_count() <= simhash.DISTANCE for u, v in by_print)
    assert by_minima and not by_print & by_minima
