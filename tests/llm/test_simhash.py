import re

import numpy as np
import pytest
import xxhash
from corpus_cases import awkward, nothing

from probita.llm import simhash
from probita.llm.components import components
from probita.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + 4]).encode(), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id of each id's component, all pairs compared."""
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for at, a in enumerate(values):
        for b in values[at + 1:]:
            if (a ^ b).bit_count() <= 4:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, v in prints.items():
        least[top(v)] = min(least.get(top(v), i), i)
    return {i: least[top(v)] for i, v in prints.items()}


def test_query_against_all_pairs(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, FOLDER).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    whole = plain_components(prints)
    assert got == {i: (f"{v:016x}", whole[i]) for i, v in prints.items()}


@pytest.mark.parametrize("bits", [8, 16])
def test_links_connect_all_close_prints(spark, bits):
    random = np.random.default_rng(5)
    centres = random.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in random.choice(64, n, replace=False)) for c in centres for n in range(9)]
    signed = [int(np.uint64(v).astype(np.int64)) for v in near] + [0, -1]
    links = simhash.links(spark.createDataFrame([(v,) for v in [*signed, *signed, None]], "fp long"), prefix_bits=bits).collect()
    as_bits = lambda v: v & (1 << 64) - 1
    assert all(0 < (as_bits(r.u) ^ as_bits(r.v)).bit_count() <= 4 for r in links)
    parent = {v: v for v in signed}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in links:
        parent[max(top(r.u), top(r.v))] = min(top(r.u), top(r.v))
    for a in signed:
        for b in signed:
            if (as_bits(a) ^ as_bits(b)).bit_count() <= 4:
                assert top(a) == top(b)


def test_large_bucket_is_cut_into_slices(monkeypatch):
    random = np.random.default_rng(1)
    base = int(random.integers(0, 1 << 62))
    prints = np.array(sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 40, (60, 2))}), np.uint64)
    masks = [np.array(simhash.flips(48, r), np.uint64) for r in range(3)]
    buckets = prints >> np.uint64(48)
    whole = simhash._colliding(buckets, prints, 48, 2, masks)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 5_000)
    assert np.array_equal(whole, simhash._colliding(buckets, prints, 48, 2, masks))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] and len(by[1]) == 1
    assert {c for i in (3, 4, 5) for _, c in by[i]} == {3} and {f for i in (3, 4, 5) for f, _ in by[i]} == {"0" * 16}
    assert by[None] == {(next(iter(by[None]))[0], None)}
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    kept = simhash.deduplicated(docs)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, 7, 8, 9, None]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (None, 3), (2000, 2001), (2001, 2000)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 1000 for i in range(1001, 1100)}, 2001: 2000}
    assert components(edges.where("false")).count() == 0


def test_one_row_of_each_component_whatever_its_id(spark):
    clean = ["alpha beta gamma delta epsilon zeta", "one river runs past seven old mills", "quick red foxes jump over lazy dogs", "nobody knows what the winter will bring"]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (5, clean[2]), (5, clean[3]), (4, clean[3]), (6, clean[2])]
    kept = simhash.deduplicated(awkward(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", clean[0]), ("None", clean[1]), ("5", clean[2]), ("4", clean[3])])


def test_odd_distances_are_refused(spark):
    import pytest
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), distance=3)
