"""Golden values of name similarity and entity resolution, and the rules around them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from probita.functions import scalars as S
from probita.functions import similarity as sim
from probita.operators import matching, tally

NAME_PAIRS = [
    ("Oluwaseun Adeyemi", "Oluwaseyi Adeyemi"), ("Adeyemi, Oluwaseun", "Oluwaseun Adeyemi"), ("Brunhilde Kestrel", "B. Kestrel"), ("Tern Island Shipping GmbH", "ISLAND"),
    ("Quartz Peak Logistics", "PEAK QUARTZ LOGISTIC SERVICES"), ("Fjord Foods", "Zebra Kilns"), ("", "x"), (None, "x"), ("same", "SAME"), ("--", "!!"),
]
WATCH = "row_id string, entity_id string, name string, aliases array<string>, dob string, nationality string, company string, source_list string, context string"
TRUE_ENTRY = ("w1", "L-77", "Oluwaseyi Adeyemi", ["O. Adeyemi"], "1968", "Nigeria", "Harbour Cranes", "OFAC SDN", "Owner of crane yards with corporate links in Lagos")
FALSE_ENTRY = ("w2", "L-78", "Ines Duarte", [], "1984", "Portugal", "Cork and Tile", "OFAC SDN", "Ceramics dealer based in Porto")
QUERY = "entity_id string, name string, dob string, nationality string, company string, context string, evidence_id string"
TRUE_QUERY = ("C-1", "Oluwaseun Adeyemi", "1968", "Nigeria", "Harbour Cranes", "Owner at Harbour Cranes", "E-9")
FALSE_QUERY = ("C-2", "Ines Duarte", "1991", "Spain", "Duarte Sisters SL", "Tax adviser based in Madrid", None)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_similarity(a, b):
    """Greater of the two ratios by the textbook table."""
    if not a or not b:
        return 0.0
    a, b = a.lower(), b.lower()
    ratio = lambda x, y: 1.0 if x == y else 2.0 * lcs(x, y) / (len(x) + len(y))
    return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def test_similarity_values(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(NAME_PAIRS)], "i int, a string, b string")
    rows = df.select("i", sim.similarity("a", "b").alias("s")).orderBy("i").collect()
    for row, (a, b) in zip(rows, NAME_PAIRS):
        assert row.s == pytest.approx(plain_similarity(a, b), abs=1e-9), (a, b)


def test_ratio_equals_plain_table_for_all_lengths():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 2, 5, 31, 32, 63, 64, 65, 100, 600)]
    pairs = list(itertools.product(texts, texts))
    got = sim._ratios([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), value in zip(pairs, got):
        assert value == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)))


def test_true_and_false_pair(spark):
    queries = spark.createDataFrame([TRUE_QUERY, FALSE_QUERY], QUERY)
    entries = spark.createDataFrame([TRUE_ENTRY, FALSE_ENTRY], WATCH)
    distinct, keyed = matching.profiles(queries)
    scored = keyed.join(matching.evaluate(matching.blocking_pairs(distinct, entries)).withColumnRenamed("q_profile_id", "profile_id"), "profile_id")
    rows = {r.entity_id: r for r in scored.collect()}
    good, bad = rows["C-1"], rows["C-2"]
    assert (good.s_dob, good.s_nationality, good.s_company) == (1.0, 1.0, 1.0)
    by_hand = {
        "C-1": (plain_similarity(TRUE_QUERY[1], TRUE_ENTRY[2]), plain_similarity(TRUE_QUERY[1], TRUE_ENTRY[3][0]), 1.0, 1.0, 1.0, plain_similarity(TRUE_QUERY[5], TRUE_ENTRY[8])),
        "C-2": (1.0, 0.0, 0.0, 0.0, plain_similarity(FALSE_QUERY[4], FALSE_ENTRY[6]), 0.3),  # its context can't change the class and isn't compared
    }
    for key, scores in by_hand.items():
        assert rows[key].match_score == round(sum(w * x for w, x in zip((0.30, 0.15, 0.15, 0.10, 0.15, 0.15), scores)), 4)
    assert good.classification in ("POSSIBLE_MATCH", "CONFIRMED_MATCH") and bad.classification == "LIKELY_FALSE_POSITIVE"
    found = matching.screen(queries, entries).collect()
    assert [(r.entity_id, r.matched_against, r.evidence_id, r.candidates_scored) for r in found] == [("C-1", "L-77", "E-9", 1)]


def test_pruned_screen_equals_full_evaluation(spark):
    """The bounds never lose a pair that reaches the threshold."""
    rng = random.Random(5)
    names = ["ali reza hosseini", "ali hoseini", "reza ali", "alina petrov", "ali", "alib corp", "al ibrahim"]
    def some(values):
        return rng.choice(values)
    queries = [(f"Q{i}", some(names), some([None, "1975", "15 Mar 1975"]), some([None, "UAE", "iran"]), some([None, "", "ali corp", "abc"]),
                some([None, "trader in metals", "banker"]), None) for i in range(60)]
    entries = [(f"w{i}", f"W{i}", some(names), rng.sample(names, rng.randint(0, 2)), some([None, "1975-03-15", "1980"]), some([None, "AE", "IR"]),
                some([None, "ali corp ltd"]), "x", some([None, "metal trader"])) for i in range(60)]
    q, w = spark.createDataFrame(queries, QUERY), spark.createDataFrame(entries, WATCH)
    distinct, keyed = matching.profiles(q)
    full = matching.evaluate(matching.blocking_pairs(distinct, w)).where("match_score >= 0.55").withColumnRenamed("q_profile_id", "profile_id")
    expected = {(r.entity_id, r.w_row_id, r.match_score) for r in keyed.join(full, "profile_id").collect()}
    for options in ({}, {"share": 5, "floor": 3}):
        got = {(r.entity_id, r.row_id, r.match_score) for r in matching.screen(q, w, None, **options).collect()}
        assert got == expected and len(got) > 20


def many_alike(spark, copies):
    """Entries of which many are alike, with few and with no profiles that fill their list from the nearest of them."""
    rng = random.Random(11)
    names = ["ali reza hosseini", "ali hoseini", "reza ali", "alib corp"]
    kinds = [(rng.choice(names), [rng.choice(names)] if k % 3 else [], rng.choice([None, "1975", "1980", "15 Mar 1975"]), rng.choice([None, "AE", "IR"]),
              rng.choice([None, "ali corp ltd", "ali co"]), "x", rng.choice([None, "metal trader", "trader"])) for k in range(30)]
    entries = [(f"w{i:04}", f"W{(i * 37) % 1000 // 2}", *kinds[i * i % 30 if i % 2 else i % 30]) for i in range(copies)]
    queries = [(f"Q{i}", rng.choice(names), rng.choice([None, "1975", "1980"]), rng.choice([None, "AE", "iran", "PT"]), rng.choice([None, "ali corp", "abc"]),
                rng.choice([None, "trader in metals", "metal trader"]), None) for i in range(40)]
    return spark.createDataFrame(queries, QUERY), spark.createDataFrame(entries, WATCH)


@pytest.mark.parametrize("limit", [1, 5, 25])
def test_first_matches_equal_full_evaluation(spark, limit):
    """Floors and classes never lose or reorder one of the first matches, ties included."""
    q, w = many_alike(spark, 300)
    distinct, keyed = matching.profiles(q)
    full = matching.evaluate(matching.blocking_pairs(distinct, w)).where("match_score >= 0.55").withColumnRenamed("q_profile_id", "profile_id")
    rows = sorted((r.entity_id, -r.match_score, r.w_entity_id, r.w_row_id) for r in keyed.join(full, "profile_id").collect())
    expected = {(e, row[1:], at + 1) for e, own in itertools.groupby(rows, key=lambda r: r[0]) for at, row in enumerate(own) if at < limit}
    got = matching.screen(q, w, limit).collect()
    assert {(r.entity_id, (-r.match_score, r.matched_against, r.row_id), r["rank"]) for r in got} == expected and len(got) == len(expected)
    assert len(expected) > 20


def test_pairs_below_the_floor_are_never_rows(spark, monkeypatch):
    """Twice the entries: no more pairs, where formerly each entry over the threshold was one."""
    made = []
    real = matching._first_entries
    monkeypatch.setattr(matching, "_first_entries", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    for copies in (300, 600):
        q, w = many_alike(spark, copies)
        matching.screen(q, w, 3).count()
    assert made[1] <= made[0] <= 40 * 30


def test_reordered_query_is_found(spark):
    keys = spark.createDataFrame([("Rashid, Mohammad", "Mohammad Al-Rashid")], "q string, w string").select(
        S.query_keys("q").alias("q"), S.index_keys("w", F.array().cast("array<string>")).alias("w")).first()
    assert set(keys.q) & set(keys.w) == {"moha"}


def test_dates_and_countries(spark):
    rows = spark.createDataFrame([("1975-03-15",), ("15 Mar 1975",), ("1975",), ("mar 1975",), ("15 Foo 1975",), ("none",)], "t string").select(
        S.birth_date("t").alias("d")).collect()
    assert [tuple(r.d) if r.d else None for r in rows] == [(1975, 3, 15), (1975, 3, 15), (1975, None, None), (1975, 3, None), (1975, None, None), None]
    match = spark.createDataFrame([("1975", "15 Mar 1975", "UAE", "AE"), ("1980", "1975-01-01", "UK", "India"), ("", None, None, "US")], "a string, b string, c string, d string")
    assert [tuple(r) for r in match.select(S.dob_match("a", "b"), S.country_match("c", "d")).collect()] == [(1.0, 1.0), (0.0, 0.0), (0.5, 0.5)]


def test_name_alone_never_confirms(spark):
    df = spark.createDataFrame([(0.9, 0.5, 0.5, 0.5, 0.3), (0.9, 1.0, 0.5, 0.5, 0.3), (0.6, 1.0, 1.0, 1.0, 1.0)], "s double, dob double, nationality double, company double, context double")
    parts = {p: F.col(p) for p in ("dob", "nationality", "company", "context")}
    assert [r[0] for r in df.select(matching.decision(F.col("s"), parts)).collect()] == ["needs_review", "confirmed_match", "likely_match"]


def test_every_pair_is_scored_by_classes_and_texts_compared_once(spark, monkeypatch):
    """Sums over classes equal those over pairs, and Python sees a pair of texts once, not once per pair of rows."""
    q, w = many_alike(spark, 120)
    distinct, keyed = matching.profiles(q)
    full = matching.evaluate(matching.blocking_pairs(distinct, w))
    parts = [f"s_{p}" for p in matching.PARTS]

    def summed(pairs, n):
        rows = pairs.groupBy("q_profile_id", "classification").agg(
            F.sum(n).alias("n"), F.max("match_score").alias("best"), *[F.sum(F.col(c) * n).alias(c) for c in ("match_score", *parts)]).collect()
        return {(r.q_profile_id, r.classification): [r.n, r.best, *[round(r[c], 6) for c in ("match_score", *parts)]] for r in rows}

    made = []
    similarity = matching._written_texts
    monkeypatch.setattr(matching, "_written_texts", lambda *a: made.append(similarity(*a)) or made[-1])
    pairs, again = matching.every_pair(q, w)
    assert summed(matching.evaluate(pairs), F.col("w_n")) == summed(full, F.lit(1))
    assert pairs.count() < full.count() / 2
    assert [t.count() for t in made] == [t.distinct().count() for t in made] and all(t.count() < 20 for t in made)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, keyed.collect()), key=str)


def test_name_scores_equal_those_of_pairs(spark):
    q, w = many_alike(spark, 120)
    distinct, keyed = matching.profiles(q)
    full = matching.component_scores(matching.blocking_pairs(distinct, w)).where("s_alias >= 0.5").withColumnRenamed("q_profile_id", "profile_id")
    want = sorted((r.entity_id, r.w_row_id, r.s_name, r.s_alias) for r in keyed.join(full, "profile_id").collect())
    for options in ({}, {"share": 5, "floor": 3}):
        got = matching.name_scores(q, w, F.col("s_alias") >= 0.5, **options).collect()
        assert sorted((r.entity_id, r.row_id, r.s_name, r.s_alias) for r in got) == want and want


def test_tallies_equal_those_of_pairs(spark):
    """Blocks and cells leave out no pair and count none twice, NULLs and dates in parts included."""
    q, w = many_alike(spark, 120)
    q = q.unionByName(q.limit(9).withColumns({"entity_id": F.concat("entity_id", F.lit("n")), "dob": F.lit("sometime"), "company": F.lit("")}))
    w = w.unionByName(w.limit(9).withColumns({"row_id": F.concat("row_id", F.lit("n")), "dob": F.lit("sometime"), "context": F.lit(None).cast("string")}))
    distinct, keyed = matching.profiles(q)
    full = matching.evaluate(matching.blocking_pairs(distinct, w)).groupBy(F.col("q_profile_id").alias("profile_id")).agg(
        *[F.count(F.when(F.col("classification") == c, 1)).alias(f"n{k}") for k, c in enumerate(tally.CLASSES)],
        *[F.max(F.when(F.col("classification") == c, F.col("match_score"))).alias(f"best{k}") for k, c in enumerate(tally.CLASSES)],
        F.sum("match_score").alias("total"), *[F.sum(f"s_{p}").alias(f"s_{p}") for p in matching.PARTS])
    columns = ["profile_id", *[f"{c}{k}" for c in ("n", "best") for k in range(3)], "total", *[f"s_{p}" for p in matching.PARTS]]

    def said(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())

    want = said(full)
    assert want and any(r[1] for r in want) and any(r[3] for r in want)
    for options in ({}, {"few": 150}, {"few": 0, "profiles": 2, "entries": 3, "share": 5, "floor": 3}):
        got, again = tally.tallies(q, w, **options)
        assert said(got) == want and again.count() == q.count()


def test_scores_are_summed_without_a_row_per_pair(spark, monkeypatch):
    """Entries that differ in date and country only meet a profile as counts: profiles times entries are never rows."""
    seen = []
    real = tally._block
    q, w = many_alike(spark, 300)
    pairs, _ = matching.every_pair(q, w)
    wide = pairs.count()
    tables = spark.sparkContext.accumulator(0)

    def block(left, right):
        tables.add(left.num_rows + right.num_rows)
        return real(left, right)

    monkeypatch.setattr(tally, "_block", block)
    seen.append(tally.tallies(q, w, few=0)[0].count())
    assert seen[0] and 0 < tables.value < wide / 2
