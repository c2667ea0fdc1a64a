"""Operators that leave work out by a bound, or by making rows distinct first, against plain versions that leave out nothing."""

import random

from pyspark.sql import functions as F

from probita.operators import media, risk, transactions


def test_regulation_search_against_every_paragraph(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    paragraphs = [(p, f"a{p}", f"title {p % 3}", " ".join(rng.choices(words, weights, k=rng.randint(0, 25))), rng.choice(["", None, "the w0 w1"])) for p in range(400)]
    queries = [(q, " ".join(rng.choices(words, weights if q % 2 else None, k=rng.randint(0, 12)))) for q in range(60)] + [(100, "absent words only"), (101, None), (102, "w0"), (103, "w0 W0 w1!")]
    table = spark.createDataFrame(paragraphs, "position long, article_id string, article_title string, article_text string, article_recitals string")
    got = media.search_regulation(spark.createDataFrame(queries, "query_id long, query string"), table, 3)
    first = {}
    for p, _, title, text, more in paragraphs:
        first.setdefault(text, (p, set(f"{title} {text} {more or ''}".split())))
    expected = set()
    for q, text in queries:
        asked = {w.strip("!").lower() for w in (text or "").split()}
        scores = sorted((-int(len(asked & held) / len(asked) * 100), p) for p, held in first.values() if asked & held)
        expected |= {(q, p, -s, rank) for rank, (s, p) in enumerate([x for x in scores if x[0] < 0][:3], 1)}
    assert {(r.query_id, r.position, r.score, r["rank"]) for r in got.collect()} == expected and len(expected) > 100


def test_transfers_once_per_client(spark):
    rng = random.Random(6)
    accounts = [*"ABCDE", None, " A"]
    rows = [(str(rng.randint(1, 2)), "t", rng.choice(accounts), rng.choice(accounts), float(rng.randint(1, 2)), rng.randint(0, 1), i) for i in range(300)]
    owners = [("c1", "A"), ("c1", "B"), ("c2", "B "), ("c3", "E"), ("c1", "A"), ("c4", "none"), ("c2", None)]
    got = transactions.client_transfers(spark.createDataFrame(rows, "Date string, Time string, Sender_account string, Receiver_account string, Amount double, Is_laundering int, position long"),
                                        spark.createDataFrame(owners, "client_id string, account string"))
    trim = lambda x: None if x is None else x.strip(" ")
    expected = {}
    for client, account in owners:
        for r in rows:
            if account is not None and trim(account) in (trim(r[2]), trim(r[3])):
                expected[client, *r[:5]] = min(expected.get((client, *r[:5]), r[5:]), r[5:])
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame([(*k, *v) for k, v in expected.items()], got.schema).collect())


def test_all_accounts_and_clients_are_dealt(spark):
    rows = [(f"s{i % 700}", i % 2, i * 50_000) for i in range(2000)]
    seen = transactions.first_seen_accounts(spark.createDataFrame(rows, "Sender_account string, Is_laundering int, position long"))
    ranks = [(r.Is_laundering, r["rank"], r.account) for r in seen.collect()]
    expected = [(flag, rank, f"s{i % 700}") for flag in (0, 1) for rank, i in enumerate([i for i in range(700) if i % 2 == flag], 1)]
    assert sorted(ranks) == sorted(expected)
    clients = spark.createDataFrame([(f"c{i:03d}", int(i % 10 == 0), 0) for i in range(200)], "client_id string, sanctions_flag int, ofac_country_flag int")
    dealt = transactions.assign_accounts(clients, seen)
    assert dealt.count() == 400 and dealt.groupBy("Is_laundering").count().where("count in (40, 360)").count() == 2
    assert transactions.assign_accounts(clients, seen, clients_per_group=30).count() == 2 * (20 + 30)
    assert dealt.where("client_id = 'c010'").agg(F.sort_array(F.collect_list("account"))).first()[0] == ["s5", "s7"]


def test_score_history_lists(spark):
    day = "2024-03-{:02d}T00:00:00Z"
    histories = [
        ("dated", 60, [(40, day.format(1)), (50, "x"), (60, day.format(11))]), ("unreadable", 50, [(20, "1 March"), (30, None), (50, day.format(2))]),
        ("missing", 30, [(20, None), (30, day.format(1))]), ("one", 30, [(20, day.format(1))]), ("empty", 30, []), ("none", 30, None),
        ("scoreless", 30, [(None, day.format(1)), (30, day.format(3))]), ("falling", 10, [(20, "2024-03-01"), (10, "2024-03-03 12:00:00+00:00")]),
    ]
    table = spark.createDataFrame(histories, "customer_id string, current_score int, score_history array<struct<score:int,timestamp:string>>")
    got = {r.customer_id: tuple(r)[2:] for r in risk.score_velocity(table).collect()}
    assert got == {
        "dated": (40, 10.0, 2.0, 0.5, 10.5), "unreadable": (20, 2.0, 15.0, 0.73, 2.07), "missing": (20, 1.0, 10.0, 3.1, 5.1), "one": (20, 1.0, 10.0, 3.1, 5.1),
        "empty": (None, None, None, None, None), "none": (None, None, None, None, None), "scoreless": (None, None, None, None, None), "falling": (20, 2.5, -4.0, None, None),
    }


def test_descendants_against_plain_walk(spark):
    from probita.operators import graph

    rng = random.Random(9)
    edges = [(s, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for s in ("a", "b") for _ in range(70)] + [("a", "n0", f"hub{i}") for i in range(300)] + [("a", "n0", "n0"), ("a", "n1", "n0")]
    starts = [("a", "n0"), ("a", "n1"), ("b", "n0"), ("b", "nowhere"), ("a", "n0")]
    expected = {}
    for structure, root in set(starts):
        paths = {root: (root,)}
        for depth in range(1, 4):
            found = {}
            for s, owner, owned in edges:
                if s == structure and owner in paths and len(paths[owner]) == depth and owned not in paths:
                    path = (*paths[owner], owned)
                    found[owned] = min(found.get(owned, path), path)
            paths |= found
        expected |= {(structure, root, node): path for node, path in paths.items() if node != root}
    got = graph.descendants(spark.createDataFrame(starts, "structure string, root_id string"), spark.createDataFrame(edges, "structure string, owner_id string, owned_id string"), 3).collect()
    assert {(r.structure, r.root_id, r.node_id): tuple(r.path) for r in got} == expected and len(got) == len(expected) > 300
    assert all(r.depth == len(r.path) - 1 for r in got)


def test_batches_read_the_prepared_list_only(spark, tmp_path, monkeypatch):
    from test_screening import FALSE_ENTRY, FALSE_QUERY, QUERY, TRUE_ENTRY, TRUE_QUERY, WATCH

    from probita.operators import matching
    from probita.streaming import monitors

    spark.createDataFrame([TRUE_ENTRY, FALSE_ENTRY], WATCH).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    queries = spark.createDataFrame([TRUE_QUERY, FALSE_QUERY], QUERY)
    once = sorted(map(str, matching.screen(queries, raw).collect()))
    write = monitors.screening_sink(raw, f"{tmp_path}/out")
    monkeypatch.setattr(matching, "_filed", None)  # a batch that prepared the list again would fail
    for batch in (1, 2):
        write(queries, batch)
        assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out/batch={batch}").collect())) == once


def test_ownership_walks_send_no_tables_through_the_driver(spark, monkeypatch):
    from probita.operators import graph
    plans, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([("s", f"n{i // 2}", f"n{i}") for i in range(1, 8)], "structure string, owner_id string, owned_id string")
    nodes = spark.createDataFrame([("s", f"n{i}", i) for i in range(8)], "structure string, entity_id string, position int")
    starts = graph.roots(nodes, edges)
    assert "Broadcast" not in starts._jdf.queryExecution().executedPlan().toString()
    assert [(r.root_id, r.nodes_traversed) for r in graph.count_descendants(starts, edges).collect()] == [("n0", 7)]
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
