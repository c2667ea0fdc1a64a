"""Readers and writers on temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from probita.operators import graph
from probita.sources import loaders, sinks

ALT = "ent_num,alt_num,alt_type,alt_name,alt_remarks\n001923,1,a.k.a.,\"M. RASHID\",\n001923,2,a.k.a.,\"Mohammed AL RASHID\",\n-0-,,,,\n"
SDN = [
    '1923,"AL-RASHID, Mohammad",individual,"SDGT",Director,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"DOB 15 Mar 1975; nationality UAE; a.k.a. \'M. RASHID\'; a.k.a. \'ABU X\'"',
    '2301,"TEHRAN METALS",-0- ,"IRAN",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ',
    '9999,"SHORT ROW",-0- ', '-0- ,"NO NUMBER",-0- ,"X"',
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_text_csv_keeps_text_and_fills_short_rows(spark, tmp_path):
    path = write(tmp_path / "k.csv", '﻿client_id,client_name,pep_flag\n007,"Line\nbreak",0\n8,only\n')
    rows = [r.asDict() for r in loaders.read_text_csv(spark, path, multi_line=True).orderBy("client_id").collect()]
    assert rows == [{"client_id": "007", "client_name": "Line\nbreak", "pep_flag": "0"}, {"client_id": "8", "client_name": "only", "pep_flag": ""}]


@pytest.mark.parametrize("header", [True, False])
def test_sanctions_list_with_and_without_header(spark, tmp_path, header):
    from probita import fixed_values as V
    lines = ([",".join(V.SDN_COLUMNS)] if header else []) + SDN
    sdn, alt = write(tmp_path / "sdn.csv", "\n".join(lines) + "\n"), write(tmp_path / "alt.csv", ALT.replace("001923", "1923"))
    rows = {r.entity_id: r for r in loaders.load_sdn(spark, sdn, alt).collect()}
    assert set(rows) == {"OFAC_SDN_001923", "OFAC_SDN_002301", "OFAC_SDN_009999"}
    one = rows["OFAC_SDN_001923"]
    assert (one.name, one.dob, one.nationality, one.entity_type, one.topics) == ("Mohammad AL-RASHID", "15 Mar 1975", "UAE", "individual", ["SDGT"])
    assert one.aliases == ["M. RASHID", "Mohammed AL RASHID", "ABU X"]
    assert rows["OFAC_SDN_002301"].context is None
    light = {r.name: r for r in loaders.light_sdn(loaders.read_sdn(spark, sdn)).collect()}
    assert set(light) == {"AL-RASHID, Mohammad", "TEHRAN METALS", "NO NUMBER"}


def test_open_list_filters(spark, tmp_path):
    text = "id,schema,name,aliases,birth_date,countries,sanctions,dataset\n" + "".join(
        f"Q{i},{'Vessel' if i % 2 else 'Person'},N{i},a{i}; ;b{i},,ru;ua,s1; s2,\n" for i in range(10)) + ",Person,x,,,,,\n"
    path = write(tmp_path / "o.csv", text)
    assert loaders.load_open_list(spark, path).count() == 5
    assert loaders.load_open_list(spark, path, schemas=None).count() == 10
    row = loaders.load_open_list(spark, path).orderBy("entity_id").first()
    assert (row.aliases, row.nationality, row.topics, row.source_list) == (["a0", "b0"], "RU", ["s1", "s2"], "opensanctions")


def test_list_modes(spark, tmp_path):
    path = write(tmp_path / "o.csv", "id,schema,name,aliases,birth_date,countries,sanctions,dataset\nQ1,Person,A,,,,,\nQ2,Person,B,,,,,\n")
    real, fixture = loaders.load_open_list(spark, path), loaders.load_open_list(spark, path)
    both = loaders.combine_lists({"opensanctions": real}, fixture)
    assert both.count() == 4 and both.where("source_list like '%(SAMPLE FIXTURE)'").count() == 2
    stats = {r["list"]: r.truncated for r in loaders.list_statistics(both, {"opensanctions": 2}).collect()}
    assert stats == {"opensanctions": True, "demo_fixtures": False}
    assert loaders.combine_lists({"opensanctions": real}, fixture, "sample").count() == 2


def test_ownership_file_and_depth_limit(spark, tmp_path):
    entities = [{"entity_id": f"E{i}", "name": f"Name {i}", "nationality": "AE", "dob": "1975"} for i in range(4)]
    edges = [{"owner_id": f"E{i}", "owned_id": f"E{i + 1}", "percentage": 80.0} for i in range(3)]
    write(tmp_path / "show.json", json.dumps({"description": "x", "entities": entities, "ownership_edges": edges}, indent=1))
    nodes, links = loaders.load_ownership(spark, str(tmp_path))
    assert nodes.first().metadata == {"nationality": "AE", "dob": "1975"} and nodes.first().structure == "show"
    assert links.first().percentage == 80.0
    roots = graph.roots(nodes, links)
    assert roots.first().root_id == "E0"
    assert {r.node_id for r in graph.descendants(roots, links, 1).collect()} == {"E1"}
    assert {r.node_id: r.path for r in graph.descendants(roots, links).collect()}["E3"] == ["E0", "E1", "E2", "E3"]
    assert graph.count_descendants(roots, links).first().nodes_traversed == 3


def test_cycles_end(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "a", "c")], "structure string, owner_id string, owned_id string")
    start = spark.createDataFrame([("s", "a")], "structure string, root_id string")
    assert {(r.node_id, r.depth) for r in graph.descendants(start, edges).collect()} == {("b", 1), ("c", 1)}
    assert graph.count_descendants(start, edges).first().nodes_traversed == 2


def test_articles_regulation_and_files(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    write(folder / "one.txt", "first\nsecond")
    write(folder / "two.csv", "")
    assert [(r.filename, r.content) for r in loaders.load_articles(spark, str(folder)).collect()] == [("one.txt", "first\nsecond")]
    checked = {r.path.rsplit("/", 1)[1]: r.status for r in loaders.check_files(loaders.list_files(spark, str(folder))).collect()}
    assert checked == {"one.txt": "unsupported_type", "two.csv": "empty_file"}
    text = json.dumps([{"article_id": "article5", "article_title": "T", "article_text": "x", "article_recitals": ""}] * 2, indent=1)
    assert loaders.load_regulation(spark, write(tmp_path / "g.json", text)).count() == 2
    kyc = tmp_path / "k"
    kyc.mkdir()
    write(kyc / "k.csv", "client_id\n1\n")
    assert loaders.read_kyc_folder(spark, str(kyc)).first().source_file.endswith("k.csv")


def test_columns_and_payload_shapes(spark):
    from probita import fixed_values as V
    assert loaders.check_columns([*V.KYC_COLUMNS, "more", "ofac_country_flag"]) == (["more", "ofac_country_flag"], ["sectoral_sanctions_flag", "ownership_opacity_score"])
    with pytest.raises(ValueError):
        loaders.check_columns(["client_id"])
    df = spark.createDataFrame([(1, '[{"a": true, "b": 1}]'), (2, '{"d": []}'), (3, "[1]"), (4, "x")], "payload_id int, payload string")
    records, rejected = loaders.extract_records(df)
    assert [tuple(r)[2:] for r in loaders.map_records(records, {"a": "A", "b": "B", "c": "C"}).collect()] == [("True", "1", "")]
    assert sorted(r.payload_id for r in rejected.collect()) == [2, 3, 4]


def test_seals_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    key, other = F.lit(bytearray(b"0" * 32)), F.lit(bytearray(b"1" * 32))
    sealed = sinks.seal(df, key, "k", "kind", ["id"])
    assert [json.loads(r[0])["v"] for r in sealed.orderBy("id").select(sinks.unseal(sealed, key, "kind")).collect()] == ["x", "y"]
    assert all(r[0] is None for r in sealed.select(sinks.unseal(sealed, other, "kind")).collect() + sealed.select(sinks.unseal(sealed, key, "other")).collect())
    assert tuple(sinks.check_seals(sealed, key, "kind").first()) == (2, 2, 0)
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("e1",), ("e2",), ("e2",)], "event_id string")
    sinks.append_events(spark, events, path)
    sinks.append_events(spark, spark.createDataFrame([("e2",), ("e3",)], "event_id string"), path)
    assert [r.event_id for r in sinks.read_events(spark, path).collect()] == ["e1", "e2", "e3"]


def test_folder_with_columns_in_another_order_is_an_error(spark, tmp_path):
    folder = tmp_path / "kyc"
    folder.mkdir()
    write(folder / "a.csv", "client_id,client_name\n1,Ann\n")
    write(folder / "b.csv", "client_name,client_id\nBob,2\n")
    with pytest.raises(Exception, match="header"):
        loaders.read_kyc_folder(spark, str(folder)).collect()


def test_every_loader_keeps_line_breaks_in_fields(spark, tmp_path):
    from probita import fixed_values as V
    folder = tmp_path / "kyc"
    folder.mkdir()
    path = write(folder / "k.csv", 'client_id,client_name\n1,"Two\nlines"\n2,"says ""so"""\n')
    want = [("1", "Two\nlines"), ("2", 'says "so"')]
    for df in (loaders.read_text_csv(spark, path), loaders.read_kyc_folder(spark, str(folder))):
        assert [(r.client_id, r.client_name) for r in df.orderBy("client_id").collect()] == want
    names = ["client_id", "client_name", "client_type", "sector", "sector_risk", "country", "pep_flag", "sanctions_flag", "fatf_country_flag", "ofac_country_flag",
             "sectoral_sanctions_flag", "ownership_opacity_score"]
    clients = write(tmp_path / "c.csv", ",".join(names) + '\n7,"A\nB",x,y,z,DE,0,0,0,0,0,0.5\n')
    assert [(r.entity_id, r.name) for r in loaders.load_clients(spark, clients).collect()] == [("CLIENT-7", "A\nB")]
    mapping = write(tmp_path / "m.csv", 'client_id,account\n7,"1\n2"\n')
    assert [tuple(r) for r in loaders.load_mapping(spark, mapping).collect()] == [(7, "1\n2")]
    sdn = write(tmp_path / "s.csv", '1,"DOE, Jane",individual,"SDGT",Director,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"first\nsecond"\n')
    assert [r.Remarks for r in loaders.read_sdn(spark, sdn).collect()] == ["first\nsecond"]
    alt = write(tmp_path / "a.csv", '1,1,aka,"JANE\nD",x\n')
    assert loaders.read_alt(spark, alt).count() == 1 and len(V.ALT_COLUMNS) == 5
    listed = write(tmp_path / "o.csv", 'id,schema,name,aliases,birth_date,countries,sanctions,dataset\nQ1,Person,"A\nB",,,,,\n')
    assert [r.name for r in loaders.load_open_list(spark, listed).collect()] == ["A\nB"]
    assert not loaders.has_open_quotes(spark, write(tmp_path / "n.csv", 'a,b\n1,"x ""y"""\n'))


def test_folder_of_mixed_headers(spark, tmp_path):
    from probita import fixed_values as V
    folder = tmp_path / "kyc"
    (folder / "deep" / "er").mkdir(parents=True)
    row = dict.fromkeys(V.KYC_COLUMNS, "x")

    def lines(columns, *ids):
        return ",".join(columns) + "\n" + "".join(",".join({**row, "client_id": i}.get(c, "more") for c in columns) + "\n" for i in ids)

    write(folder / "a.csv", "\ufeff" + lines(V.KYC_COLUMNS, "1", "2"))
    write(folder / "b.csv", lines([*reversed(V.KYC_COLUMNS), "extra, one"], "3").replace("extra, one", '"extra, one"'))
    write(folder / "deep" / "er" / "c.csv", lines(V.KYC_COLUMNS, '"4\n4"') + "5,short\n")
    write(folder / "no_id.csv", "client_name\nAnn\n")
    write(folder / "twice.csv", lines([*V.KYC_COLUMNS, "Sector"], "6"))
    write(folder / "empty.csv", "")
    write(folder / "note.txt", "x")
    write(folder / ".hidden.csv", lines(V.KYC_COLUMNS, "7"))
    rows, rejected = loaders.read_mixed_folder(spark, str(folder), deep=True)
    got = {r.client_id: r for r in rows.collect()}
    assert set(got) == {"1", "2", "3", "4\n4", "5"}
    assert got["3"]["extra, one"] == "more" and got["1"]["extra, one"] is None and got["3"].sector == "x"
    assert got["5"].client_name == "short" and got["5"].sector == "" and got["5"].source_file.endswith("deep/er/c.csv")
    assert {r.path.rsplit("/", 1)[1]: r.status for r in rejected.collect()} == {
        "no_id.csv": "missing_columns", "twice.csv": "repeated_columns", "empty.csv": "empty_file", "note.txt": "unsupported_type"}
    assert {r.client_id for r in loaders.read_mixed_folder(spark, f"file:{folder}")[0].collect()} == {"1", "2", "3"}
    assert loaders.read_mixed_folder(spark, str(tmp_path / "nowhere"))[0].count() == 0


def test_listing_has_a_partition_for_each_sub_folder(spark, tmp_path):
    for name in ("a", "b", "_c"):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "x.csv", "h\n")
    files = loaders.list_files(spark, str(tmp_path), "x.*", deep=True)
    assert files.rdd.getNumPartitions() == 3
    assert sorted(r.path for r in files.collect()) == [str(tmp_path / n / "x.csv") for n in ("a", "b")]
    assert loaders.list_files(spark, str(tmp_path)).count() == 0
