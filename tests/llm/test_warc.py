import pytest
from corpus_cases import LONG
from oracle_check import compare, duck

from probita.llm import queries, warc
from probita.plans import registry
from probita.session import scratch_path


def test_query_matches_sql(spark, monkeypatch):
    monkeypatch.setattr(registry, "queries", lambda: queries.QUERIES)
    monkeypatch.setattr(registry, "oracle_sql", lambda: queries.SQL)
    folder = "/root/testdata/sf0.001"
    assert compare(spark, duck(folder), "op5_web_archives", folder) is None


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, sha string, payload string")


def test_copies_nulls_and_repeated_rows(spark):
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "http://d", ""), (5, "http://é", LONG), (7, "u", "one"), (7, "u", "one"), (None, "u", "lost"), (None, "u", "same")]
    path = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages(spark, rows).repartition(3), path, archive_bytes=1000)
    assert manifest.count() >= 3
    got = warc.read_archives(spark, path, manifest).collect()
    assert {r.problem for r in got} == {None} and len(got) == len(rows)
    said = sorted((str(r.record_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got)
    assert said == sorted([
        ("urn:x-page:1", "revisit", "urn:x-page:2", 4), ("urn:x-page:2", "response", "None", 4), ("urn:x-page:3", "revisit", "urn:x-page:4", 0), ("urn:x-page:4", "response", "None", 0),
        ("urn:x-page:5", "response", "None", len(LONG)), ("urn:x-page:7", "response", "None", 3), ("urn:x-page:7", "response", "None", 3), ("urn:x-page:None", "response", "None", 4), ("urn:x-page:None", "revisit", "urn:x-page:2", 4)])
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {"same", "", LONG, "one", "lost"}
    assert {r.uri for r in got} == {"http://a", "http://b%0D%0AX: y", "about:blank", "http://d", "http://é", "u"}
    empty = scratch_path(spark, "warc-test")
    assert warc.write_archives(pages(spark, rows).where("false"), empty).count() == 0


RECORDS = [warc.record(f"urn:x-page:{i}", f"http://host/{i}", (f"<p>page number {i}</p>" * 40).encode(), None if i % 4 else "urn:x-page:3") for i in range(60)]


def test_dictionary_leads_and_each_record_is_a_frame():
    data = warc.archive(RECORDS)
    kinds = [magic for magic, _, _ in warc.frames(data)]
    assert kinds[0] == warc.DICTIONARY_FRAME and kinds[1:] == [warc.FRAME] * len(RECORDS)
    assert [f["problem"] for _, _, f in warc.records(data)] == [None] * len(RECORDS)
    few = warc.archive(RECORDS[:2])
    assert [magic for magic, _, _ in warc.frames(few)] == [warc.FRAME] * 2


@pytest.mark.parametrize(("change", "problem"), [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), "no record header"), (lambda r: r.replace(b"WARC-Date", b"WARC-Data", 1), "missing warc-date"),
    (lambda r: r[:-5] + b"\r\n\r\n", "content length differs"), (lambda r: r.replace(b"sha1:", b"sha1:A", 1), "payload digest differs"),
])
def test_broken_records_are_told(change, problem):
    data = warc.archive([RECORDS[1], change(RECORDS[1]), RECORDS[2]])
    assert [f["problem"] for _, _, f in warc.records(data)] == [None, problem, None]


def test_broken_archives_end_with_a_problem():
    data = warc.archive(RECORDS)
    cut = [f["problem"] for _, _, f in warc.records(data[:-7])]
    assert cut[:-1] == [None] * (len(RECORDS) - 1) and "truncated" in cut[-1]
    assert [f["problem"] for _, _, f in warc.records(b"garbage of some length")] == ["no frame at 0"]
    assert list(warc.records(b"")) == []
    lead = next(end for _, _, end in warc.frames(data))
    assert all(f["problem"] for _, _, f in warc.records(data[lead:]))  # without its dictionary
