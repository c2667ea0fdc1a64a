import numpy as np
from corpus_cases import LONG, awkward, nothing

from probita.llm import licenses
from probita.llm.license_texts import TEMPLATES
from probita.llm.queries import QUERIES

LINES = ["Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."]


def test_query_finds_every_line(spark):
    folder = "/root/testdata/sf0.01"
    by = {}
    for r in QUERIES["op7_licenses"](spark, folder).collect():
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want = sorted((at, at + len(line) - 1) for line in LINES for at in range(len(doc.text)) if doc.text.startswith(line, at))
        total += len(want)
        assert sorted((r.start, r.end) for r in by.get(doc.doc_id, [])) == want
    assert total > 0


def longest_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_changed_notices_by_alignment():
    index = licenses.Index.of()
    for at, (name, text) in enumerate(TEMPLATES):
        said = text.split()
        if len(said) < 30:
            continue
        changed = [w for i, w in enumerate(said) if i % 23 != 11]
        changed[7:7] = ["really", "and"]
        document = "before this " + " ".join(changed) + " after that"
        found = licenses.matches(document, index)
        assert [(f[0], f[1]) for f in found] == [(name, at)]
        common = longest_common(licenses.words(text), licenses.words(document))
        assert common - 3 <= found[0][4] <= common and found[0][5] == found[0][4] / len(licenses.words(text))
        assert document[found[0][2]:].startswith(said[0].strip("(\"")) and found[0][3] <= len(document) - len(" after that")


def test_below_the_share_and_repeated_notices():
    index = licenses.Index.of()
    assert licenses.matches("Released under the terms of nobody", index) == []
    many = " filler words here ".join(LINES * 3)
    assert [many[m[2]:m[3]] + "." for m in licenses.matches(many, index)] == LINES * 3
    assert licenses.matches("ä Released, under THE mit-license!", index) == [("MIT", 7, 2, 33, 5, 1.0)]


def test_awkward_rows(spark):
    docs = awkward(spark, [(1, LINES[3]), (1, LINES[3]), (2, None), (3, ""), (4, LONG), (None, LINES[0])])
    got = sorted((str(r.doc_id), r.license) for r in licenses.scan(docs).collect())
    assert got == [("1", "MIT"), ("1", "MIT"), ("None", "CC-BY-NC-4.0")]
    assert licenses.scan(nothing(spark)).count() == 0


def test_short_templates_against_alignment_without_seeds():
    index = licenses.Index.of()
    short = [a for a in index.templates if len(a) <= licenses.SHORT]
    assert [m[0] for m in licenses.matches("Released under MIT License", index)] == ["MIT"]
    assert [m[0] for m in licenses.matches("Released under an MIT License", index)] == ["MIT"]
    by_number = {n: w.decode() for w, n in index.numbers.items()}
    found = 0
    for words in short:
        said = [by_number[n] for n in words.tolist()]
        changed = [said[:i] + new + said[j:] for i in range(len(said)) for j in (i, i + 1) for new in ([], ["zz"])]
        changed += [[*c[:-2], "zz", *c[-2:]] for c in changed]
        for c in changed:
            text = "before it " + " ".join(c) + " after it"
            numbers = np.array([index.numbers.get(w, 0) for w in licenses.words(text)], np.int64)
            most = max((m for a in short for m in [licenses.aligned(a, numbers, -len(a), len(numbers), 0)[0]] if m / len(a) >= licenses.COVERAGE), default=0)
            got = licenses.matches(text, index)
            assert max((m[4] for m in got), default=0) == most, text
            found += most > 0
    assert found > 100
