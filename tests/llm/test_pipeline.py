import re

import corpus_pipeline
from corpus_cases import awkward, nothing

from probita.llm import decontam, langid, secrets
from probita.llm.queries import QUERIES
from probita.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(docs):
    """The smallest id of each document's group: texts whose sets of five words are similar by 0.8 or more, all pairs compared."""
    root, sets = {i: i for i in docs}, {i: shingles(t) for i, t in docs.items()}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            shared = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in docs}


def test_stages_against_plain_versions(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[s:s + 13]) for w in items for s in range(max(1, len(w) - 12)) if w}
    rejected = {r.doc_id for r in langid.predict(table, langid.fit(table.where(~langid.held_out())), keep=["doc_id"]).where("rejected").collect()}
    left = {i: r.text for i, r in docs.items() if i not in rejected}
    kept = {i for i, root in plain_groups(left).items() if i == root}

    def contaminated(text):
        said = decontam.words(text)
        hit = {p for n in {len(w) for w in windows} for s in range(len(said) - n + 1) if tuple(said[s:s + n]) in windows for p in range(s, s + n)}
        return bool(hit) and 20 * len(hit) >= len(said)

    kept = {i for i in kept if not contaminated(docs[i].text)}
    got = {r.doc_id: r for r in QUERIES["pipeline"](spark, FOLDER).collect()}
    assert set(got) == kept
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.values())
    spans = {r.doc_id: r.spans for r in secrets.report(table).collect()}
    assert all((got[i].n_chars == docs[i].n_chars) or spans[i] for i in kept)


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = scratch_path(spark, f"test-{name}")
            columns = docs.columns
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
