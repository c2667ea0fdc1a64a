"""Benchmark decontamination with a positional inverted index over the training texts.

The index is cut by documents: a row of the index table is a shard of some documents with the postings of all their
words, so building it shuffles nothing and neither does searching it, and no word, however common, has its postings in
one place. Each task looks a block of test items up in its shards: the lists of a window's words are intersected from
the rarest in that shard, each shifted by the word's offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita.llm.common import free_name
from probita.session import scratch_path

WINDOW = 13
#: How far a word may be from its place in a proximity match.
SLOP = 2
#: A document is contaminated if at least this share of its words is hit: 1 of 20.
ONE_OF = 20
SHARD_WORDS = 500_000
#: Bytes of test items that are sent to the tasks at a time; there are as many passes over the index as blocks.
BLOCK_BYTES = 16 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX_SCHEMA = "shard string, terms binary, counts binary, positions binary, doc_ids array<{id}>, row_keys array<bigint>, n_words binary"
FOUND_SCHEMA = ("doc_id {id}, row_key bigint, shard string, place int, n_words bigint, "
                "runs array<struct<first:int,past:int>>, items array<string>, near array<string>")


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and everything beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def build_index(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", shard_words: int = SHARD_WORDS) -> None:
    """Writes the postings of all words of all ``docs`` as a Parquet table.

    Positions count words through the shard; ``row_keys`` tell rows with equal ids apart by their text. A NULL text is
    an empty one. A shard ends with the document that fills it, so a very long text is a shard by itself.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    arrow_id = pa.int64() if kind in ("bigint", "int", "smallint") else None

    def shard(ids: list, keys: list, lengths: list[int], numbers: dict[bytes, int], said: list[int]) -> dict:
        terms = np.array(said, np.int32)
        order = np.argsort(terms, kind="stable").astype(np.int32)
        return {"terms": b" ".join(numbers), "counts": np.bincount(terms, minlength=len(numbers)).astype(np.int32).tobytes(), "positions": order.tobytes(),
                "doc_ids": ids, "row_keys": keys, "n_words": np.array(lengths, np.int64).tobytes()}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"shard": pa.string(), "terms": pa.binary(), "counts": pa.binary(), "positions": pa.binary(), "doc_ids": pa.list_(arrow_id or pa.string()), "row_keys": pa.list_(pa.int64()), "n_words": pa.binary()}

        task, made = TaskContext.get().partitionId(), count()

        def row(*parts) -> pa.RecordBatch:
            cells = {"shard": f"{task}-{next(made)}"} | shard(*parts)
            return pa.RecordBatch.from_arrays([pa.array([cells[k]], kinds[k]) for k in kinds], names=list(kinds))

        ids, keys, lengths, numbers, said = [], [], [], {}, []
        for part in parts:
            for doc_id, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                found = words(text.as_py())
                said.extend([numbers.setdefault(w, len(numbers)) for w in found])
                ids.append(doc_id)
                keys.append(key)
                lengths.append(len(found))
                if len(said) >= shard_words:
                    yield row(ids, keys, lengths, numbers, said)
                    ids, keys, lengths, numbers, said = [], [], [], {}, []
        if ids:
            yield row(ids, keys, lengths, numbers, said)

    plain = F.col(id_column) if arrow_id is None and kind == "string" else F.col(id_column).cast("bigint" if arrow_id else "string")
    narrow = docs.select(plain.alias("doc_id"), F.xxhash64(text_column).alias("row_key"), F.col(text_column).cast("string").alias("text"))
    narrow.mapInArrow(batches, INDEX_SCHEMA.format(id="bigint" if arrow_id else "string")).write.parquet(path)


class _Shard:
    """One row of the index, opened for lookups."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, n_words: bytes) -> None:
        names = terms.split(b" ") if terms else []
        self.number = dict(zip(names, range(len(names)), strict=True))
        self.counts = np.frombuffer(counts, np.int32).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.positions = np.frombuffer(positions, np.int32)
        self.n_words = np.frombuffer(n_words, np.int64)
        self.doc_ends = np.cumsum(self.n_words)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term]:self.starts[term + 1]]

    def lookup(self, window: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and documents of the window's occurrences: each word within ``slop`` of its place and in the document of the rarest one."""
        order = np.argsort(self.counts[window], kind="stable")
        rare = int(order[0])
        places = self.postings(window[rare]).astype(np.int64)
        doc = np.searchsorted(self.doc_ends, places, "right")
        first, past = self.doc_ends[doc] - self.n_words[doc], self.doc_ends[doc]
        begin = places - rare
        if slop == 0:
            keep = (begin >= first) & (begin + len(window) <= past)
            begin, first, past, doc = begin[keep], first[keep], past[keep], doc[keep]
        for at in order[1:].tolist():
            if not len(begin):
                break
            there = self.postings(window[at])
            low = np.searchsorted(there, np.maximum(begin + at - slop, first), "left")
            high = np.searchsorted(there, np.minimum(begin + at + slop, past - 1), "right")
            keep = low < high
            begin, first, past, doc = begin[keep], first[keep], past[keep], doc[keep]
        return begin, doc

    def search(self, items: list[tuple[str | None, list[bytes]]], window: int, slop: int) -> tuple[np.ndarray, list[set], list[set]]:
        """Which words are hit, and for each document the items with an exact and with a near window."""
        edges = np.zeros(len(self.positions) + 1, np.int64)
        exact: list[set] = [set() for _ in self.n_words]
        near: list[set] = [set() for _ in self.n_words]
        for name, said in items:
            terms = np.array([self.number.get(w, -1) for w in said], np.int64)
            size = min(window, len(terms))
            if not size or (size == len(terms) and (terms < 0).any()):
                continue
            gaps = np.concatenate(([0], np.cumsum(terms < 0)))
            for start in np.flatnonzero(gaps[size:] == gaps[:-size]).tolist():
                part = terms[start:start + size]
                begins, docs = self.lookup(part, slop)
                for doc in np.unique(docs).tolist():
                    near[doc].add(name)
                if slop and len(begins):
                    begins, docs = self.lookup(part, 0)
                np.add.at(edges, begins, 1)
                np.add.at(edges, begins + size, -1)
                for doc in np.unique(docs).tolist():
                    exact[doc].add(name)
        return np.cumsum(edges)[:-1] > 0, exact, near


def search_index(index: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """For every document of the index the runs of words hit by one block of items, and the items found."""
    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        for part in parts:
            for row in range(part.num_rows):
                cell = {n: part.column(i)[row] for i, n in enumerate(part.schema.names)}
                shard = _Shard(*(cell[n].as_py() for n in ("terms", "counts", "positions", "n_words")))
                hit, exact, near = shard.search(items, window, slop)
                n = len(shard.n_words)
                runs: list[list[dict]] = [[] for _ in range(n)]
                step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                for first, past in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True):
                    doc = int(np.searchsorted(shard.doc_ends, first, "right"))
                    while first < past:  # a run over the end of a document is two
                        end = min(past, int(shard.doc_ends[doc]))
                        base = int(shard.doc_ends[doc] - shard.n_words[doc])
                        if first < end:
                            runs[doc].append({"first": first - base, "past": end - base})
                        first, doc = end, doc + 1
                named = [[x for x in s if x is not None] for s in exact]
                nearby = [[x for x in s if x is not None] for s in near]
                yield pa.RecordBatch.from_arrays([
                    cell["doc_ids"].values, cell["row_keys"].values, pa.array([cell["shard"].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(shard.n_words),
                    pa.array(runs, runs_type), pa.array(named, pa.list_(pa.string())), pa.array(nearby, pa.list_(pa.string()))],
                    names=["doc_id", "row_key", "shard", "place", "n_words", "runs", "items", "near"])

    return index.mapInArrow(batches, FOUND_SCHEMA.format(id=kind))


def item_blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test items as words, in blocks of bounded size."""
    block, size = [], 0
    for name, text in items.select(F.col(id_column).cast("string"), F.col(text_column).cast("string")).toLocalIterator():
        block.append((name, words(text)))
        size += len(text or "") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def _covered(runs: Column) -> Column:
    """Number of words in a union of runs."""
    start = F.struct(F.lit(0).alias("past"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.array_sort(runs), start, lambda a, r: F.struct(
        F.greatest(a["past"], r["past"]).alias("past"),
        (a["n"] + F.greatest(r["past"] - F.greatest(a["past"], r["first"]), F.lit(0))).alias("n")), lambda a: a["n"])


def scan(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, slop: int = SLOP, one_of: int = ONE_OF, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``row_key``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted names), ``near`` (items
    with a proximity match), ``runs`` (hit words, first and past the last) and ``contaminated``.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window. A word inside
    any occurrence of a window is hit. A NULL or empty text has no words and no hit; NULL or empty items match nothing;
    an item without a name hits words but is not listed; items with equal names are one name. Repeated rows are each
    returned. Only the named columns are read. Without documents the result is empty, without items nothing is hit.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "postings")
    build_index(docs, path, id_column, text_column, shard_words)
    index = spark.read.parquet(path)
    passes = [search_index(index, block, window, slop) for block in item_blocks(items, item_id, item_text, block_bytes)]
    found = passes[0]
    if len(passes) > 1:
        for one in passes[1:]:
            found = found.unionByName(one)
        found = found.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items", "near")])
    names = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "row_key", "n_words", _covered(F.col("runs")).alias("n_hit"), names.alias("items"),
                        F.array_sort(F.array_distinct("near")).alias("near"), F.array_sort("runs").alias("runs")).select(
        "doc_id", "row_key", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "near", "runs",
        ((F.col("n_hit") > 0) & (one_of * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept, whatever they are called; see ``scan`` for NULLs, ties and empty tables."""
    row, key = free_name("_id", docs.columns), free_name("_key", docs.columns)
    dirty = scan(docs, items, id_column, text_column, **settings).where("contaminated").select(F.col("doc_id").alias(row), F.col("row_key").alias(key)).distinct()
    return docs.join(dirty, docs[id_column].eqNullSafe(F.col(row)) & F.xxhash64(docs[text_column]).eqNullSafe(F.col(key)), "left_anti")
