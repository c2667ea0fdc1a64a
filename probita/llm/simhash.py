"""SimHash near-duplicates by meeting in the middle.

Two fingerprints at Hamming distance 2r or less have a common variant within r flips of each. So every distinct
fingerprint stands for all its variants within r flips, variants are dealt out by value, and fingerprints that meet in
a variant are linked. Variants are not shuffled one by one: they are dealt by their leading bits, and a fingerprint is
sent once to every leading-bit bucket in which it has variants (137 rows instead of 2,081 variants for 16 leading bits
and r = 2); the task that owns a bucket forms the variants in it, sorts them and verifies what collides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probita.llm.common import free_name
from probita.llm.components import components
from probita.session import cut_lineage

WORDS = 4
DISTANCE = 4
SEED = 42
PREFIX_BITS = 16
#: Variants held at once by a task: 8 bytes each, a few copies of them.
VARIANTS_AT_ONCE = 4_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of one text, unsigned; 0 for NULL and for texts without a word."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashed = xxhash.xxh64_digest
        digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)])
    return majority(np.frombuffer(digests, np.uint8).reshape(-1, 8))


def majority(rows: np.ndarray) -> int:
    """The fingerprint of hashes of eight bytes each, highest first: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 65536):  # bounded memory for very long texts
        counts += np.unpackbits(rows[at:at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row; other columns are not read."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.fromiter((fingerprint(x.as_py(), words) for x in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(batches, f"doc_id {kind}, fp bigint")


def flips(bits: int, most: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``most`` ones."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def _variants(buckets: np.ndarray, prints: np.ndarray, low_bits: int, radius: int, masks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (variant, index of its fingerprint) for all variants that fall in the given buckets."""
    used = np.bitwise_count(buckets ^ (prints >> np.uint64(low_bits)))
    low = (buckets << np.uint64(low_bits)) | (prints & np.uint64((1 << low_bits) - 1))
    for spent in range(radius + 1):
        rows = np.flatnonzero(used == spent)
        flip = masks[radius - spent]
        step = max(1, VARIANTS_AT_ONCE // len(flip))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            yield (low[some][:, None] ^ flip[None, :]).ravel(), np.repeat(some, len(flip))


def _colliding(buckets: np.ndarray, prints: np.ndarray, low_bits: int, radius: int, masks: list[np.ndarray]) -> np.ndarray:
    """Distinct verified pairs (smallest fingerprint of a variant, another one of it) as an n x 2 array."""
    spent = np.bitwise_count(buckets ^ (prints >> np.uint64(low_bits)))
    total = sum(int((spent == s).sum()) * len(masks[radius - s]) for s in range(radius + 1))
    slices = -(-total // VARIANTS_AT_ONCE)
    found = []
    for part in range(slices):  # more than one only for a bucket that is larger than a task may hold
        values, owners = [], []
        for v, o in _variants(buckets, prints, low_bits, radius, masks):
            if slices > 1:
                keep = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices) == part
                v, o = v[keep], o[keep]
            values.append(v)
            owners.append(o)
        variant, owner = np.concatenate(values), np.concatenate(owners)
        ordered = np.sort(variant)
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(repeated):
            continue
        at = np.minimum(np.searchsorted(repeated, variant), len(repeated) - 1)
        hit = repeated[at] == variant
        group, member = at[hit], prints[owner[hit]]
        order = np.lexsort((member, group))
        group, member = group[order], member[order]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        least = member[np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))]
        pairs = np.stack([least[~first], member[~first]], axis=1)
        found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
    if not found:
        return np.empty((0, 2), np.uint64)
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * radius]


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs that connect what earlier ones don't: no component changes, and fewer rows leave the task."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = top(a), top(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, np.uint64).reshape(-1, 2)


def links(prints: DataFrame, distance: int = DISTANCE, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """Pairs ``u``, ``v`` of distinct fingerprints at most ``distance`` bits apart, enough to connect all such pairs.

    ``prints`` has one long column ``fp``; repeated values count once, NULL ones not at all. An odd distance is refused:
    fingerprints that share a variant are linked to the smallest of them, never all to all, which is within an even distance only.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    radius, low_bits = distance // 2, 64 - prefix_bits
    heads = F.array(*[F.lit(m) for m in flips(prefix_bits, radius)])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array(flips(low_bits, r), np.uint64) for r in range(radius + 1)]
        weigh = np.array([len(masks[radius - s]) for s in range(radius + 1)])
        held_b, held_p = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def done(b: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets, a bounded number of variants at a time."""
            starts = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
            cost = np.concatenate(([0], np.cumsum(weigh[np.bitwise_count(b ^ (p >> np.uint64(low_bits)))])))[starts]
            at = 0
            while at < len(starts) - 1:
                to = max(at + 1, int(np.searchsorted(cost, cost[at] + VARIANTS_AT_ONCE, "right")) - 1)
                some = slice(starts[at], starts[to])
                pairs = _colliding(b[some], p[some], low_bits, radius, masks)
                pairs = _forest(pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= distance])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names=["u", "v"])
                at = to

        for part in parts:
            held_b = np.concatenate([held_b, part.column(0).to_numpy().view(np.uint64)])
            held_p = np.concatenate([held_p, part.column(1).to_numpy().view(np.uint64)])
            if len(held_b) >= 1 << 18 and held_b[0] != held_b[-1]:
                cut = int(np.searchsorted(held_b, held_b[-1]))
                yield from done(held_b[:cut], held_p[:cut])
                held_b, held_p = held_b[cut:], held_p[cut:]
        if len(held_b):
            yield from done(held_b, held_p)

    # Rows are few and small before they are multiplied, so the engine would put them into a task or two: deal them out by number.
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = prints.select("fp").where("fp is not null").distinct().repartition(spread).select(
        F.explode(F.transform(heads, lambda m: F.shiftrightunsigned("fp", low_bits).bitwiseXOR(m.cast("long")))).alias("bucket"), "fp")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(batches, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    distance: int = DISTANCE, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``distance`` bits. Texts of fewer words than a
    shingle are one shingle; NULL texts and texts without a word have fingerprint zero and are linked like any other.
    Rows with equal ids or texts are each returned; a NULL id is returned with the component of its text and names no
    component. Columns other than the two named are not read, so clashing names do no harm; an empty table gives an
    empty result. Equal fingerprints are one before anything is compared, so a text that makes up a third of all rows
    costs what one row costs; it is spread again by the engine's skew join when rows get their component.
    """
    prints = cut_lineage(fingerprints(docs, id_column, text_column, words))
    return with_components(prints, links(prints, distance, prefix_bits)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_components(prints: DataFrame, linked: DataFrame) -> DataFrame:
    """``prints`` (``doc_id``, ``fp``) with ``component_id``, the smallest id of the component that the links (``u``, ``v``) of ``fp`` make."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked)
    rooted = cut_lineage(least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut_lineage(rooted.join(named, "root").select(F.col("fp").alias("p"), "component_id"))
    return prints.join(by_print, F.col("fp") == F.col("p"), "left").select("doc_id", "fp", "component_id")


def row_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of every row, the id being a key that is never NULL: (id is missing, id, hash of the text)."""
    text = F.col(text_column).cast("string")
    return docs.select(F.struct(F.col(id_column).isNull().alias("missing"), F.col(id_column).alias("id"), F.xxhash64(text).alias("hash")).alias("doc_id"), text.alias("text"))


def one_of_each(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the ``component_id`` of ``found``, which was made from ``row_keys(docs)``; of equal keys one row."""
    kept = cut_lineage(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n")))
    repeated = kept.where("n > 1").limit(1).count()
    kept_id, kept_hash = free_name("_kept", docs.columns), free_name("_kept_hash", docs.columns)
    keys = kept.select(F.col("doc_id.id").alias(kept_id), F.col("doc_id.hash").alias(kept_hash))
    text_hash = F.xxhash64(docs[text_column].cast("string"))
    out = docs.join(keys, docs[id_column].eqNullSafe(F.col(kept_id)) & text_hash.eqNullSafe(F.col(kept_hash)), "left_semi")
    if not repeated:
        return out
    named = free_name("_text_hash", docs.columns)
    return out.withColumn(named, F.xxhash64(F.col(text_column).cast("string"))).dropDuplicates([id_column, named]).drop(named)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings: int) -> DataFrame:
    """One row of ``docs`` of each component: the one with the smallest id, then the smallest hash of its text.

    Rows are told apart by id and text, so rows with a NULL id or with an id that others have too lose nothing but their
    duplicates; a row with a NULL id stays only if nothing named is in its component.
    """
    found = near_duplicates(row_keys(docs, id_column, text_column), **settings)
    return one_of_each(docs, found, id_column, text_column)
