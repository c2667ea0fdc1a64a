"""Near copies by exact Jaccard similarity of word shingles.

Candidates come first from ball hashing of SimHash fingerprints of the same shingles (``simhash.links``), at most DISTANCE
bits apart, which is how closely texts agree that are similar by some 0.95. For the texts that this leaves apart the search
is widened by banded minima: texts with similarity s share one of BANDS bands of ROWS minima with probability
1 - (1 - s ** ROWS) ** BANDS, which is 0.999997 at 0.8. What is linked is decided by the shingles themselves. The passes
keep the pairs of a large group few: fingerprints that share a variant meet the smallest of them; then every bucket's
members meet one leader (each bucket has its own, so a text of a group meets up to BANDS of them) if they are in different
components; at last only members that are still in different components meet, in tiles of bounded size. A pair leaves a tile only if its parity maps allow the similarity: a map flips one of PARITY bits
for every shingle, so two maps differ in at most as many bits as the sets differ in shingles, and similar sets differ in
few. That bound is exact and for texts of some hundred words close, so texts of a group that stay unlinked cost a
comparison of two maps and are neither joined nor compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probita.llm.components import components
from probita.llm.simhash import DISTANCE, links, majority, one_of_each, row_keys, with_components
from probita.session import cut_lineage, released

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 42
#: Pairs whose estimate (160 minima, standard deviation 0.032 at 0.8) is lower by this are not compared in full.
SLACK = 0.16
#: Bits of a parity map. Sets that differ in more shingles than a few hundred fill it, and the minima alone decide what is compared in full.
PARITY = 2048
#: Members of a bucket that meet in one tile, about; a larger bucket is cut into tiles of two such parts each.
TILE = 1024
#: Leading bits by which variants of fingerprints are dealt: a fingerprint is sent to 79 of 4,096 buckets.
PREFIX_BITS = 12
#: Shingles whose minima are formed at a time: 160 numbers each.
SHINGLES_AT_ONCE = 2048
#: Bits of the bitmap of rows whose shingles are wanted: for each row, at least, and at most (32 MB). A full one only lets more rows pass.
BITS, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; texts of fewer words are one shingle, and so are NULL and blank ones."""
    return np.unique(occurrences(text, words))


def occurrences(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's word shingles in their order, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(b" ".join(found[i:i + words]), SEED) for i in range(max(1, len(found) - words + 1))], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a text's shingles: ``simhash.fingerprint`` of the same number of words, without hashing them again."""
    return majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of BANDS * ROWS permutations."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        mixed = hashes[None, at:at + SHINGLES_AT_ONCE] * _FACTORS[:, None] + _TERMS[:, None]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(out, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1), out=out)
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY bits, of which every hash flips one."""
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _nodes(keyed: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (hash of the whole set of shingles), ``print`` (SimHash), ``size`` and ``sketch`` (a byte of each minimum, then the parity map)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            whole, prints, sizes, sketches = [], [], [], []
            for text in part.column(1):
                said = occurrences(text.as_py())
                found = np.unique(said)
                whole.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                prints.append(fingerprint(said))
                sizes.append(len(found))
                sketches.append((minima(found) >> np.uint64(24)).astype(np.uint8).tobytes() + parity(found).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_signed(whole)), pa.array(_signed(prints)), pa.array(sizes, pa.int32()),
                                              pa.array(sketches, pa.binary())], names=["doc_id", "fp", "print", "size", "sketch"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(batches, f"doc_id {kind}, fp bigint, print bigint, size int, sketch binary")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits that are set at the places of the ``key`` column; what comes to the driver is the bitmap, of ``MOST_BITS`` at most."""
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS * released(keys.agg(F.count("*"))).collect()[0][0]).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(size - 1)) + 1
    found = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for bucket, some in released(found).collect():
        bits[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(some, np.uint8)
    return bits


def _sets(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """``fp`` and the shingles ``set`` of the texts whose keys pass the bitmap; of the others nothing is formed or shuffled."""
    sent = keyed.sparkSession.sparkContext.broadcast(bits)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for part in parts:
            place = part.column(0).to_numpy() & (len(held) * 8 - 1)
            passes = held[place >> 3] >> (place & 7).astype(np.uint8) & 1
            found = [shingles(text.as_py()) for text in part.column(1).filter(pa.array(passes > 0))]
            yield pa.RecordBatch.from_arrays([pa.array(_signed([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found])),
                                              pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["fp", "set"])

    return keyed.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(batches, "fp bigint, set array<bigint>")


def _unpacked(column: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the minima and words of the parity maps, a row each."""
    whole = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)
    return whole[:, :BANDS * ROWS], np.ascontiguousarray(whole[:, BANDS * ROWS:]).view(np.uint64)


def _possible(sizes: np.ndarray, others: np.ndarray, maps: np.ndarray, their_maps: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and maps can be similar: n shingles in common of a + b make n / (a + b - n), so a + b - 2 n may not be more than their share."""
    most = (sizes + others) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9
    possible = np.abs(sizes - others) <= most
    possible[possible] = np.bitwise_count((maps ^ their_maps)[possible]).sum(axis=1) <= most[possible]
    return possible


def _alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and maps allow the similarity and whose minima agree in about as many places as those of similar ones do."""
    for part in parts:
        if not part.num_rows:
            continue
        sizes = [part.column(k).to_numpy().astype(np.int64) for k in (2, 3)]
        (left, left_map), (right, right_map) = (_unpacked(part.column(k), part.num_rows) for k in (4, 5))
        keep = _possible(*sizes, left_map, right_map) & ((left == right).mean(axis=1) >= SIMILARITY - SLACK)
        yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["u", "v"])


def _tile(band: int, crossed: bool, side: np.ndarray, fp: np.ndarray, root: np.ndarray, size: np.ndarray, least: np.ndarray, maps: np.ndarray) -> list[np.ndarray]:
    """Pairs of one tile as arrays of two rows: different roots, similarity possible, minima alike, and ``band`` the first one that the two share."""
    found = []
    for at in range(len(fp) - 1):
        rest = np.flatnonzero((root[at + 1:] != root[at]) & ((side[at + 1:] != side[at]) if crossed else True)) + at + 1
        if len(rest):
            rest = rest[_possible(np.broadcast_to(size[at], len(rest)), size[rest], maps[at][None, :], maps[rest])]
        if not len(rest):
            continue
        same = least[rest] == least[at]
        shared = same.reshape(len(rest), BANDS, ROWS).all(axis=2)
        rest = rest[(same.mean(axis=1) >= SIMILARITY - SLACK) & (shared.argmax(axis=1) == band)]
        if len(rest):
            found.append(np.stack([np.minimum(fp[at], fp[rest]), np.maximum(fp[at], fp[rest])]))
    return found


def _tiles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the tiles, whose rows follow each other: ``bucket``, ``low``, ``high``, ``side``, ``fp``, ``root``, ``size``, ``sketch``."""

    def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        key = np.stack([whole.column(k).to_numpy() for k in range(3)], axis=1)
        side, fp, root, size = (whole.column(k).to_numpy().astype(np.int64) for k in range(3, 7))
        least, maps = _unpacked(whole.column(7), whole.num_rows)
        starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
        pairs = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 1:
                pairs += _tile(int(key[a, 0]) % BANDS, key[a, 1] != key[a, 2], side[a:b], fp[a:b], root[a:b], size[a:b], least[a:b], maps[a:b])
        u, v = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        last = [part.column(k)[part.num_rows - 1].as_py() for k in range(3)]
        if sum(h.num_rows for h in held) < TILE or [held[0].column(k)[0].as_py() for k in range(3)] == last:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        of_last = np.logical_and.reduce([whole.column(k).to_numpy() == last[k] for k in range(3)])
        cut = int(np.flatnonzero(of_last)[0])  # the last tile may go on in the next batch
        yield from done(whole.slice(0, cut).to_batches())
        held = whole.slice(cut).to_batches()
    if held:
        yield from done(held)


def _verified(close: DataFrame, keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those of the pairs whose exact similarity reaches SIMILARITY. ``distinct`` names by ``key`` one row of ``keyed`` for each ``fp``."""
    wanted = cut_lineage(close.select(F.col("u").alias("fp")).unionByName(close.select(F.col("v").alias("fp"))).distinct())
    bits = _bitmap(distinct.select("fp", "key").join(wanted, "fp", "left_semi"))
    sets = cut_lineage(_sets(keyed, bits).join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))
    both = close.join(sets.select(F.col("fp").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("set").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= F.lit(SIMILARITY) * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


def _by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Pairs ``u``, ``v`` of texts whose fingerprints ball hashing links: the least texts of two fingerprints, and the least and every other one of the same."""
    least = cut_lineage(distinct.groupBy("print").agg(F.min("fp").alias("least")))
    same = distinct.select("print", "fp").join(least, "print").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    linked = links(least.select(F.col("print").alias("fp")), DISTANCE, PREFIX_BITS).distinct()
    one, other = (least.select(F.col("print").alias(f"p_{n}"), F.col("least").alias(f"t_{n}")) for n in ("u", "v"))
    near = linked.join(one, F.col("u") == F.col("p_u")).join(other, F.col("v") == F.col("p_v")).select(F.least("t_u", "t_v").alias("u"), F.greatest("t_u", "t_v").alias("v"))
    return cut_lineage(near.unionByName(same))


def _close(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Those of the pairs that are in different components (``root``) and that sizes, maps and minima allow to be similar."""
    one, other = (sketched.select(F.col("fp").alias(n), F.col("root").alias(f"r_{n}"), F.col("size").alias(f"n_{n}"), F.col("sketch").alias(f"s_{n}")) for n in ("u", "v"))
    apart = pairs.join(one, "u").join(other, "v").where("r_u <> r_v").select("u", "v", "n_u", "n_v", "s_u", "s_v")
    return cut_lineage(apart.mapInArrow(_alike, "u bigint, v bigint"))


def near_copies(keyed: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row of ``keyed`` (``doc_id``, ``text``): components of texts that are similar by SIMILARITY or more.

    NULL texts and texts without a word are one text with nothing in it and copies of each other. Equal texts are one
    before anything is compared. A component is named by its smallest id (NULL only if all its ids are), so ties don't
    matter; repeated rows are each returned, and an empty table gives an empty result.
    """
    nodes = cut_lineage(_nodes(keyed))
    distinct = cut_lineage(nodes.select("fp", F.xxhash64("doc_id").alias("key"), "print", "size", "sketch").dropDuplicates(["fp"]))
    near = _close(_by_fingerprint(distinct), distinct.withColumn("root", F.col("fp")))
    found = cut_lineage(_verified(near, keyed, distinct))
    roots = components(found)

    band = lambda b: F.xxhash64(F.col("sketch").substr(b * ROWS + 1, F.lit(ROWS)), b).bitwiseAND(F.lit(-BANDS)).bitwiseOR(b.cast("long"))
    members = distinct.select(F.explode(F.transform(F.array(*[F.lit(b) for b in range(BANDS)]), band)).alias("bucket"), "fp")
    # A bucket's leader is the member with the least fp ^ bucket: another one in each bucket, and one number in the aggregate.
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.col("fp").bitwiseXOR(F.col("bucket"))).alias("least")).where("n > 1")
    buckets = cut_lineage(members.join(shared, "bucket").select("bucket", "fp", F.col("least").bitwiseXOR(F.col("bucket")).alias("leader")))
    sketched = distinct.select("fp", "size", "sketch").join(buckets.select("fp").distinct(), "fp", "left_semi").join(roots, F.col("fp") == F.col("node"), "left")
    sketched = cut_lineage(sketched.select("fp", "size", "sketch", F.coalesce("root", "fp").alias("root")))

    led = buckets.where("fp <> leader").select(F.least("fp", "leader").alias("u"), F.greatest("fp", "leader").alias("v")).distinct()
    found = cut_lineage(found.unionByName(_verified(_close(led, sketched), keyed, distinct)))

    rooted = buckets.join(components(found), F.col("fp") == F.col("node"), "left").select("bucket", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    open_ = rooted.join(mixed.select("bucket", tiles.alias("tiles")), "bucket").withColumn("side", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    placed = open_.join(sketched.drop("root"), "fp").withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "bucket", F.least("side", "meets").alias("low"), F.greatest("side", "meets").alias("high"), "side", "fp", "root", "size", "sketch")
    close = cut_lineage(placed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(_tiles, "u bigint, v bigint"))
    return with_components(nodes.select("doc_id", "fp"), found.unionByName(_verified(close, keyed, distinct)))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` of each component of near copies: the one with the smallest id, then the smallest hash of its text."""
    return one_of_each(docs, near_copies(row_keys(docs, id_column, text_column)), id_column, text_column)
