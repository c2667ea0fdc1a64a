"""Hard negatives by inner product, from candidate lists that clusters of anchors share.

Anchors are clustered by direction. For a cluster whose members lie within an angle b of its centre, |x| cos(max(0, c - b)),
with c the angle of a candidate x to the centre, is an upper bound of x's inner product with any member of length one. A
task holds a block of candidates, sorts it once per cluster by that bound, and all members of the cluster walk down the
list together; a member leaves when the bound of what follows, times its length, cannot change its result any more.

Two walks: the first finds each anchor's nearest rows of its own label, whose scores set the bands of the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probita.session import scratch_path

POSITIVES, NEGATIVES = 5, 5
#: Share of a positive's score, in hundredths, that a negative must reach.
LEAST = 80
SCALE = 256
CLUSTERS = 64
#: Anchors that the centres are fitted on, chosen by hash; every anchor belongs to a cluster and is searched for.
SAMPLE = 8_192
#: A block of candidates has so many bytes of vectors at most; there are so many blocks at least.
BLOCK_BYTES, BLOCKS = 32 << 20, 16
#: A cluster has so many anchors on average at least, where there are few.
MEMBERS = 16
#: Anchors that walk together, candidates in a step, and anchors for which a task reads a block once.
TOGETHER, STEP, SLAB = 512, 1024, 65_536


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, no component NULL or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def _centres(rows: np.ndarray, k: int) -> np.ndarray:
    """Directions of spherical k-means, started at every n-th row of the sample."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    centres = unit[:: max(1, len(unit) // k)][:k].copy()
    for _ in range(12):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.arccos(np.clip(rows @ centres.T / np.maximum(norms, 1e-300), -1.0, 1.0))


class Block:
    """A block of candidates, and the order and bounds that each cluster sees them in."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> None:
        self.ids, self.labels, self.vectors, self.spread, self.centres = ids, labels, vectors.astype(np.float64), spread, centres
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.of, self.order, self.bounds = -1, np.empty(0, np.int64), np.empty(0)
        largest = int(np.abs(vectors).max(initial=0))
        self.room = (largest, vectors.shape[1])

    def listed(self, cluster: int) -> None:
        """Sorts the candidates for a cluster, unless they are."""
        if cluster != self.of:
            angle = _angles(self.vectors, self.centres[cluster:cluster + 1])[:, 0]
            bound = self.norms * np.cos(np.maximum(0.0, angle - self.spread[cluster]))
            self.order = np.argsort(-bound, kind="stable")
            self.of, self.bounds = cluster, np.append(bound[self.order], -np.inf)

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact integer inner products: in doubles where every sum stays below 2^53, in 64-bit integers above."""
        worst = int(np.abs(anchors).max(initial=0)) * self.room[0] * max(1, self.room[1])
        if worst < 1 << 53:
            return (anchors.astype(np.float64) @ self.vectors[rows].T).astype(np.int64)
        if worst < 1 << 63:
            return anchors @ self.vectors[rows].T.astype(np.int64)
        raise OverflowError("inner products may pass 64 bits")


def _limit(anchors: np.ndarray, bound: float) -> np.ndarray:
    """What an anchor's score with anything of that bound cannot pass, rounding included."""
    length = np.linalg.norm(anchors.astype(np.float64), axis=1)
    return length * bound + 1e-7 * length * abs(bound) + 0.5


#: Stands for no score; its negative is a number too.
_NONE = np.iinfo(np.int64).min + 1


def _merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first of kept and further rows by score, then smaller id; what is not there has the least score."""
    both, names = np.concatenate([scores, more], axis=1), np.concatenate([ids, np.broadcast_to(of, more.shape)], axis=1)
    if both.shape[1] > 8 * k:  # what is below the k-th of its row cannot be among the first
        least = np.partition(both, -k, axis=1)[:, -k]
        width = int((both >= least[:, None]).sum(axis=1).max())
        if width < both.shape[1]:
            some = np.argpartition(-both, width - 1, axis=1)[:, :width] if width else np.empty((len(both), 0), int)
            both, names = np.take_along_axis(both, some, 1), np.take_along_axis(names, some, 1)
    order = np.lexsort((names, -both), axis=1)[:, :k]
    return np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def walk(block: Block, cluster: int, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, bands: np.ndarray | None, k: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, band, id, score) of the first ``k`` candidates in the block: of the anchor's own label where ``bands`` is None, else of other labels, per band below a score.

    ``bands`` has a row of scores for each anchor, the least integer where there are fewer. A walk ends when all members are certified:
    the next bound is below the last kept score, or below what the band takes in.
    """
    block.listed(cluster)
    n, slots = len(anchors), 1 if bands is None else bands.shape[1]
    tops = np.full((n, slots, k), _NONE)
    names = np.zeros((n, slots, k), np.int64)
    floor = None if bands is None else np.where(bands == _NONE, np.iinfo(np.int64).max, -((-least * bands.astype(object)) // 100)).astype(np.float64)
    active = np.arange(n)
    for at in range(0, len(block.order), STEP):
        beyond = _limit(anchors[active], float(block.bounds[at]))
        last = tops[active][:, :, -1].astype(np.float64)
        if bands is None:
            wants = (last <= beyond[:, None]).any(axis=1)
        else:
            wants = ((last <= beyond[:, None]) & (floor[active] <= beyond[:, None])).any(axis=1)
        active = active[wants]
        if not len(active):
            break
        rows = block.order[at:at + STEP]
        scores = block.scores(anchors[active], rows)
        other = block.ids[rows][None, :] != ids[active][:, None]
        same = block.labels[rows][None, :] == labels[active][:, None]
        fits = other & (same if bands is None else ~same)
        for s in range(slots):
            take = fits
            if bands is not None:
                band = bands[active, s][:, None]
                take = fits & (scores <= band) & (band != _NONE) & (scores >= floor[active, s][:, None])
            take = take & (scores >= tops[active, s, -1][:, None])
            some = np.flatnonzero(take.any(axis=1))
            if len(some):
                who = active[some]
                tops[who, s], names[who, s] = _merged(tops[who, s], names[who, s], np.where(take[some], scores[some], _NONE), block.ids[rows][None, :], k)
    who, band, place = np.nonzero(tops != _NONE)
    return who, band, names[who, band, place], tops[who, band, place]


def _matrix(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def _walks(rows: DataFrame, centres: np.ndarray, spread: np.ndarray, banded: bool, k: int, least: int) -> DataFrame:
    """Runs ``walk`` over candidates (``cluster`` NULL) and anchors, dealt by ``block`` and ``slab`` and sorted so that candidates come first."""
    sent = rows.sparkSession.sparkContext.broadcast((centres, spread))  # clusters x length numbers, whatever the corpus

    def searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, spread = sent.value
        key, held, block = None, [], None

        def results(part: pa.RecordBatch, block: Block) -> Iterator[pa.RecordBatch]:
            clusters = part.column("cluster").to_numpy()
            for cluster in np.unique(clusters):
                mine = part.filter(pa.array(clusters == cluster))
                for at in range(0, mine.num_rows, TOGETHER):
                    some = mine.slice(at, TOGETHER)
                    vectors, names = _matrix(some.column("v"), some.num_rows, np.int64), some.column("anchor").to_numpy()
                    bands = None
                    if banded:
                        lists = some.column("bands").to_pylist()
                        bands = np.array([[*b, *[_NONE] * (max(map(len, lists)) - len(b))] for b in lists], np.int64)
                    who, band, ids, scores = walk(block, int(cluster), vectors, some.column("id").to_numpy(), some.column("label").to_numpy(), bands, k, least)
                    positives = scores if bands is None else bands[who, band]
                    yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(positives), pa.array(ids), pa.array(scores)], names=["anchor", "band", "near_id", "score"])

        for part in parts:
            blocks, slabs = part.column("block").to_numpy(), part.column("slab").to_numpy()
            starts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (slabs[1:] != slabs[:-1])]).tolist() if part.num_rows else []
            for a, b in zip(starts, [*starts[1:], part.num_rows], strict=True):
                if (blocks[a], slabs[a]) != key:
                    key, held, block = (blocks[a], slabs[a]), [], None
                some = part.slice(a, b - a)
                candidates = some.filter(some.column("cluster").is_null())
                if candidates.num_rows:
                    held.append((candidates.column("id").to_numpy(), candidates.column("label").to_numpy(), _matrix(candidates.column("v"), candidates.num_rows, np.int64)))
                anchors = some.filter(some.column("cluster").is_valid())
                if anchors.num_rows and (held or block):
                    if block is None:
                        block = Block(*[np.concatenate(x) for x in zip(*held, strict=True)], centres, spread)
                        held = []
                    yield from results(anchors, block)

    return rows.mapInArrow(searched, "anchor bigint, band bigint, near_id bigint, score bigint")


def mine(vectors: DataFrame, anchors: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE, clusters: int = CLUSTERS, sample: int = SAMPLE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for the rows that ``anchors`` (over ``id``) selects.

    Scores are exact inner products of the vectors' components, each floored after multiplying by ``scale``. An anchor's
    positives are its first rows of the same label, its negatives those of another label whose score is at most the
    positive's and at least ``least`` hundredths of it; ties go to the smaller id. Rows with a NULL id or label, or a vector that is NULL or
    holds a NULL or a number that is not finite, take no part, nor do vectors of another length than most. Of rows with equal
    id, label and vector one counts; rows that share an id are no candidates of each other. Zero vectors score 0.
    Nothing is left out of the search: walks end on certified bounds only. Scores that may pass 64 bits are an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    taken = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"), F.col(vector_column).cast("array<double>").alias("x")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))
    sizes = taken.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    length, total = (sizes[0].n, sizes[0]["count"]) if sizes else (0, 0)
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not total:
        return spark.createDataFrame([], result)
    n_blocks = max(BLOCKS, -(-total * max(1, length) * 8 // BLOCK_BYTES))
    path = scratch_path(spark, "integer-vectors")
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    # Of equal vectors of a label only the smallest ids can be in a result: they tie in every score. One of them may be the anchor.
    kept = max(positives, negatives) + 1
    taken.where(F.size("x") == length).select("id", "label", whole.alias("v")).distinct().write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    first = Window.partitionBy("label", "v").orderBy("id")
    rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= kept).select("id", "label", "v", F.pmod(F.xxhash64("v", "label"), F.lit(n_blocks)).cast("int").alias("block")).write.parquet(f"{path}/candidates")
    candidates = spark.read.parquet(f"{path}/candidates")

    asked = rows.where(anchors).withColumn("anchor", F.xxhash64("id", "label", "v"))
    n_anchors = asked.count()
    if not n_anchors:
        return spark.createDataFrame([], result)
    share = min(1.0, 1.5 * sample / n_anchors + 50.0 / n_anchors)
    some = asked.where(F.pmod(F.xxhash64("anchor"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy("anchor").limit(sample).select("v").toArrow().column("v").combine_chunks()
    # The sample is bounded; should chance leave it empty, one cluster in any direction serves as well.
    centres = _centres(_matrix(some, len(some), np.float64), max(1, min(clusters, n_anchors // MEMBERS))) if len(some) and length else np.zeros((1, length))
    asked = _clustered(asked, centres)
    wide = dict(asked.groupBy("cluster").agg(F.max("angle").alias("a")).select("cluster", "a").collect())
    spread = np.array([wide.get(c, 0.0) + 1e-6 for c in range(len(centres))])
    slabs = -(-n_anchors // SLAB)
    asked = asked.withColumn("slab", F.pmod("cluster", F.lit(slabs)) if slabs <= len(centres) // 4 else F.pmod(F.xxhash64("anchor"), F.lit(slabs))).withColumn("slab", F.col("slab").cast("int"))
    tasks = min(n_blocks * slabs, 20_000)
    copies = candidates.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")

    def walked(anchors_: DataFrame, banded: bool, k: int) -> DataFrame:
        bands = [F.col("bands") if banded else F.lit(None).cast("array<bigint>").alias("bands")]
        nobody = [F.lit(None).cast("bigint").alias("anchor"), F.lit(None).cast("array<bigint>").alias("bands"), F.lit(None).cast("int").alias("cluster")]
        both = copies.select("block", "slab", "id", "label", "v", *nobody).unionAll(anchors_.select(every, "slab", "id", "label", "v", "anchor", *bands, "cluster"))
        dealt = both.repartition(tasks, "block", "slab").sortWithinPartitions("block", "slab", F.asc_nulls_first("cluster"))
        return _walks(dealt, centres, spread, banded, k, least)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "near_id")
    near = walked(asked, False, positives).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).select("anchor", F.col("near_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near.write.parquet(f"{path}/positives")
    near = spark.read.parquet(f"{path}/positives")
    # A negative's score lies between a share of the positive's and that score: below zero there is none.
    bands = near.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("bands"))  # at most ``positives`` numbers
    best = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "near_id")
    found = walked(asked.join(bands, "anchor"), True, negatives).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return near.withColumnRenamed("positive_score", "band").join(found, ["anchor", "band"]).join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("near_id").alias("negative_id"), F.col("band").alias("positive_score"), F.col("score").alias("negative_score"))


def _clustered(asked: DataFrame, centres: np.ndarray) -> DataFrame:
    """``asked`` with the nearest ``cluster`` of each anchor and its ``angle`` to that centre."""
    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                angles = _angles(_matrix(part.column("v"), part.num_rows, np.float64), centres)
                own = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], names=[*part.schema.names, "cluster", "angle"])

    return asked.select("id", "label", "v", "anchor").mapInArrow(nearest, "id bigint, label bigint, v array<bigint>, anchor bigint, cluster int, angle double")


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10, id_column: str = "vec_id", label_column: str = "label") -> DataFrame:
    """``vectors`` with the next label on every n-th id."""
    moved = F.when(F.col(id_column) % every == 0, (F.col(label_column) + 1) % labels).otherwise(F.col(label_column))
    return vectors.withColumn(label_column, moved)
