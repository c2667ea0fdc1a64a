"""Joins and rankings that stay balanced when one key holds a large share of the rows.

Every helper finds the heavy keys first, by a partial aggregate. A key is heavy when it holds more
than one ``SHARE``-th of the rows, so there can be at most ``SHARE`` of them: the list is safe to
broadcast whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE = 200
FLOOR = 50_000  # below this many rows a key is never worth splitting
FEW = 10_000  # pairs of texts that are compared without an index


def heavy_keys(df: DataFrame, keys: list[str], share: int = SHARE, floor: int = FLOOR, counts: DataFrame | None = None) -> DataFrame:
    """Keys with too many rows for one task, and the number of ``parts`` to split each into; ``counts`` are the keys' ``_rows`` where they are known."""
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    share_size = counts.select((F.sum("_rows") / F.lit(share)).alias("s")).scalar()
    chunk = F.greatest(F.coalesce(share_size, F.lit(0.0)), F.lit(float(floor)))
    return counts.where(F.col("_rows") > chunk).select(*keys, F.ceil(F.col("_rows") / chunk).cast("int").alias("_parts"))


def _parts(df: DataFrame, heavy: DataFrame, keys: list[str], name: str) -> DataFrame:
    found = heavy.withColumnRenamed("_parts", name)
    return df.join(F.broadcast(found), keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    both: bool = False,
    share: int = SHARE,
    floor: int = FLOOR,
    spread: bool = False,
    keys_from: DataFrame | None = None,
    counts: DataFrame | None = None,
    merge: bool = False,
) -> DataFrame:
    """Equi-join whose heavy keys are spread over many tasks.

    Rows of the left side with a heavy key are scattered over that key's parts by a hash of the
    row, and the right side's rows of the key are repeated once per part. With ``both`` the right
    side is scattered as well (inner joins only). ``spread`` keeps the session's full number of
    partitions where a join of few bytes makes much work. ``keys_from`` is a cheaper frame to find
    the left side's heavy keys in, where the left side itself is the result of a shuffle; ``counts``
    (keys and ``_rows``) saves finding them. ``merge`` never broadcasts a side, where the engine would take it for a smaller one. The result is the plain join's, row for row.
    """
    if both and how != "inner":
        raise ValueError("both sides can only be split for an inner join")
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    right_hash = F.xxhash64(*[F.col(c) for c in right.columns])
    left_heavy = heavy_keys(left if keys_from is None else keys_from, keys, share, floor, counts)
    left, right = _parts(left, left_heavy, keys, "_lp"), _parts(right, left_heavy, keys, "_lp")
    scatter = ["_ls"]
    if both:
        scatter = ["_ls", "_rs"]
        right_heavy = heavy_keys(right.drop("_lp"), keys, share, floor)
        left, right = _parts(left, right_heavy, keys, "_rp"), _parts(right, right_heavy, keys, "_rp")
        left = left.withColumn("_rs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rp").cast("long") - 1))).drop("_rp")
        right = right.withColumn("_rs", F.pmod(right_hash, F.col("_rp"))).drop("_rp")
    scattered_left = left.withColumn("_ls", F.when(F.col("_lp") > 1, F.pmod(row_hash, F.col("_lp"))).otherwise(F.lit(0).cast("long"))).drop("_lp")
    scattered_right = right.withColumn("_ls", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lp").cast("long") - 1))).drop("_lp")
    if spread:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        scattered_left = scattered_left.repartition(partitions, *keys, *scatter)
    if merge:
        scattered_left, scattered_right = scattered_left.hint("merge"), scattered_right.hint("merge")
    return scattered_left.join(scattered_right, [*keys, *scatter], how).drop(*scatter)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key.

    Spark trims every map task to ``n`` rows per key before the shuffle, so a heavy key costs
    ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def dense_position(df: DataFrame, keys: list[str], slot: Column, order: list[Column], name: str = "seq") -> DataFrame:
    """1-based position of each row within its key, without one task holding the whole key.

    ``slot`` is a coarse step of the same order (an hour, a day, an id range). Rows are numbered
    within each slot; the slots' sizes, a small table, are summed up per key and added.
    """
    slotted = df.withColumn("_slot", slot)
    sizes = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(
        F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select(*keys, "_slot", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order))
    return (
        slotted.withColumn("_inside", inside)
        .join(offsets, [*keys, "_slot"])
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_inside", "_before", "_slot")
    )


def contains_join(
    needles: DataFrame, haystacks: DataFrame, by: list[str] | None = None,
    needle: str = "needle", haystack: str = "haystack", share: int | None = None, floor: int = FLOOR,
) -> DataFrame:
    """Pairs in which the haystack text holds the needle text, as an equi-join.

    A haystack that holds a needle holds each of the needle's three-letter pieces. Each needle is
    therefore looked up under its rarest piece only, and the text is compared for those pairs.
    Needles shorter than three letters are looked up whole. ``by`` limits pairs to equal keys.
    A piece with more than a ``share``-th of all pieces (by default about what a shuffle partition
    holds, so there are at most as many as partitions) is spread over tasks, its needles repeated.
    Both texts should be distinct (per ``by``); the result has ``by``, needle and haystack.
    With ``by``, a key with at most ``FEW`` pairs of texts has them compared as they are: that is less than its pieces are.
    """
    by = by or []
    if by:
        needles, haystacks = needles.where(F.length(needle) > 0), haystacks.where(F.col(haystack).isNotNull())
        sizes = needles.groupBy(*by).agg(F.count(F.lit(1)).alias("_a")).hint("merge").join(haystacks.groupBy(*by).agg(F.count(F.lit(1)).alias("_b")), by)
        sizes = sizes.select(*by, (F.col("_a") * F.col("_b") > FEW).alias("_many"))
        sized = needles.hint("merge").join(sizes.hint("merge"), by)
        few = sized.where(~F.col("_many")).drop("_many").hint("merge").join(haystacks.hint("merge"), by).where(F.contains(F.col(haystack), F.col(needle)))
        many = sizes.where("_many").select(*by)
        return few.select(*by, needle, haystack).unionByName(_piece_join(
            sized.where("_many").drop("_many"), haystacks.join(many, by, "left_semi"), by, needle, haystack, share, floor))
    return _piece_join(needles, haystacks, by, needle, haystack, share, floor)


def _piece_join(needles: DataFrame, haystacks: DataFrame, by: list[str], needle: str, haystack: str, share: int | None, floor: int) -> DataFrame:
    """``contains_join`` by pieces. Joins with pieces are never broadcast: the engine sizes them by the texts they are cut from."""
    if share is None:
        share = max(SHARE, int(needles.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pieces(text: Column, size: int) -> Column:
        last = F.length(text) - F.lit(size - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(size))))

    text = F.col(needle)
    own = (
        F.when(F.length(text) >= 3, pieces(text, 3)).otherwise(F.array(text))
    )
    needles = needles.where(F.length(text) > 0)
    wanted = needles.select(*by, needle, F.size(own).alias("_pieces"), F.explode(own).alias("_piece"))
    hay = F.col(haystack)
    filed = haystacks.select(
        *by, haystack, F.explode(F.concat(pieces(hay, 1), pieces(hay, 2), pieces(hay, 3))).alias("_piece")
    ).join(wanted.select(*by, "_piece").distinct().hint("merge"), [*by, "_piece"], "left_semi")
    frequency = filed.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    rarest = (
        wanted.hint("merge").join(frequency.hint("merge"), [*by, "_piece"])
        .groupBy(*by, needle)
        .agg(F.min(F.struct("_rows", "_piece")).alias("_best"), F.count(F.lit(1)).alias("_found"), F.first("_pieces").alias("_pieces"))
        .where(F.col("_found") == F.col("_pieces"))
        .select(*by, needle, F.col("_best._piece").alias("_piece"))
    )
    pairs = skew_join(filed, rarest, [*by, "_piece"], share=share, floor=floor, counts=frequency, merge=True)
    return pairs.where(F.contains(F.col(haystack), F.col(needle))).select(*by, needle, haystack)
