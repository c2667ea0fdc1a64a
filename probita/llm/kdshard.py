"""Sharding by a k-d tree over the rows' metadata, with distributed weighted medians.

Nothing but column expressions and aggregates. The driver sees histograms of a bounded number of buckets: a median is
found by refining the bucket that holds it, for all nodes of a level in one pass over a narrow table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probita.session import scratch_path

#: Buckets a median is refined by in a pass.
FAN = 2048
#: A group of equal texts heavier than one n-th of a shard is dealt out in parts of about that weight.
PART_OF_SHARD = 32
#: A median is fine enough when its bucket weighs no more than one n-th of a shard.
CLOSE = 2000
#: Rows that are numbered together.
CELL_ROWS = 20_000
TIE_BITS = 31
DIMENSIONS = ("bytes", "id", "lang", "source")


@dataclass
class _Node:
    """A part of the tree: how many leaves it gets, which items it holds, and where it is cut."""

    leaves: int
    first: int
    test: str = "true"
    dimension: int = 0
    value: int = 0
    tie: int = 0
    children: list[_Node] = field(default_factory=list)


def _letters(c: Column) -> Column:
    """The first six bytes of a string as a number in the order of the strings; NULL before all others."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long") + 1, F.lit(0).cast("long"))


def _items(base: DataFrame, total: int, shards: int) -> DataFrame:
    """Groups of equal texts with their weight and coordinates, heavy ones in parts; ``base`` gets the number of its part."""
    keys = ["hash", "text_crc32", "size"]
    limit = max(1, total // (shards * PART_OF_SHARD))
    # At most shards * PART_OF_SHARD groups can weigh more than that, so their table is small whatever the input.
    heavy = base.groupBy(*keys).agg(F.sum("size").alias("weight")).where((F.col("weight") > limit) & (F.col("weight") > F.col("size"))).select(
        *keys, F.ceil(F.col("weight") / limit).cast("int").alias("parts"))
    return base.join(F.broadcast(heavy), keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")


def _extents(items: DataFrame) -> list[str]:
    return [f"{f}(x{d}) as {f}{d}" for d in range(len(DIMENSIONS)) for f in ("min", "max")]


def _cut(items: DataFrame, nodes: list[_Node], spans: list[int], close: float) -> None:
    """Finds where each node is cut: widest dimension, weighted median of (coordinate, tie), nearest bucket edge."""
    which = "case " + " ".join(f"when {n.test} then {i}" for i, n in enumerate(nodes)) + " end"
    placed = items.selectExpr("*", f"{which} as node").where("node is not null")
    state = {}
    for row in placed.groupBy("node").agg(F.sum("w").alias("w"), *[F.expr(x) for x in _extents(items)]).collect():
        node = nodes[row.node]
        widths = [(row[f"max{d}"] - row[f"min{d}"]) / spans[d] if spans[d] else 0.0 for d in range(len(DIMENSIONS))]
        node.dimension = max(range(len(DIMENSIONS)), key=lambda d: (widths[d], -d))
        d = node.dimension
        # Aim at the share of the leaves that go left; ``below`` is what lies under the current range.
        state[row.node] = {"aim": row.w * (node.leaves // 2) / node.leaves, "below": 0, "low": row[f"min{d}"], "high": row[f"max{d}"] + 1, "level": "value", "at": None}
    while open_nodes := {i: s for i, s in state.items() if s["level"] != "done"}:
        conditions, buckets = [], []
        for i, s in open_nodes.items():
            coordinate = f"x{nodes[i].dimension}"
            width = -(-(s["high"] - s["low"]) // FAN)
            s["width"] = width
            column = coordinate if s["level"] == "value" else "tie"
            inside = f"{column} >= {s['low']} and {column} < {s['high']}" + (f" and {coordinate} = {s['at']}" if s["level"] == "tie" else "")
            conditions.append(f"(node = {i} and {inside})")
            buckets.append(f"when node = {i} then ({column} - {s['low']}) div {width}")
        found = placed.where(" or ".join(conditions)).groupBy("node", F.expr("case " + " ".join(buckets) + " end").alias("bucket")).agg(F.sum("w").alias("w")).collect()
        for i, s in open_nodes.items():
            weights = sorted((r.bucket, r.w) for r in found if r.node == i)
            below = s["below"]
            for bucket, weight in weights:
                if below + weight >= s["aim"] or bucket == weights[-1][0]:
                    break
                below += weight
            low = s["low"] + bucket * s["width"]
            fine = weight <= close
            single = s["width"] == 1
            if fine or (single and s["level"] == "tie"):
                # The cut goes to the nearer edge of the bucket.
                edge = low if s["aim"] - below <= below + weight - s["aim"] else low + s["width"]
                nodes[i].value, nodes[i].tie = (edge, 0) if s["level"] == "value" else (s["at"], edge)
                s["level"] = "done"
            elif single:
                s |= {"level": "tie", "at": low, "low": 0, "high": 1 << TIE_BITS, "below": below}
            else:
                s |= {"low": low, "high": min(low + s["width"], s["high"]), "below": below}


def tree(items: DataFrame, leaves: int, close: float) -> list[_Node]:
    """The leaves of the tree, each with the SQL test of its items."""
    whole = items.selectExpr(*_extents(items)).first()
    spans = [(whole[f"max{d}"] or 0) - (whole[f"min{d}"] or 0) for d in range(len(DIMENSIONS))]
    level, done = [_Node(leaves, 0)], []
    while level:
        done += [n for n in level if n.leaves == 1]
        level = [n for n in level if n.leaves > 1]
        if level:
            _cut(items, level, spans, close)
        below = []
        for n in level:
            x = f"x{n.dimension}"
            left = f"({x} < {n.value} or ({x} = {n.value} and tie < {n.tie}))"
            below += [_Node(n.leaves // 2, n.first, f"{n.test} and {left}"), _Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2, f"{n.test} and not {left}")]
        level = below
    return done


def numbered(rows: DataFrame, group: str, order: list[str], total: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each ``group``: rows are counted in cells and numbered within them."""
    cells = max(1, total // CELL_ROWS)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(group, "cell").count().select(group, "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(group, "cell").orderBy(*order)) - 1
    return rows.withColumn("within", within).join(offsets, [group, "cell"]).withColumn("slot", F.col("offset") + F.col("within")).drop("cell", "offset", "within")


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_column: str = "doc_id", text_column: str = "text",
           lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` for every row: shards of nearly equal bytes.

    Give the number of shards or the bytes a shard should reach. A row's size is its text in UTF-8 plus one; a NULL text
    has no bytes and checksum 0. The tree is cut over groups of equal texts, so copies stay together unless their group
    weighs more than a small part of a shard, or a cut falls between such parts; ties of a coordinate are broken by a
    hash, so one value may hold all rows. NULL languages, sources and ids sort first. Repeated rows are rows like any
    other, an empty table gives no rows, and with fewer rows than shards some stay empty. Only the named columns are read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    path = scratch_path(spark, "sharding")
    docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
                F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("row"), _letters(F.col(lang_column).cast("string")).alias("lang"), _letters(F.col(source_column).cast("string")).alias("source"),
                ).write.parquet(f"{path}/rows")
    base = spark.read.parquet(f"{path}/rows")
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    leaves = shards or max(1, -(-total // target_bytes))
    parted = _items(base, total, leaves)
    keys = ["hash", "text_crc32", "size", "part"]
    tie = F.pmod(F.xxhash64(*keys, F.lit("tie")), F.lit(1 << TIE_BITS))
    parted.groupBy(*keys).agg(F.sum("size").alias("w"), F.min("row").alias("x1"), F.min("lang").alias("x2"), F.min("source").alias("x3")).select(
        *keys, "w", F.col("size").alias("x0"), "x1", "x2", "x3", tie.alias("tie")).write.parquet(f"{path}/items")
    items = spark.read.parquet(f"{path}/items")
    found = tree(items, leaves, total / leaves / CLOSE)
    placed = items.select(*keys, F.expr("case " + " ".join(f"when {n.test} then {n.first}" for n in found) + " end").alias("shard"))
    parted.join(placed, keys).select("doc_id", "size", "text_crc32", "hash", "shard").write.parquet(f"{path}/placed")
    return numbered(spark.read.parquet(f"{path}/placed"), "shard", ["doc_id", "hash", "text_crc32"], rows).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, id_column: str = "doc_id", text_column: str = "text", **columns: str) -> None:
    """Writes ``docs`` as Parquet below ``path``, a folder ``shard=n`` for each shard (``_shard`` where the name is taken).

    Rows with equal ids and texts go to one shard.
    """
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    placed = assign(docs, shards, None, id_column, text_column, **columns).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("_s")).select(F.col("doc_id").alias("_i"), F.col("text_crc32").alias("_c"), "_s")
    key = F.crc32(F.encode(F.coalesce(docs[text_column].cast("string"), F.lit("")), "UTF-8"))
    docs.join(placed, docs[id_column].eqNullSafe(placed["_i"]) & (key == placed["_c"])).select(*[docs[c] for c in docs.columns], placed["_s"].alias(name)).write.partitionBy(name).parquet(path)
