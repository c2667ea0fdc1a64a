"""Steps that are written to the shared folder leave nothing else on the disks."""

import pathlib
import time

import pytest
from pyspark.sql import functions as F

from probita.llm import components, jaccard
from probita.session import RELEASE, cut_lineage, released


def shuffle_files(spark):
    """Names of the shuffle files that lie in the executor's local folders."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for f in folders for p in pathlib.Path(f.getPath()).rglob("shuffle_*")}


def left(spark, before):
    """Shuffle files that are new since; the engine drops files beside its other work, so it gets some seconds."""
    for _ in range(50):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_a_step_leaves_its_rows_and_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counts = spark.range(1_000).groupBy((F.col("id") % 10).alias("k")).count()
    held = cut_lineage(counts.join(counts.select(F.col("k"), F.col("count").alias("again")), "k"))
    assert not left(spark, before)
    assert sorted(map(tuple, held.collect())) == [(k, 100, 100) for k in range(10)]
    assert sorted(map(tuple, cut_lineage(counts).collect())) == sorted(map(tuple, counts.collect()))


def test_frames_keep_their_columns_and_may_be_empty(spark):
    pair = spark.range(3).crossJoin(spark.range(3))
    assert cut_lineage(pair).columns == ["id", "id"] and cut_lineage(pair).count() == 9
    assert cut_lineage(spark.range(0).distinct()).collect() == []


def test_components_leave_no_shuffle_files(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60) if k % 10 != 9], "u long, v long")
    before = shuffle_files(spark)
    roots = components.components(edges)
    assert not left(spark, before)
    assert {r.node: r.root for r in roots.collect()} == {k: k // 10 * 10 for k in range(60) if k % 10}


def test_near_copies_leave_the_files_of_few_shuffles(spark):
    """A shuffle that the engine finds needless while it runs may end after its action and stay; of the others nothing does."""
    words = [[f"w{family}_{n}" for n in range(60)] for family in range(20)]
    rows = [(k, " ".join([*words[k % 20], f"end{k}"])) for k in range(60)]
    before = shuffle_files(spark)
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    shuffles = {name.split("_")[1] for name in left(spark, before)}
    assert len(shuffles) < 8, shuffles
    assert {r.doc_id: r.component_id for r in found.collect()} == {k: k % 20 for k in range(60)}


@pytest.mark.parametrize("was", [None, "false", "true"])
def test_the_setting_is_put_back_and_a_second_action_is_right(spark, was):
    if was:
        spark.conf.set(RELEASE, was)
    try:
        sums = released(spark.range(100).groupBy((F.col("id") % 4).alias("k")).agg(F.sum("id").alias("s")))
        assert spark.conf.get(RELEASE, None) == was
        with pytest.raises(Exception):  # noqa: B017
            cut_lineage(spark.range(3).select(F.raise_error(F.lit("no"))))
        assert spark.conf.get(RELEASE, None) == was
    finally:
        spark.conf.unset(RELEASE)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, sums.collect())) == [(k, sum(range(k, 100, 4))) for k in range(4)]
