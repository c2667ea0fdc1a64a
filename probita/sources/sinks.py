"""Writers: plain lines, sealed rows, and the append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALGORITHM = "AES-256-GCM"
VERSION = 1


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bound_header(artifact_type: str) -> Column:
    """What the seal covers besides the content: version, algorithm and kind."""
    return F.lit(f"{VERSION}|{ALGORITHM}|{artifact_type}")


def seal(df: DataFrame, key: Column, key_id: str, artifact_type: str, keep: list[str]) -> DataFrame:
    """Each row as one encrypted value with a fresh nonce; ``keep`` columns stay readable."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(
        *keep, F.lit(VERSION).alias("version"), F.lit(ALGORITHM).alias("algorithm"), F.lit(key_id).alias("key_id"),
        F.lit(artifact_type).alias("artifact_type"),
        F.aes_encrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), bound_header(artifact_type)).alias("sealed"))


def unseal(df: DataFrame, key: Column, artifact_type: str) -> Column:
    """The content, or NULL where key, content or header do not belong together."""
    return F.try_aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), bound_header(artifact_type)).cast("string")


def check_seals(df: DataFrame, key: Column, artifact_type: str) -> DataFrame:
    """Counts of rows that open, and of rows that still open after their last byte is changed (should be 0)."""
    length = F.octet_length("sealed")
    last = F.conv(F.hex(F.substring(F.col("sealed"), length, F.lit(1))), 16, 10).cast("int")
    flipped = F.unhex(F.concat(F.hex(F.substring(F.col("sealed"), F.lit(1), length - 1)), F.lpad(F.hex(last.bitwiseXOR(F.lit(255))), 2, "0")))
    return df.select(
        unseal(df, key, artifact_type).isNotNull().alias("opens"),
        F.try_aes_decrypt(flipped, key, F.lit("GCM"), F.lit("DEFAULT"), bound_header(artifact_type)).isNotNull().alias("opens_changed"),
    ).agg(F.count(F.lit(1)).alias("sealed_rows"), F.count_if("opens").alias("opened"), F.count_if("opens_changed").alias("opened_after_change"))


def append_events(spark: SparkSession, events: DataFrame, path: str) -> None:
    """Append events whose id the log does not hold yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = events.dropDuplicates(["event_id"])
    if exists:
        fresh = fresh.join(spark.read.parquet(path).select("event_id"), "event_id", "left_anti")
    fresh.write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("event_id")
