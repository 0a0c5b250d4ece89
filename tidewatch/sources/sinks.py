"""Sinks: Parquet with zstd, partition replacement, upsert, broker, CSV for figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The serving tables.
TABLES = {
    "assets": "asset_id string, description string, sensor_count int, sampling_hz double",
    "anomalies": "anomaly_id long, started_at timestamp_ntz, ended_at timestamp_ntz, peak_score double, threshold double, matched_failure string, lead_hours double, asset_id string, method string",
    "documented_failures": "failure_id string, started_at timestamp_ntz, ended_at timestamp_ntz, kind string, asset_id string",
}
PARTITIONS = {"assets": [], "anomalies": ["asset_id", "method"], "documented_failures": ["asset_id"]}


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*(by or [])).parquet(path)


def write_series(df: DataFrame, path: str) -> None:
    """The score cache: partitioned by method and feature set, replaced by partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "features").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def bootstrap(spark: SparkSession, root: str) -> None:
    """Creates empty serving tables where there are none."""
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        empty.write.mode("ignore").partitionBy(*PARTITIONS[name]).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def replace_partitions(df: DataFrame, root: str, name: str) -> None:
    """Replaces just the partitions that occur in `df`; doing it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[name]).parquet(f"{root}/{name}")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` in place of those of `old` with the same keys; other rows stay."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"))
    return both.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__new")


def broker_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Writes a streaming `value` column to a Kafka topic; needs the connector on the class path."""
    return (
        df.select(F.col("value").cast("string")).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("kafka.compression.type", "lz4").option("topic", topic).option("checkpointLocation", checkpoint).start()
    )


def wire_records(df: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """`value`: JSON records with ISO times, as producers send them."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    extra = [F.col("injected").alias("_injected")] if "injected" in df.columns else []
    return df.select(F.to_json(F.struct(*columns, stamp, *extra)).alias("value"))
