"""Readings: files, JSON records, the events table as a stream of assets, ground truth, synthetic data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Channel names, in order, and plausible ranges of the compressor data set.
ANALOG = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current")
DIGITAL = ("COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses")
RANGES = {
    "TP2": (-1.0, 12.0),
    "TP3": (-1.0, 12.0),
    "H1": (-1.0, 12.0),
    "DV_pressure": (-1.0, 12.0),
    "Reservoirs": (-1.0, 12.0),
    "Oil_temperature": (-20.0, 120.0),
    "Motor_current": (-1.0, 15.0),
}
# The documented failures.
DOCUMENTED = (
    ("failure-1", "2020-04-18 00:00:00", "2020-04-18 23:59:00"),
    ("failure-2", "2020-05-29 23:30:00", "2020-05-30 06:00:00"),
    ("failure-3", "2020-06-05 10:00:00", "2020-06-07 14:30:00"),
    ("failure-4", "2020-07-15 14:30:00", "2020-07-15 19:00:00"),
)
# Failure intervals for the driver's events table, which covers January 2024.
EVENTS = (
    ("leak-1", "2024-01-05 03:00:00", "2024-01-05 15:00:00"),
    ("leak-2", "2024-01-12 00:00:00", "2024-01-12 23:59:00"),
    ("leak-3", "2024-01-19 10:30:00", "2024-01-19 16:30:00"),
    ("leak-4", "2024-01-26 18:00:00", "2024-01-27 12:00:00"),
)
FEATURE_SETS = {"analog": (ANALOG, ()), "analog+duty": (ANALOG, DIGITAL)}

SENSOR_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, T.FloatType()) for c in ANALOG]
    + [T.StructField(c, T.ByteType()) for c in DIGITAL]
)


def feature_columns(name: str) -> list[str]:
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name!r}")
    analog, duty = FEATURE_SETS[name]
    return [*analog, *duty]


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """The sensor file: pruned to the known columns, narrow types, dates parsed; bad fields are null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    kinds = {f.name: f.dataType for f in SENSOR_SCHEMA}
    held = set(raw.columns)

    def one(name: str) -> Column:
        if name not in held:
            return F.lit(None).cast(kinds[name])
        if name == "timestamp":
            return F.expr("try_to_timestamp(`timestamp`)").cast("timestamp_ntz")
        return F.expr(f"try_cast(try_cast(`{name}` as double) as {kinds[name].simpleString()})")

    return raw.select(*(one(f.name).alias(f.name) for f in SENSOR_SCHEMA))


def decode_json(df: DataFrame, channels: list[str], value: str = "value") -> DataFrame:
    """Adds `record` (map of channel to double), `ts`, `decoded`: false for what is no JSON object.

    Numbers may come as text; what cannot be read as a number is NaN, a bad timestamp null.
    """
    json = F.col(value).cast("string")
    kind = F.expr(f"try_parse_json(cast(`{value}` as string))")
    is_object = F.coalesce(F.schema_of_variant(kind).startswith("OBJECT"), F.lit(False))

    def field(name: str) -> Column:
        got = F.get_json_object(json, f"$['{name}']")
        return F.coalesce(got.try_cast("double"), F.lit(float("nan")))

    out = df.withColumn("decoded", is_object)
    out = out.withColumn("vector", F.array(*(field(c) for c in channels)))
    out = out.withColumn("injected", F.coalesce(F.get_json_object(json, "$._injected") == "true", F.lit(False)))
    stamp = F.get_json_object(json, "$.timestamp").try_cast("timestamp_ntz")
    return out.withColumn("ts", stamp)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as readings: asset_id, seq, ts, ch_value, ch_k, flag_high, flag_odd."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "props"]).select(
        F.col("event_type").alias("asset_id"),
        F.row_number().over(w).cast("long").alias("seq"),
        "ts",
        F.col("value").alias("ch_value"),
        k.try_cast("double").alias("ch_k"),
        F.when(F.col("value") > 100, 1.0).otherwise(0.0).alias("flag_high"),
        F.when(k.try_cast("long") % 2 == 1, 1.0).otherwise(0.0).alias("flag_odd"),
    )


def faulty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with planted faults: missing and unreadable fields, repeated, reversed and missing times."""
    w = Window.partitionBy("asset_id").orderBy("seq")
    before = F.lag("ts").over(w)
    seq = F.col("seq")
    return (
        readings(spark, sf_dir)
        .withColumn("ts", F.when(seq % 89 == 0, before).when(seq % 83 == 0, before - F.expr("interval 60 seconds")).when(seq % 79 == 0, None).otherwise(F.col("ts")))
        .withColumn("ch_value", F.when(seq % 97 == 0, None).when(seq % 53 == 0, -F.col("ch_value")).otherwise(F.col("ch_value")))
        .withColumn("ch_k", F.when(seq % 101 == 0, F.lit("bad").try_cast("double")).otherwise(F.col("ch_k")))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a stream for each label: asset_id, clock, vec_id, x."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("asset_id"), F.row_number().over(w).cast("long").alias("clock"), "vec_id",
        F.col("embedding").cast("array<double>").alias("x"),
    )


def failures(spark: SparkSession, rows: tuple = EVENTS) -> DataFrame:
    """Ground truth: idx, name, start, end. A handful of rows, so joins broadcast it."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx int, name string, start string, end string")
    return df.select("idx", "name", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 0, centres: int = 0, drift: float = 0.0) -> DataFrame:
    """clock and x: Gaussian vectors, of a mixture if centres is given, drifting by `drift` a step."""
    at = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(centres, 1))) * 3).cast("double") if centres else F.lit(0.0)
    x = [F.randn(seed * 1000 + d) + (F.when(F.lit(d % max(centres, 1)) == 0, at).otherwise(0.0)) + F.col("id") * drift for d in range(dim)]
    return spark.range(n).select((F.col("id") + 1).alias("clock"), F.array(*x).alias("x"))


def replay_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream from Parquet files, in the order of their names; stands for a broker in tests."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def broker_stream(spark: SparkSession, servers: str, topic: str, from_beginning: bool = True) -> DataFrame:
    """A Kafka topic; needs the connector on the class path."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest" if from_beginning else "latest").load().select("value")
    )
