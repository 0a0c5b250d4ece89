"""What a dashboard of the monitor shows, from scored samples and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Upper ends of the latency histogram, in seconds.
LATENCY = (1e-4, 2.5e-4, 5e-4, 1e-3, 2.5e-3, 5e-3, 1e-2, 2.5e-2, 5e-2)


def latest(df: DataFrame, columns: list[str], order: str = "clock") -> DataFrame:
    return df.groupBy("asset_id").agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in columns))


def ingest_rate(df: DataFrame, window: str = "1 minute", seconds: float = 60.0) -> DataFrame:
    """Accepted rows a second, by asset and window."""
    by = df.filter("outcome = 'accepted'").groupBy("asset_id", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("asset_id", F.col("w.start").alias("at"), "n", (F.col("n") / F.lit(seconds)).alias("rate"))


def outcomes_over_time(df: DataFrame, window: str = "1 minute") -> DataFrame:
    by = df.groupBy("asset_id", "outcome", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("asset_id", "outcome", F.col("w.start").alias("at"), "n")


def over_time(scored: DataFrame) -> DataFrame:
    return scored.select("asset_id", "clock", "score", "density", F.expm1("smoothed").alias("smoothed_density"))


def rate(df: DataFrame, seconds: int = 60, value: str = "total") -> DataFrame:
    """Increase a second of a counter over the last `seconds`; a fall counts as a reset to 0."""
    w = Window.partitionBy("asset_id").orderBy("t")
    step = F.col(value) - F.lag(value).over(w)
    df = df.withColumn("__up", F.when(step < 0, F.col(value)).otherwise(F.coalesce(step, F.lit(0))))
    return df.withColumn("rate", F.sum("__up").over(w.rangeBetween(-seconds, 0)) / seconds).drop("__up")


def histogram(df: DataFrame, value: str, ends: tuple[float, ...] = LATENCY) -> DataFrame:
    """Counts at or under each end, as cumulative buckets; the last row is all."""
    counts = [F.count_if(F.col(value) <= e).alias(str(i)) for i, e in enumerate(ends)]
    one = df.groupBy("asset_id").agg(*counts, F.count(value).alias(str(len(ends))))
    pairs = ", ".join(f"double('{e}'), `{i}`" for i, e in enumerate((*ends, "Infinity")))
    return one.selectExpr("asset_id", f"stack({len(ends) + 1}, {pairs}) as (le, n)")


def quantile(buckets: DataFrame, q: float) -> DataFrame:
    """The quantile of each asset's histogram, linear within a bucket; in the last one its lower end."""
    w = Window.partitionBy("asset_id").orderBy("le")
    rows = buckets.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rows = rows.withColumn("all", F.max("n").over(Window.partitionBy("asset_id"))).withColumn("want", F.col("all") * q)
    part = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("want") - F.col("below")) / (F.col("n") - F.col("below")))
    hit = rows.filter((F.col("n") >= F.col("want")) & (F.col("n") > F.col("below")))
    return hit.groupBy("asset_id").agg(F.min_by(part, "le").alias("value"))
