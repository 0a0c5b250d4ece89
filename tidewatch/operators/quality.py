"""Structural checks of readings, per asset in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Ranges = dict[str, tuple[float, float]]


def is_missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def named(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def check(df: DataFrame, channels: list[str], ranges: Ranges, gap_seconds: float = 30.0, asset: str = "asset_id", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Adds missing_fields, out_of_range, regression, duplicate, gap_seconds, usable and clean.

    The previous time is the last known one of any record, usable or not. A gap leaves a record clean.
    """
    before = Window.partitionBy(asset).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    delta = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.last(ts, ignorenulls=True).over(before).cast("timestamp"))) / 1e6
    df = df.withColumn("__delta", delta)
    off = {c: ~is_missing(c) & ~F.col(c).between(*ranges[c]) for c in channels if c in ranges}
    df = df.withColumns(
        {
            "missing_fields": named({c: is_missing(c) for c in channels}),
            "out_of_range": named({c: F.coalesce(o, F.lit(False)) for c, o in off.items()}) if off else F.array().cast("array<string>"),
            "regression": F.coalesce(F.col("__delta") < 0, F.lit(False)),
            "duplicate": F.coalesce(F.col("__delta") == 0, F.lit(False)),
            "gap_seconds": F.when(F.col("__delta") > gap_seconds, F.col("__delta")).otherwise(0.0),
        }
    ).drop("__delta")
    df = df.withColumn("usable", F.size("missing_fields") == 0)
    return df.withColumn("clean", F.col("usable") & (F.size("out_of_range") == 0) & ~F.col("regression") & ~F.col("duplicate"))


def issues(checked: DataFrame, asset: str = "asset_id") -> DataFrame:
    """Counts by asset and kind of issue; kinds without any have no row."""
    kinds = {
        "missing_field": F.size("missing_fields"), "out_of_range": F.size("out_of_range"), "timestamp_regression": F.col("regression").cast("int"),
        "duplicate_timestamp": F.col("duplicate").cast("int"), "gap": (F.col("gap_seconds") > 0).cast("int"),
    }
    sums = checked.groupBy(asset).agg(*(F.sum(c).cast("long").alias(k) for k, c in kinds.items()))
    pairs = ", ".join(f"'{k}', {k}" for k in kinds)
    return sums.selectExpr(asset, f"stack({len(kinds)}, {pairs}) as (kind, n)").filter("n > 0")


def outcomes(checked: DataFrame, warmup: int, asset: str = "asset_id", seq: str = "seq") -> DataFrame:
    """Adds usable_rank, outcome (dropped, warmup, accepted, undecodable) and clock.

    The usable row that completes the warm-up is accepted and has clock 1.
    """
    upto = Window.partitionBy(asset).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    decoded = F.col("decoded") if "decoded" in checked.columns else F.lit(True)
    good = decoded & F.col("usable")
    df = checked.withColumn("usable_rank", F.sum(good.cast("long")).over(upto))
    df = df.withColumn("outcome", F.when(~decoded, "undecodable").when(~F.col("usable"), "dropped").when(F.col("usable_rank") < warmup, "warmup").otherwise("accepted"))
    return df.withColumn("clock", F.when(F.col("outcome") == "accepted", F.col("usable_rank") - (warmup - 1)))


def count_outcomes(df: DataFrame, asset: str = "asset_id") -> DataFrame:
    return df.groupBy(asset, "outcome").agg(F.count(F.lit(1)).alias("n"))
