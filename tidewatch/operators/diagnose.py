"""How readings before a failure differ from normal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.episodes import windows


def periods(df: DataFrame, failures: DataFrame, horizon_hours: float = 24.0, ts: str = "ts") -> DataFrame:
    """One row for each reading and period: 'normal' outside all windows, else the name of each failure it precedes."""
    w = F.broadcast(windows(failures, horizon_hours).withColumnsRenamed({"start": "f_start", "end": "w_end"}))
    normal = df.join(w, F.col(ts).between(F.col("horizon_start"), F.col("w_end")), "left_anti").withColumn("period", F.lit("normal"))
    before = df.join(w, (F.col(ts) >= F.col("horizon_start")) & (F.col(ts) < F.col("f_start")))
    return normal.unionByName(before.select(*df.columns, F.col("name").alias("period")))


def _long(df: DataFrame, channels: list[str], extra: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in channels)
    return df.selectExpr(*extra, f"stack({len(channels)}, {pairs}) as (channel, v)")


def effects(df: DataFrame, failures: DataFrame, channels: list[str], horizon_hours: float = 24.0) -> DataFrame:
    """asset_id, failure, channel, effect: mean before the failure less the normal mean, in normal sample deviations.

    Deviations under 1e-9 give 0; failures without readings before them have no rows.
    """
    long = _long(periods(df, failures, horizon_hours), channels, ["asset_id", "period"])
    stats = long.groupBy("asset_id", "period", "channel").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("dev"))
    normal = stats.filter("period = 'normal'").select("asset_id", "channel", F.col("mean").alias("base"), F.coalesce("dev", F.lit(0.0)).alias("scale"))
    out = stats.filter("period <> 'normal'").join(normal, ["asset_id", "channel"])
    effect = F.when(F.col("scale") < 1e-9, 0.0).otherwise((F.col("mean") - F.col("base")) / F.col("scale"))
    return out.select("asset_id", F.col("period").alias("failure"), "channel", effect.alias("effect"))


def duty_by_period(df: DataFrame, failures: DataFrame, flags: list[str], horizon_hours: float = 24.0) -> DataFrame:
    long = _long(periods(df, failures, horizon_hours), flags, ["asset_id", "period"])
    return long.groupBy("asset_id", "period", "channel").agg(F.avg("v").alias("duty"))


def strongest(effect: DataFrame, n: int = 3) -> DataFrame:
    """The n channels with the largest absolute effect for each failure; ties by name."""
    w = Window.partitionBy("asset_id", "failure").orderBy(F.desc(F.abs("effect")), "channel")
    return effect.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def overall(effect: DataFrame) -> DataFrame:
    return effect.groupBy("asset_id", "failure").agg(F.avg(F.abs("effect")).alias("mean_effect"), F.max(F.abs("effect")).alias("max_effect"))
