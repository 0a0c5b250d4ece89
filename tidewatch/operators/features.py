"""Warm-up statistics, standardizing, duty cycles, fault injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector(columns: list[str]) -> Column:
    """The channels as an array; what is missing is NaN."""
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns))


def is_finite(v: str) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def warmup_stats(df: DataFrame, channels: list[str], warmup: int, asset: str = "asset_id", rank: str = "usable_rank") -> DataFrame:
    """Mean and population deviation of the first usable rows, one row for each asset and channel.

    Assets with fewer than `warmup` usable rows have none. A channel that did not move has scale 1.
    """
    first = df.filter(F.col("usable") & (F.col(rank) <= warmup))
    sums = first.groupBy(asset).agg(
        F.count(F.lit(1)).alias("__n"), *(F.avg(c).alias(f"mean_{c}") for c in channels), *(F.stddev_pop(c).alias(f"dev_{c}") for c in channels)
    )
    sums = sums.filter(F.col("__n") >= warmup)
    pairs = ", ".join(f"'{c}', mean_{c}, dev_{c}" for c in channels)
    rows = sums.selectExpr(asset, f"stack({len(channels)}, {pairs}) as (channel, mean, dev)")
    return rows.select(asset, "channel", "mean", F.when(F.col("dev") < 1e-9, 1.0).otherwise(F.col("dev")).alias("scale"))


def standardize(df: DataFrame, stats: DataFrame, channels: list[str], asset: str = "asset_id") -> DataFrame:
    """Adds z_<channel>; one row of statistics for each asset is joined."""
    wide = stats.groupBy(asset).agg(
        *(F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"__{v}_{c}") for c in channels for v in ("mean", "scale"))
    )
    out = df.join(wide, asset)
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__scale_{c}") for c in channels})
    return out.drop(*(f"__{v}_{c}" for c in channels for v in ("mean", "scale")))


def duty_cycles(df: DataFrame, flags: list[str], window: int = 360, asset: str = "asset_id", seq: str = "seq") -> DataFrame:
    """Adds duty_<flag>: the share of the last `window` rows in which it is set, fewer at the start."""
    w = Window.partitionBy(asset).orderBy(seq).rowsBetween(1 - window, 0)
    return df.withColumns({f"duty_{c}": F.avg(c).over(w) for c in flags})


def inject(df: DataFrame, channels: list[str], start: int, duration: int = 3000, scale: float = 3.0, seq: str = "seq") -> DataFrame:
    """Scales the channels of rows start .. start + duration - 1 and marks them; start 0 injects nothing."""
    hit = F.col(seq).between(start, start + duration - 1) if start else F.lit(False)
    return df.withColumns({c: F.when(hit, F.col(c) * scale).otherwise(F.col(c)) for c in channels}).withColumn("injected", hit)
