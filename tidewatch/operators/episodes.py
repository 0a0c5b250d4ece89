"""Alert episodes: thresholds, sessions, matching to failure windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(a: Column, b: Column) -> Column:
    """a - b for times without zone."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def thresholds(df: DataFrame, alerting: float, score: str = "score", by: str = "asset_id") -> DataFrame:
    """The score that a share `alerting` of all samples exceeds, linear between samples."""
    return df.groupBy(by).agg(F.percentile(score, F.lit(1.0 - alerting)).alias("threshold"))


def alerting_fraction(df: DataFrame, by: str = "asset_id") -> DataFrame:
    return df.groupBy(by).agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("alerting_fraction"))


def sessions(df: DataFrame, gap_seconds: float, by: tuple[str, ...] = ("asset_id",), ts: str = "ts", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Adds episode (from 1): a row begins one if it is more than the gap after the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce(seconds(F.col(ts), F.lag(ts).over(w)) > gap_seconds, F.lit(True))
    return df.withColumn("__new", new.cast("long")).withColumn("episode", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def episodes(df: DataFrame, gap_seconds: float, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Episodes of the samples over their threshold (strictly): started_at, ended_at, n, peak_score, threshold.

    All samples over the threshold exceed all others, so the peak over an episode's whole span is
    that of its alerting samples.
    """
    over = sessions(df.filter(F.col("score") > F.col("threshold")), gap_seconds, by)
    limit = [] if "threshold" in by else [F.max("threshold").alias("threshold")]
    return over.groupBy(*by, "episode").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n"), F.max("score").alias("peak_score"), *limit
    )


def windows(failures: DataFrame, horizon_hours: float) -> DataFrame:
    """Failures with horizon_start."""
    return failures.withColumn("horizon_start", F.col("start") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(horizon_hours * 3600.0)))


def labelled(df: DataFrame, failure_windows: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("asset_id", "seq")) -> DataFrame:
    """keys, in_window and window_index: the last window that holds the time, ends included; -1 for none."""
    w = F.broadcast(failure_windows.select("idx", "horizon_start", F.col("end").alias("w_end")))
    hit = df.join(w, F.col(ts).between(F.col("horizon_start"), F.col("w_end")), "left")
    return hit.groupBy(*keys).agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("window_index")).withColumn("in_window", F.col("window_index") >= 0)


def first_failure(df: DataFrame, failures: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("asset_id", "seq")) -> DataFrame:
    """keys and the name of the first failure under way at the time, null if none."""
    f = F.broadcast(failures.select("idx", "name", "start", F.col("end").alias("f_end")))
    hit = df.join(f, F.col(ts).between(F.col("start"), F.col("f_end")), "left")
    return hit.groupBy(*keys).agg(F.min_by("name", "idx").alias("failure"))


def matched(found: DataFrame, failure_windows: DataFrame, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Adds matched_failure and lead_hours: the first window that holds the episode's start; null for a false alarm."""
    w = F.broadcast(failure_windows.select("idx", "name", F.col("start").alias("f_start"), "horizon_start", F.col("end").alias("w_end")))
    hit = found.join(w, F.col("started_at").between(F.col("horizon_start"), F.col("w_end")), "left")
    first = hit.groupBy(*by, "episode").agg(F.min_by(F.struct("name", "f_start"), "idx").alias("__hit"))
    out = found.join(first, [*by, "episode"])
    lead = seconds(F.col("__hit.f_start"), F.col("started_at")) / 3600
    return out.withColumn("matched_failure", F.col("__hit.name")).withColumn("lead_hours", lead).drop("__hit")


def first_alerts(found: DataFrame, failure_windows: DataFrame, spans: DataFrame, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """For each group and window that overlaps its data: detected, first_alert, lead_hours.

    `detected` follows the matching of episodes to their first window; first_alert is the earliest
    episode that begins in this window.
    """
    w = F.broadcast(failure_windows.withColumnsRenamed({"start": "f_start", "end": "w_end"}))
    inside = spans.join(w, (F.col("f_start") <= F.col("span_end")) & (F.col("w_end") >= F.col("span_start")))
    starts = found.select(*by, "started_at")
    held = inside.join(starts, [*by], "left").withColumn("__in", F.col("started_at").between(F.col("horizon_start"), F.col("w_end")))
    first = held.groupBy(*by, "idx", "name", "f_start").agg(F.min(F.when(F.col("__in"), F.col("started_at"))).alias("first_alert"))
    # an episode counts for the first window that holds its start only
    own = starts.join(inside, [*by]).filter(F.col("started_at").between(F.col("horizon_start"), F.col("w_end")))
    own = own.groupBy(*by, "started_at").agg(F.min("idx").alias("idx")).select(*by, "idx").distinct().withColumn("__hit", F.lit(True))
    out = first.join(own, [*by, "idx"], "left").withColumn("detected", F.coalesce("__hit", F.lit(False)))
    at = F.when(F.col("detected"), F.col("first_alert"))
    return out.select(*by, "idx", "name", "detected", at.alias("first_alert"), (seconds(F.col("f_start"), at) / 3600).alias("lead_hours"))


def spans(df: DataFrame, by: tuple[str, ...] = ("asset_id",), ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("span_start"), F.max(ts).alias("span_end"))


def normal_days(spans: DataFrame, failure_windows: DataFrame, by: tuple[str, ...] = ("asset_id",), merge: bool = False) -> DataFrame:
    """Days of the data outside all windows, 1e-9 at least.

    As published, overlapping windows are subtracted twice; `merge` subtracts their union.
    """
    w = failure_windows.select("idx", F.col("start").alias("f_start"), "horizon_start", F.col("end").alias("w_end"))
    hit = spans.join(F.broadcast(w), (F.col("f_start") <= F.col("span_end")) & (F.col("w_end") >= F.col("span_start")), "left")
    lo, hi = F.greatest("horizon_start", "span_start"), F.least("w_end", "span_end")
    if merge:
        before = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
        lo = F.greatest(lo, F.coalesce(F.max(hi).over(before), lo))
    hit = hit.withColumn("__covered", F.greatest(F.coalesce(seconds(hi, lo), F.lit(0.0)), F.lit(0.0)))
    total = seconds(F.max("span_end"), F.min("span_start"))
    return hit.groupBy(*by).agg(F.greatest((total - F.sum("__covered")) / 86400, F.lit(1e-9)).alias("normal_days"))
