"""Score series of a table of readings: standardized, counted, scored; cached and scored again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Monitor, Scorer
from tidewatch.functions.lsh import Angular, bank
from tidewatch.operators import density, eh, features, quality, scoring
from tidewatch.operators.episodes import seconds

METHODS = ("sketch", "exact", "unwindowed")


def standardized(df: DataFrame, channels: list[str], warmup: int) -> DataFrame:
    """asset_id, clock, ts, x: the vectors that the density sees, by logical clock.

    `df` has asset_id, seq, ts and the channels. Rows with missing values are dropped before the
    warm-up, rows that are not finite once standardized before the clock ticks.
    """
    checked = quality.outcomes(quality.check(df, channels, {}), warmup)
    stats = features.warmup_stats(checked, channels, warmup)
    z = features.standardize(checked.filter("clock is not null"), stats, channels)
    z = z.select("asset_id", F.col("clock").alias("__t"), "ts", F.array(*(f"z_{c}" for c in channels)).alias("x")).filter(features.is_finite("x"))
    from pyspark.sql import Window

    return z.withColumn("clock", F.row_number().over(Window.partitionBy("asset_id").orderBy("__t")).cast("long")).drop("__t")


def densities(vectors: DataFrame, dim: int, settings: Monitor, method: str = "sketch") -> DataFrame:
    """asset_id, clock, density of every query_every-th tick: hash cells, exact kernel, or counts without a window."""
    s, every = settings.sketch, settings.query_every
    if method == "sketch" and s.engine == "eh":
        return eh.density(vectors, bank(s, dim), s.window, s.eh_error, every)
    if method == "sketch":
        return density.blocked_density(vectors, bank(s, dim), s.window, every)
    if method == "exact" and s.kernel == "euclidean":
        return density.exact_euclidean(vectors, s.window, s.k, s.lsh_width, every)
    if method == "exact":
        return density.exact_angular(vectors, s.window, s.k, every)
    if method == "unwindowed":
        counts = density.unwindowed(vectors, Angular(s.rows, s.k, dim, np.random.default_rng(s.seed)))
        return counts.filter(F.col("clock") % every == 0)
    raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")


def build(df: DataFrame, channels: list[str], settings: Monitor, method: str = "sketch") -> DataFrame:
    """asset_id, clock, ts, density, smoothed, score, method: one series for each asset.

    With `gate`, scores begin when the window is full, as in the stream; without it the filling
    window is scored too.
    """
    vectors = standardized(df, channels, settings.warmup)
    series = densities(vectors, len(channels), settings, method).join(vectors.select("asset_id", "clock", "ts"), ["asset_id", "clock"])
    return rescore(series.withColumn("method", F.lit(method)), settings.scorer, settings.sketch.window if settings.gate else 0)


def rescore(series: DataFrame, scorer: Scorer, window: int = 0) -> DataFrame:
    """Scores a cached density again, from the clock `window` on."""
    return scoring.score(series.filter(F.col("clock") >= window), scorer)


def around(scored: DataFrame, failures: DataFrame, before_hours: float = 48.0, after_hours: float = 24.0) -> DataFrame:
    """For each asset and failure the peak score before its start and from it on, within these hours."""
    f = F.broadcast(failures.select("idx", "name", F.col("start").alias("f_start")))
    hours = seconds(F.col("ts"), F.col("f_start")) / 3600
    near = scored.join(f, hours.between(-before_hours, after_hours)).withColumn("__h", hours)
    return near.groupBy("asset_id", "idx", "name").agg(
        F.max(F.when(F.col("__h") < 0, F.col("score"))).alias("peak_before"), F.max(F.when(F.col("__h") >= 0, F.col("score"))).alias("peak_after"), F.count(F.lit(1)).alias("n")
    )


def run_log(results: DataFrame, settings: Monitor) -> DataFrame:
    """An experiment log: the rows of an evaluation with the settings they came from."""
    s = settings.sketch
    held = {"rows": s.rows, "k": s.k, "window": s.window, "kernel": s.kernel, "engine": s.engine, "warmup": settings.warmup, "smoothing": settings.scorer.smoothing}
    return results.withColumns({f"param_{k}": F.lit(v) for k, v in held.items()})
