"""Evaluation of score series against failure windows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import episodes as ep

# Thresholds of a sweep, alarm budgets, horizons in hours and the budgets they are tried at.
SWEEP = (0.5, 1.0, 1.3, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
BUDGETS = (0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)
HORIZONS = (3, 6, 12, 24, 48)
HORIZON_BUDGETS = (0.1, 0.05, 0.02, 0.01, 0.005)


def evaluate(scored: DataFrame, failures: DataFrame, horizon_hours: float = 24.0, gap_seconds: float = 3600.0, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """One row for each group of `scored` (ts, seq, score, threshold): counts, rates, lead and budget.

    chance_alarms is the number of alarms a random detector gets: false ones and detected failures.
    """
    w = ep.windows(failures, horizon_hours)
    span = ep.spans(scored, by)
    inside = span.join(F.broadcast(w), (F.col("start") <= F.col("span_end")) & (F.col("end") >= F.col("span_start"))).select(*by, "idx", "name", "start", "end", "horizon_start")
    found = ep.episodes(scored, gap_seconds, by)
    hit = found.join(inside.withColumnRenamed("end", "w_end"), [*by], "left").withColumn("__in", F.coalesce(F.col("started_at").between(F.col("horizon_start"), F.col("w_end")), F.lit(False)))
    alarms = hit.groupBy(*by, "episode").agg(F.max("__in").alias("hit")).groupBy(*by).agg(F.sum((~F.col("hit")).cast("long")).alias("false_alarms"), F.count(F.lit(1)).alias("episodes"))
    events = ep.first_alerts(found, w, span, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("detected").cast("long")).alias("detected"), F.avg("lead_hours").alias("mean_lead_hours")
    )
    out = ep.alerting_fraction(scored.withColumn("__g", F.struct(*by)), "__g").select("__g.*", "alerting_fraction")
    out = out.join(ep.normal_days(span, w, by), [*by]).join(alarms, [*by], "left").join(events, [*by], "left")
    out = out.fillna(0, ["false_alarms", "episodes", "events", "detected"])
    out = out.withColumn("false_alarms_per_day", F.when(F.col("normal_days") > 0, F.col("false_alarms") / F.col("normal_days")).otherwise(float("inf")))
    return out.withColumn("chance_alarms", F.col("false_alarms") + F.col("detected"))


def sweep(series: DataFrame, failures: DataFrame, thresholds: tuple[float, ...] = SWEEP, **options) -> DataFrame:
    """evaluate() for each fixed threshold; the samples are read once for all of them."""
    each = series.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return evaluate(each, failures, by=("asset_id", "threshold"), **options)


def compare(series: DataFrame, failures: DataFrame, budgets: tuple[float, ...] = BUDGETS, method: str = "method", **options) -> DataFrame:
    """evaluate() of methods at equal shares of alerting samples."""
    cut = series.groupBy("asset_id", method).agg(F.percentile("score", F.array(*(F.lit(1.0 - b) for b in budgets))).alias("__t"))
    cut = cut.select("asset_id", method, F.posexplode("__t").alias("__i", "threshold"))
    cut = cut.withColumn("budget", F.element_at(F.array(*map(F.lit, budgets)), F.col("__i") + 1)).drop("__i")
    each = series.join(cut, ["asset_id", method])
    return evaluate(each, failures, by=("asset_id", method, "budget"), **options)


def horizons(series: DataFrame, failures: DataFrame, hours: tuple[int, ...] = HORIZONS, budgets: tuple[float, ...] = HORIZON_BUDGETS, **options) -> DataFrame:
    """compare() for each horizon; a handful of them, stacked."""
    out = None
    for h in hours:
        one = compare(series, failures, budgets, horizon_hours=float(h), **options).withColumn("horizon_hours", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


def simulated_chance(bounds: np.ndarray, total_seconds: float, alarms: int, trials: int = 2000, seed: int = 0) -> np.ndarray:
    """Detections of `alarms` random alarms in each trial; bounds (window, 2) in seconds from the start."""
    if not len(bounds) or alarms <= 0:
        return np.zeros(0, int)
    at = np.random.default_rng(seed).uniform(0.0, total_seconds, (trials, alarms))
    return sum(((at >= lo) & (at <= hi)).any(axis=1).astype(int) for lo, hi in bounds)


def p_value(counts: np.ndarray, observed: int) -> float:
    """The share of trials with as many detections; without trials nothing is shown, so 1."""
    return float((np.asarray(counts) >= observed).mean()) if len(counts) else 1.0


def exact_chance(shares: list[float], alarms: int) -> np.ndarray:
    """P(0), P(1), ... windows hit, by inclusion and exclusion over disjoint windows of these shares of the span."""
    m = len(shares)
    none = {s: max(0.0, 1 - sum(shares[i] for i in s)) ** alarms for r in range(m + 1) for s in combinations(range(m), r)}
    out = np.zeros(m + 1)
    for missed in none:
        rest = [i for i in range(m) if i not in missed]
        p = sum((-1) ** r * none[tuple(sorted((*missed, *extra)))] for r in range(len(rest) + 1) for extra in combinations(rest, r))
        out[m - len(missed)] += p
    return out


def closed_form(df: DataFrame, by: tuple[str, ...] = ("asset_id",), windows: int = 4) -> DataFrame:
    """Adds p_0 .. p_<windows> from `shares` (array of window shares) and `alarms`, in plain expressions."""
    def none(s: tuple[int, ...]) -> F.Column:
        left = F.lit(1.0)
        for i in s:
            left = left - F.coalesce(F.get("shares", F.lit(i)), F.lit(0.0))
        return F.pow(F.greatest(left, F.lit(0.0)), F.col("alarms").cast("double"))

    out = {}
    for k in range(windows + 1):
        total = F.lit(0.0)
        for missed in combinations(range(windows), windows - k):
            rest = [i for i in range(windows) if i not in missed]
            for r in range(len(rest) + 1):
                for extra in combinations(rest, r):
                    total = total + F.lit(float((-1) ** r)) * none(tuple(sorted((*missed, *extra))))
        out[f"p_{k}"] = total
    return df.withColumns(out)


def with_chance(df: DataFrame, windows: int = 4) -> DataFrame:
    """Adds p_value: the chance that `chance_alarms` random alarms hit `detected` windows or more, by closed form."""
    out = closed_form(df.withColumn("alarms", F.col("chance_alarms")), windows=windows)
    at_least = sum((F.when(F.col("detected") <= k, F.col(f"p_{k}")).otherwise(0.0) for k in range(windows + 1)), F.lit(0.0))
    return out.withColumn("p_value", F.round(F.least(F.greatest(at_least, F.lit(0.0)), F.lit(1.0)), 9)).drop("alarms", *(f"p_{k}" for k in range(windows + 1)))


def strongest(df: DataFrame, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """The operating point with the least p_value; of ties that with more detections, then the smaller budget."""
    rest = [c for c in df.columns if c not in by]
    rank = F.struct("p_value", -F.col("detected"), "budget")
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("__best")).select(*by, "__best.*")


def format_result(df: DataFrame) -> DataFrame:
    """Adds `text`, a line on each row of evaluate(), with the number of failures the data covers."""
    lead = F.when(F.col("mean_lead_hours").isNull(), F.lit("n/a")).otherwise(F.format_string("%+.2fh", "mean_lead_hours"))
    text = F.format_string("%d/%d failures, %d false alarms (%.3f a day), lead %s", "detected", "events", "false_alarms", "false_alarms_per_day", lead)
    return df.withColumn("text", text)
