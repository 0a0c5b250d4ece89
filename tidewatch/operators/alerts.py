"""Alert rules on sampled series: hold times, inhibition, stalled streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.episodes import seconds

# Score limits of the two severities, hold times in seconds.
LIMITS = {"warning": 1.3, "critical": 2.0}
HOLD, KEEP = 30.0, 120.0


class Rule:
    """The state of one alert: pending until the condition held for `hold`, firing until it is gone for `keep`."""

    def __init__(self, hold: float = HOLD, keep: float = KEEP):
        self.hold, self.keep = hold, keep
        self.since: float | None = None
        self.seen: float | None = None
        self.firing = False

    def step(self, at: float, active: bool) -> str:
        if active:
            self.since = at if self.since is None else self.since
            self.seen = at
            self.firing = self.firing or at - self.since >= self.hold
        elif self.firing and at - self.seen >= self.keep:
            self.firing, self.since = False, None
        elif not self.firing:
            self.since = None
        return "firing" if self.firing else "pending" if active else "inactive"


def states(df: DataFrame, hold: float = HOLD, keep: float = KEEP, limits: dict[str, float] = LIMITS) -> DataFrame:
    """asset_id, ts, severity, state for each sample (asset_id, seq, ts, score), as `Rule` steps through them.

    A quiet sample that comes `keep` after the last active one begins a new part; an alert fires in a
    part from the first sample on at which an unbroken run of active ones has lasted for `hold`.
    """
    pairs = ", ".join(f"'{k}', double({v})" for k, v in limits.items())
    each = df.selectExpr("asset_id", "seq", "ts", "score", f"stack({len(limits)}, {pairs}) as (severity, limit)")
    own = ("asset_id", "severity")
    so_far = Window.partitionBy(*own).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("active", F.col("score") > F.col("limit")).withColumn("on", F.when(F.col("active"), F.col("ts")))
    each = each.withColumn("run", F.sum((~F.col("active")).cast("long")).over(so_far)).withColumn("seen", F.max("on").over(so_far))
    over = ~F.col("active") & (seconds(F.col("ts"), F.col("seen")) >= keep)
    each = each.withColumn("part", F.sum(F.when(over, 1).otherwise(0)).over(so_far)).withColumn("since", F.min("on").over(Window.partitionBy(*own, "run")))
    held = F.col("active") & (seconds(F.col("ts"), F.col("since")) >= hold)
    part = Window.partitionBy(*own, "part").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    firing = F.max(F.when(held, 1).otherwise(0)).over(part) == 1
    state = F.when(firing, "firing").when(F.col("active"), "pending").otherwise("inactive")
    return each.select("asset_id", "ts", "severity", state.alias("state"))


def runs(df: DataFrame, limit: float, hold: float) -> DataFrame:
    """asset_id, run, started_at, ended_at, n of the unbroken runs over the limit that last at least `hold` seconds."""
    w = Window.partitionBy("asset_id").orderBy("ts", "seq")
    active = F.col("score") > limit
    marked = df.withColumn("__break", F.sum((~active).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(active)
    found = marked.groupBy("asset_id", F.col("__break").alias("run")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n"))
    return found.filter(seconds(F.col("ended_at"), F.col("started_at")) >= hold)


def inhibited(warnings: DataFrame, severe: DataFrame) -> DataFrame:
    """Warnings that no severe alert of the same asset overlaps.

    A warning is overlapped if, of the severe alerts begun by its end, one ends at its start or later: one
    running maximum over both kinds in order of time, instead of meeting each with each.
    """
    ends = severe.filter("asset_id is not null").select("asset_id", F.col("started_at").alias("__t"), F.lit(0).alias("__k"), F.col("ended_at").alias("__e"))
    both = warnings.withColumn("__t", F.col("ended_at")).withColumn("__k", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy("asset_id").orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.max("__e").over(w)).filter((F.col("__k") == 1) & (F.col("__last").isNull() | (F.col("__last") < F.col("started_at"))))
    return both.select(warnings.columns)


def stalled(df: DataFrame, quiet_seconds: float = 120.0) -> DataFrame:
    """Gaps of an asset's records, of whatever outcome, of at least this length: from, until, seconds."""
    w = Window.partitionBy("asset_id").orderBy("ts", "seq")
    before = df.withColumn("from", F.lag("ts").over(w)).withColumn("gap", seconds(F.col("ts"), F.col("from")))
    return before.filter(F.col("gap") >= quiet_seconds).select("asset_id", "from", F.col("ts").alias("until"), "gap")


def issue_rate(df: DataFrame, per_second: float = 1.0, window: str = "1 minute") -> DataFrame:
    """Windows in which an asset's quality issues of a kind come faster than the limit (`df`: asset_id, ts, kind, n)."""
    by = df.groupBy("asset_id", "kind", F.window("ts", window).alias("w")).agg(F.sum("n").alias("n"))
    rate = F.col("n") / ((F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1e6)
    return by.withColumn("rate", rate).filter(F.col("rate") > per_second).select("asset_id", "kind", F.col("w.start").alias("from"), "n", "rate")
