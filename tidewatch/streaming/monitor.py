"""The monitor as a stateful stream: quality, warm-up, standardizing, sketch and score for each asset.

State is one row for each asset. A micro-batch's rows are put in order of arrival before the clock
ticks, so splitting the same rows into other micro-batches gives the same output. The window is one
of logical ticks, and cells are purged by the clock, never by processing time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Monitor
from tidewatch.functions.lsh import bank
from tidewatch.operators.eh import Histogram
from tidewatch.operators.scoring import Rolling

OUTPUT = (
    "asset_id string, seq long, outcome string, clock long, density double, smoothed double, score double, "
    "missing int, out_of_range int, regression boolean, duplicate boolean, gap_seconds double"
)
STATE = "state binary"


class Asset:
    """One asset's state; `take` advances it by one record."""

    def __init__(self, settings: Monitor, ranges: list[tuple[float, float] | None]):
        self.settings, self.ranges = settings, ranges
        self.dim = len(ranges)
        self.hashes = bank(settings.sketch, self.dim)
        self.before: float | None = None
        self.warm: list[np.ndarray] | None = []
        self.mean = self.scale = None
        self.clock = 0
        self.cells: dict[tuple[int, int], Any] = {}
        self.purge_at = settings.sketch.compact_every or settings.sketch.window
        self.scorer = Rolling(settings.scorer)
        self.recent: list[tuple[int, np.ndarray]] = []

    def _quality(self, values: np.ndarray, at: float | None) -> tuple[int, int, bool, bool, float]:
        gone = np.isnan(values)
        off = sum(1 for v, g, r in zip(values, gone, self.ranges) if not g and r is not None and not r[0] <= v <= r[1])
        delta = None if at is None or self.before is None else at - self.before
        self.before = self.before if at is None else at
        gap = delta if delta is not None and delta > self.settings.gap_seconds else 0.0
        return int(gone.sum()), off, delta is not None and delta < 0, delta == 0, gap

    def _cell(self) -> Histogram:
        s = self.settings.sketch
        return Histogram(s.window, s.eh_error)

    def _count(self, codes: list[int], t: int) -> float:
        """Adds a hit to each row's cell and gives the mean of their counts."""
        total = 0.0
        exact, window = self.settings.sketch.engine == "exact", self.settings.sketch.window
        for cell in enumerate(codes):
            held = self.cells.get(cell)
            if held is None:
                held = self.cells[cell] = [] if exact else self._cell()
            if exact:
                held.append(t)
                while held[0] <= t - window:
                    held.pop(0)
                total += len(held)
            else:
                held.add(t)
                total += held.estimate(t)
        return total / len(codes)

    def _purge(self, t: int) -> None:
        s = self.settings.sketch
        if t >= self.purge_at:
            dead = [c for c, h in self.cells.items() if (h[-1] <= t - s.window if isinstance(h, list) else h.empty(t))]
            for c in dead:
                del self.cells[c]
            self.purge_at = t + (s.compact_every or s.window)

    def take(self, values: np.ndarray, at: float | None) -> tuple:
        found = self._quality(values, at)
        if found[0]:
            return ("dropped", None, None, None, None, *found)
        if self.warm is not None:
            self.warm.append(values)
            if len(self.warm) < self.settings.warmup:
                return ("warmup", None, None, None, None, *found)
            held = np.vstack(self.warm)
            self.mean, dev = held.mean(axis=0), held.std(axis=0)
            self.scale, self.warm = np.where(dev < 1e-9, 1.0, dev), None
        z = (values - self.mean) / self.scale
        if not np.isfinite(z).all():
            return ("dropped", None, None, None, None, *found)
        self.clock += 1
        density = self._count(self.hashes.codes(z)[0].tolist(), self.clock)
        self._purge(self.clock)
        if self.clock % self.settings.query_every:
            return ("accepted", self.clock, None, None, None, *found)
        smoothed = score = None
        if not self.settings.gate or self.clock >= self.settings.sketch.window:
            smoothed, score = self.scorer.add(density)
        return ("accepted", self.clock, density, smoothed, score, *found)


def _run(asset: Asset, pdf: pd.DataFrame, key: Any, channels: list[str]) -> pd.DataFrame:
    pdf = pdf.sort_values("seq", kind="stable")
    at = [None if pd.isna(t) else pd.Timestamp(t).value / 1e9 for t in pdf["ts"]]
    values = pdf[channels].to_numpy(float)
    rows = [(key, seq, *asset.take(v, t)) for seq, v, t in zip(pdf["seq"].tolist(), values, at)]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    return out.astype({"clock": "Int64"})


def prepared(df: DataFrame, channels: list[str]) -> DataFrame:
    return df.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("seq").cast("long").alias("seq"), "ts", *(F.col(c).cast("double").alias(c) for c in channels))


def stream(df: DataFrame, channels: list[str], ranges: dict[str, tuple[float, float]], settings: Monitor) -> DataFrame:
    """Monitors a stream of asset_id, seq, ts and channels; one output row for each record."""
    limits = [ranges.get(c) for c in channels]

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        asset = pickle.loads(state.get[0]) if state.exists else Asset(settings, limits)
        rows = [p for p in parts if len(p)]
        if rows:
            yield _run(asset, pd.concat(rows), key[0], channels)
        state.update((pickle.dumps(asset),))

    return prepared(df, channels).groupBy("asset_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", "NoTimeout")


def batch(df: DataFrame, channels: list[str], ranges: dict[str, tuple[float, float]], settings: Monitor) -> DataFrame:
    """The same over a table: assets side by side, each replayed in order."""
    limits = [ranges.get(c) for c in channels]
    return prepared(df, channels).groupBy("asset_id").applyInPandas(lambda key, pdf: _run(Asset(settings, limits), pdf, key[0], channels), OUTPUT)


def metrics(out: DataFrame) -> DataFrame:
    """Counters by outcome and by kind of issue, as rows of metric, label and value."""
    totals = out.groupBy("asset_id", "outcome").agg(F.count(F.lit(1)).cast("double").alias("value"))
    counters = totals.select("asset_id", F.lit("records").alias("metric"), F.col("outcome").alias("label"), "value")
    kinds = "stack(5, 'missing_field', missing, 'out_of_range', out_of_range, 'timestamp_regression', cast(regression as int), 'duplicate_timestamp', cast(duplicate as int), 'gap', cast(gap_seconds > 0 as int)) as (label, n)"
    issues = out.selectExpr("asset_id", kinds).groupBy("asset_id", "label").agg(F.sum("n").cast("double").alias("value"))
    return counters.unionByName(issues.select("asset_id", F.lit("quality_issues").alias("metric"), "label", "value"))
