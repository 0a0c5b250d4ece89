"""Robust score of a density series: smoothed log density against the median and MAD of its history."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Scorer

# MAD to standard deviation of a normal law, least scale in log density, largest score.
TO_SIGMA, LEAST_SCALE, MOST = 1.4826, 1e-3, 100.0


def log_density(d: Column) -> Column:
    return F.log1p(F.greatest(d, F.lit(0.0)))


class Rolling:
    """The scorer's state for one asset, a value at a time."""

    def __init__(self, settings: Scorer):
        self.settings = settings
        self.smoothed: float | None = None
        self.history: deque[float] = deque(maxlen=settings.history)

    def add(self, density: float) -> tuple[float, float]:
        """The smoothed log density and the score."""
        s = self.settings
        value = density if s.log_space else math.log1p(max(density, 0.0))
        self.smoothed = value if self.smoothed is None else s.alpha * value + (1 - s.alpha) * self.smoothed
        self.history.append(self.smoothed)
        if len(self.history) < s.min_history:
            return self.smoothed, 0.0
        held = np.fromiter(self.history, float, len(self.history))
        middle = float(np.median(held))
        scale = max(TO_SIGMA * float(np.median(np.abs(held - middle))), LEAST_SCALE)
        return self.smoothed, min(max(0.0, (middle - self.smoothed) / scale), MOST)


def score(df: DataFrame, settings: Scorer, density: str = "density", order: str = "clock", asset: str = "asset_id") -> DataFrame:
    """Adds smoothed and score; assets side by side, each in order."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = Rolling(settings)
        got = [state.add(d) for d in pdf[density].tolist()]
        return pdf.assign(smoothed=[g[0] for g in got], score=[g[1] for g in got])

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items() if n not in ("smoothed", "score")) + ", smoothed double, score double"
    return df.drop("smoothed", "score").groupBy(asset).applyInPandas(run, schema)


def rolling_median(df: DataFrame, value: str, history: int, asset: str = "asset_id", order: str = "clock") -> DataFrame:
    w = Window.partitionBy(asset).orderBy(order).rowsBetween(1 - history, 0)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def rolling_mad(df: DataFrame, value: str, history: int, asset: str = "asset_id", order: str = "clock") -> DataFrame:
    """Adds mad: the median distance of the history from its own median, by groups in Arrow."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        v = pdf[value].to_numpy(float)
        out = np.empty(len(v))
        for i in range(len(v)):
            held = v[max(0, i + 1 - history) : i + 1]
            out[i] = np.median(np.abs(held - np.median(held)))
        return pdf.assign(mad=out)

    return df.groupBy(asset).applyInPandas(run, kinds + ", mad double")


def ewma(df: DataFrame, value: str, span: int, asset: str = "asset_id", order: str = "clock") -> DataFrame:
    """Adds smoothed: exponentially weighted mean begun with the first value."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    alpha = 2.0 / (span + 1.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(smoothed=pdf[value].ewm(alpha=alpha, adjust=False).mean())

    return df.groupBy(asset).applyInPandas(run, kinds + ", smoothed double")
