"""Detector settings tried side by side on a series with an injected fault."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Scorer
from tidewatch.operators.scoring import Rolling

SMOOTHINGS = (10, 20, 40, 80, 160, 320)


def separation(df: DataFrame, smoothings: tuple[int, ...] = SMOOTHINGS, history: int = 2000, query_every: int = 10, rate: float = 60.0) -> DataFrame:
    """For each asset, smoothing and scale (raw or log): peaks of fault and normal scores and what lies between.

    `df` has asset_id, clock, density, injected. "raw" scores the logs of the density as they are,
    "log" densities whose log has been taken before. Settings run side by side, a task for each.
    """
    settings = df.sparkSession.createDataFrame([(s, k) for s in smoothings for k in ("raw", "log")], "smoothing int, scale string")
    each = df.join(F.broadcast(settings))
    kind = df.schema["asset_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("clock", kind="stable")
        smoothing, scale = int(key[1]), key[2]
        least = max(400, 5 * smoothing)
        state = Rolling(Scorer(history=history, min_history=least, smoothing=smoothing))
        values = pdf["density"].clip(lower=0)
        values = values.map(__import__("math").log1p) if scale == "log" else values
        score = pd.Series([state.add(v)[1] for v in values.tolist()])
        fault = pdf["injected"].to_numpy(bool)
        late = score.index >= least
        peak = float(score[late & fault].max()) if (late & fault).any() else 0.0
        normal = float(score[late & ~fault].max()) if (late & ~fault).any() else 0.0
        limit = (max(peak, 1e-9) * max(normal, 1e-9)) ** 0.5
        held = int((score[late & fault] > limit).sum())
        return pd.DataFrame([(key[0], smoothing, scale, peak, normal, limit, peak / max(normal, 1e-9), held, held * query_every / rate)],
                            columns=["asset_id", "smoothing", "scale", "peak_fault", "max_normal", "threshold", "separation", "sustained_samples", "sustained_seconds"])

    return each.groupBy("asset_id", "smoothing", "scale").applyInPandas(
        run, f"asset_id {kind}, smoothing int, scale string, peak_fault double, max_normal double, threshold double, separation double, sustained_samples long, sustained_seconds double"
    )


def best(tried: DataFrame, least_seconds: float = 30.0) -> DataFrame:
    """The setting that separates best among those whose alert lasts long enough; else the best of all."""
    usable = F.col("sustained_seconds") >= least_seconds
    return tried.orderBy(F.desc(usable), F.desc("separation"), "smoothing", "scale").limit(1)
