"""Vector arithmetic and kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; norms count as at least 1e-12."""
    c = dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))


def angular_kernel(a: Column, b: Column, k: int) -> Column:
    """The chance that k sign bits agree."""
    return F.pow(1 - F.acos(cosine(a, b)) / math.pi, F.lit(float(k)))


def collision(distance: float, width: float) -> float:
    """The chance that two points at a distance fall into one step of a Gaussian projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    spread = math.erf(r / math.sqrt(2))
    return max(0.0, spread - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2)))


# Ratios of distance to width at which the chance is tabulated.
RATIOS = np.linspace(0.0, 60.0, 20001)
TABLE = np.array([collision(r, 1.0) for r in RATIOS])


def collision_column(distance: Column, width: float) -> Column:
    """The tabulated chance, linear between entries; beyond the table its last value."""

    def run(d: pd.Series) -> pd.Series:
        return pd.Series(np.interp(d.to_numpy(float) / width, RATIOS, TABLE))

    return F.pandas_udf(run, "double")(distance)
