"""Locality-sensitive hash banks. Planes are drawn once on the driver and shipped, never drawn again."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.config import Sketch

FOLD = 1000003  # fixed value: the multiplier that folds projections to a code


class HashBank(Protocol):
    """What a sketch needs of a bank: the number of rows, and the codes of a batch of vectors."""

    rows: int

    def codes(self, x: np.ndarray) -> np.ndarray: ...

    def part(self, lo: int, hi: int) -> HashBank: ...


class Angular:
    """k sign bits for each row, first bit highest; a product of exactly 0 counts as positive."""

    def __init__(self, rows: int, k: int, dim: int, rng: np.random.Generator):
        self.rows, self.k = rows, k
        self.planes = rng.standard_normal((rows, k, dim))

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = np.tensordot(np.atleast_2d(x), self.planes, axes=(1, 2)) >= 0
        return bits @ (1 << np.arange(self.k - 1, -1, -1))

    def part(self, lo: int, hi: int) -> Angular:
        """The bank of rows lo .. hi - 1."""
        out = copy(self)
        out.planes = self.planes[lo:hi]
        out.rows = len(out.planes)
        return out


class PStable:
    """k projections for each row in steps of `width`, folded into [0, hash_range)."""

    def __init__(self, rows: int, k: int, dim: int, width: float, hash_range: int, rng: np.random.Generator):
        self.rows, self.k, self.width, self.hash_range = rows, k, width, hash_range
        self.planes = rng.standard_normal((rows, k, dim))
        self.offsets = rng.uniform(0.0, width, (rows, k))

    def codes(self, x: np.ndarray) -> np.ndarray:
        steps = np.floor((np.tensordot(np.atleast_2d(x), self.planes, axes=(1, 2)) + self.offsets) / self.width).astype(np.int64)
        code = np.zeros(steps.shape[:2], np.int64)
        for j in range(self.k):
            code = (code * FOLD + steps[:, :, j]) % self.hash_range
        return code

    def part(self, lo: int, hi: int) -> PStable:
        """The bank of rows lo .. hi - 1."""
        out = copy(self)
        out.planes, out.offsets = self.planes[lo:hi], self.offsets[lo:hi]
        out.rows = len(out.planes)
        return out


def bank(settings: Sketch, dim: int) -> HashBank:
    rng = np.random.default_rng(settings.seed)
    if settings.kernel == "angular":
        return Angular(settings.rows, settings.k, dim, rng)
    return PStable(settings.rows, settings.k, dim, settings.lsh_width, settings.hash_range, rng)


def codes(hashes: HashBank, x: Column) -> Column:
    """The codes of a vector column, one for each row of the bank: a matrix product a batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(hashes.codes(np.stack(s.to_numpy())))) if len(s) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<long>")(x)


def code_sql(hashes: Angular | PStable, row: int, x: str, dot: str) -> str:
    """The same code as SQL with the planes as literals; `dot` is a template of {a} and {b}."""

    def product(j: int) -> str:
        plane = "[" + ", ".join(repr(float(v)) for v in hashes.planes[row, j]) + "]"
        return dot.format(a=x, b=plane)

    if isinstance(hashes, Angular):
        return " + ".join(f"(CASE WHEN {product(j)} >= 0 THEN {1 << (hashes.k - 1 - j)} ELSE 0 END)" for j in range(hashes.k))
    code = "0"
    for j in range(hashes.k):
        step = f"CAST(floor(({product(j)} + {float(hashes.offsets[row, j])!r}) / {hashes.width!r}) AS BIGINT)"
        m = hashes.hash_range
        code = f"((((({code}) * {FOLD} + {step}) % {m}) + {m}) % {m})"
    return code
