"""Exponential histograms: bounded state for windowed counts, and densities built on them."""

from __future__ import annotations

from collections import deque
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lsh import HashBank
from tidewatch.operators.density import cells, mean_over_rows


class Histogram:
    """Counts of the last `window` ticks, in (t - window, t].

    Buckets of one size stand together, so they are held by size: a deque of times for each power of
    two, newest last. A size may have `cap` buckets; one more, and its two oldest become one of
    twice the size, with the newer one's time. `last` is carried, not derived: it is set when the
    oldest bucket is lost or merged, and 0 until then.
    """

    __slots__ = ("window", "cap", "levels", "last", "total")

    def __init__(self, window: int, error: float):
        if window <= 0 or error <= 0:
            raise ValueError("window and error must be positive")
        self.window = window
        self.cap = ceil(ceil(1 / error) / 2) + 1
        self.levels: list[deque[int]] = [deque()]
        self.last = self.total = 0

    def _top(self) -> int:
        """The level of the oldest bucket; -1 if there is none."""
        for i in range(len(self.levels) - 1, -1, -1):
            if self.levels[i]:
                return i
        return -1

    def expire(self, t: int) -> None:
        while (i := self._top()) >= 0 and self.levels[i][0] <= t - self.window:
            self.levels[i].popleft()
            self.total -= 1 << i
            j = self._top()
            self.last = 1 << j if j >= 0 else 0

    def add(self, t: int) -> None:
        self.expire(t)
        self.levels[0].append(t)
        self.total += 1
        i = 0
        while len(self.levels[i]) > self.cap:
            was_oldest = self._top() == i
            self.levels[i].popleft()
            time = self.levels[i].popleft()
            if i + 1 == len(self.levels):
                self.levels.append(deque())
            self.levels[i + 1].append(time)
            i += 1
            if was_oldest:
                self.last = 1 << i

    def estimate(self, t: int) -> float:
        self.expire(t)
        return self.total - self.last / 2

    def empty(self, t: int) -> bool:
        self.expire(t)
        return self.total == 0

    def state(self) -> tuple[int, int, list[tuple[int, int]]]:
        """total, last and the buckets (time, size), oldest first."""
        return self.total, self.last, [(t, 1 << i) for i in range(len(self.levels) - 1, -1, -1) for t in self.levels[i]]


def estimates(df: DataFrame, hashes: HashBank, window: int, error: float, x: str = "x") -> DataFrame:
    """The estimate of each reading's own cells, right after it was added: asset_id, row, clock, estimate.

    Cells are replayed side by side: one task sees the ticks of some (asset, row) in order.
    """

    def replay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("clock", kind="stable")
        held: dict[int, Histogram] = {}
        out = np.empty(len(pdf))
        for i, (code, t) in enumerate(zip(pdf["code"].tolist(), pdf["clock"].tolist())):
            h = held.get(code)
            if h is None:
                h = held[code] = Histogram(window, error)
            h.add(t)
            out[i] = h.estimate(t)
        return pd.DataFrame({"asset_id": pdf["asset_id"], "row": pdf["row"], "clock": pdf["clock"], "estimate": out})

    rows = cells(df, hashes, x)
    kind = rows.schema["asset_id"].dataType.simpleString()
    return rows.groupBy("asset_id", "row").applyInPandas(replay, f"asset_id {kind}, row int, clock long, estimate double")


def density(df: DataFrame, hashes: HashBank, window: int, error: float, query_every: int = 1, x: str = "x") -> DataFrame:
    read = estimates(df, hashes, window, error, x).filter(F.col("clock") % query_every == 0)
    return mean_over_rows(read, hashes.rows, "estimate")


def states(df: DataFrame, hashes: HashBank, window: int, error: float, x: str = "x") -> DataFrame:
    """The state of every live cell after the last tick: total, last, buckets."""
    rows = cells(df, hashes, x)
    end = df.groupBy("asset_id").agg(F.max("clock").alias("end"))
    kind = rows.schema["asset_id"].dataType.simpleString()

    def replay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, Histogram] = {}
        pdf = pdf.sort_values("clock", kind="stable")
        for code, t in zip(pdf["code"].tolist(), pdf["clock"].tolist()):
            held.setdefault(code, Histogram(window, error)).add(t)
        t = int(pdf["end"].iloc[0])
        live = [(c, *h.state()) for c, h in held.items() if not h.empty(t)]
        columns = list(zip(*live)) if live else [[], [], [], []]
        return pd.DataFrame(
            {"asset_id": [key[0]] * len(live), "row": [key[1]] * len(live), "code": list(columns[0]), "total": list(columns[1]), "last": list(columns[2]),
             "buckets": [[{"timestamp": a, "size": b} for a, b in c] for c in columns[3]]}
        )

    return rows.join(end, "asset_id").groupBy("asset_id", "row").applyInPandas(
        replay, f"asset_id {kind}, row int, code long, total long, last long, buckets array<struct<timestamp: long, size: long>>"
    )
