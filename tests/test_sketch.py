"""Histograms, hash banks, kernels and densities."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.config import Scorer, Sketch
from tidewatch.functions import kernels, lsh
from tidewatch.operators import density, eh, scoring
from tidewatch.operators.eh import Histogram


def steps(seed: int, n: int, most: int) -> list[int]:
    rng, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.randrange(1, most)
        out.append(t)
    return out


class Buckets:
    """The histogram as a plain list of buckets, by its definition."""

    def __init__(self, window, cap):
        self.window, self.cap, self.b, self.last = window, cap, [], 0

    def expire(self, t):
        while self.b and self.b[0][0] <= t - self.window:
            self.b = self.b[1:]
            self.last = self.b[0][1] if self.b else 0

    def add(self, t):
        self.expire(t)
        self.b.append((t, 1))
        size = 1
        while sum(s == size for _, s in self.b) > self.cap:
            at = next(i for i, (_, s) in enumerate(self.b) if s == size)
            self.b[at : at + 2] = [(self.b[at + 1][0], 2 * size)]
            if at == 0:
                self.last = 2 * size
            size *= 2


@pytest.mark.parametrize(("window", "error", "most"), [(50, 0.1, 2), (200, 0.1, 300), (40, 0.5, 4), (1, 0.1, 3), (1000, 0.05, 2)])
def test_histogram_state(window, error, most):
    h, plain = Histogram(window, error), Buckets(window, Histogram(window, error).cap)
    for t in steps(1, 1500, most):
        h.add(t)
        plain.add(t)
        assert h.state() == (sum(s for _, s in plain.b), plain.last, plain.b)


def test_histogram_edges():
    h = Histogram(10, 0.1)
    h.add(1)
    assert h.estimate(1) == 1.0 and h.state()[1] == 0
    assert h.estimate(10) == 1.0 and h.estimate(11) == 0.0 and h.empty(11)
    h.add(12)
    assert h.estimate(12) == 1.0
    for bad in ((0, 0.1), (10, 0)):
        with pytest.raises(ValueError):
            Histogram(*bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=300), st.integers(5, 200))
def test_histogram_brackets_the_truth(gaps, window):
    h, seen, t = Histogram(window, 0.1), [], 0
    for g in gaps:
        t += g
        seen.append(t)
        h.add(t)
        exact = sum(s > t - window for s in seen)
        total, _, buckets = h.state()
        assert total - buckets[0][1] + 1 <= exact <= total
        if exact >= 20:
            assert abs(h.estimate(t) - exact) <= 0.1 * exact + 0.5


def test_banks():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 6))
    a = lsh.Angular(7, 4, 6, np.random.default_rng(1))
    codes = a.codes(x)
    for i in range(5):
        for r in range(7):
            want = 0
            for j in range(4):
                want = want * 2 + int(x[i] @ a.planes[r, j] >= 0)
            assert codes[i, r] == want
    assert a.codes(np.zeros(6))[0].tolist() == [15] * 7
    p = lsh.PStable(5, 3, 6, 2.0, 1 << 20, np.random.default_rng(1))
    codes = p.codes(x * 10)
    assert codes.min() >= 0 and codes.max() < 1 << 20
    code = 0
    for j in range(3):
        code = (code * lsh.FOLD + math.floor((x[3] * 10 @ p.planes[2, j] + p.offsets[2, j]) / 2.0)) % (1 << 20)
    assert codes[3, 2] == code
    with pytest.raises(ValueError):
        Sketch(kernel="other")
    with pytest.raises(ValueError):
        Sketch(rows=0)
    assert isinstance(lsh.bank(Sketch(rows=3), 4), lsh.PStable) and isinstance(lsh.bank(Sketch(rows=3, kernel="angular"), 4), lsh.Angular)


def test_collision_chance(spark):
    values = [kernels.collision(d, 2.0) for d in np.linspace(0, 50, 200)]
    assert values[0] == 1.0 and all(1 >= a >= b >= 0 for a, b in zip(values, values[1:]))
    rng = np.random.default_rng(2)
    w, b = rng.standard_normal(200_000) * 1.5, rng.uniform(0, 2, 200_000)
    assert np.mean(np.floor((w + b) / 2) == np.floor(b / 2)) == pytest.approx(kernels.collision(1.5, 2.0), abs=0.005)
    df = spark.createDataFrame([(d,) for d in (0.0, 0.3, 2.0, 50.0, 1e9)], "d double")
    got = [r.p for r in df.select(kernels.collision_column(F.col("d"), 2.0).alias("p")).collect()]
    assert got[:4] == pytest.approx([kernels.collision(d, 2.0) for d in (0.0, 0.3, 2.0, 50.0)], abs=1e-6) and got[4] == pytest.approx(kernels.TABLE[-1])


def stream(spark, n=400, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((3, dim)) * 3
    x = centres[rng.integers(0, 3, n)] + rng.standard_normal((n, dim))
    return x, spark.createDataFrame([("a", i + 1, v.tolist()) for i, v in enumerate(x)], "asset_id string, clock long, x array<double>")


def test_densities(spark):
    x, df = stream(spark)
    bank, window = lsh.Angular(40, 4, 8, np.random.default_rng(5)), 64
    codes = bank.codes(x)
    exact = {r.clock: r.density for r in density.exact_density(df, bank, window).collect()}
    for t in (1, 2, 63, 64, 65, 400):
        recent = codes[max(0, t - window) : t]
        assert exact[t] == pytest.approx((recent == codes[t - 1]).sum(axis=0).mean())
    assert exact[1] == 1.0
    for ticks in (1, 150):
        blocked = density.blocked_density(df, bank, window, row_block=7, ticks=ticks)
        assert {r.clock: r.density for r in blocked.collect()} == exact
    hist = [[{} for _ in range(40)], None][0]
    want = {}
    for t in range(1, 401):
        total = 0.0
        for r in range(40):
            h = hist[r].setdefault(int(codes[t - 1, r]), Histogram(window, 0.1))
            h.add(t)
            total += h.estimate(t)
        want[t] = total / 40
    got = {r.clock: r.density for r in eh.density(df, bank, window, 0.1).collect()}
    assert got == want
    angular = {r.clock: r.density for r in density.exact_angular(df, window, 4).collect()}
    errors = [abs(exact[t] - angular[t]) / angular[t] for t in range(100, 400, 25)]
    assert np.mean(errors) < 0.3
    for t in (5, 64, 65, 200):
        near = x[max(0, t - window) : t]
        cos = np.clip(near @ x[t - 1] / np.linalg.norm(near, axis=1) / np.linalg.norm(x[t - 1]), -1, 1)
        assert angular[t] == pytest.approx(((1 - np.arccos(cos) / np.pi) ** 4).sum())
    euclid = {r.clock: r.density for r in density.exact_euclidean(df, window, 2, 4.0, 50).collect()}
    d = np.linalg.norm(x[86:150] - x[149], axis=1)
    assert euclid[150] == pytest.approx(sum(kernels.collision(v, 4.0) ** 2 for v in d), rel=1e-4)
    race = {r.clock: r.density for r in density.unwindowed(df, bank).collect()}
    counts = (codes[:300] == codes[299]).sum(axis=0)
    assert race[300] == pytest.approx(np.median([counts[i : i + 5].mean() for i in range(0, 40, 5)]))
    live = density.live_cells(df, bank, window).first().cells
    assert live == sum(len(set(codes[-window:, r].tolist())) for r in range(40)) == eh.states(df, bank, window, 0.1).count()


def test_scorer(spark):
    s = Scorer(history=50, min_history=20, smoothing=4)
    values = [100 + math.sin(i) for i in range(120)] + [4.0] * 20
    state = scoring.Rolling(s)
    got = [state.add(v)[1] for v in values]
    assert got[:19] == [0.0] * 19 and max(got[25:120]) < 5 and got[125] > 20 and max(got) <= scoring.MOST
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", i, 42.0) for i in range(60)], "asset_id string, clock long, density double")
    rows = scoring.score(df, s).collect()
    assert [r.score for r in sorted(rows, key=lambda r: r.clock) if r.asset_id == "a"] == got
    assert {r.score for r in rows if r.asset_id == "b"} == {0.0}
    with pytest.raises(ValueError):
        Scorer(min_history=39, smoothing=8)
    logs = scoring.Rolling(Scorer(history=50, min_history=20, smoothing=4, log_space=True))
    assert [logs.add(math.log1p(v))[1] for v in values] == pytest.approx(got)
