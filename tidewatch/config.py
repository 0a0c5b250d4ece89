"""Validated settings. Nothing is read from the environment at import."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Sketch:
    """Size of a density sketch: hash rows, bits or projections per row, window in logical ticks."""

    rows: int = 400
    k: int = 3
    window: int = 3600
    eh_error: float = 0.1
    lsh_width: float = 2.0
    hash_range: int = 1 << 20
    kernel: str = "euclidean"
    engine: str = "exact"
    seed: int = 0
    compact_every: int | None = None

    def __post_init__(self) -> None:
        if self.rows <= 0 or self.k <= 0 or self.window <= 0:
            raise ValueError("rows, k and window must be positive")
        if self.eh_error <= 0 or self.lsh_width <= 0 or self.hash_range <= 0:
            raise ValueError("eh_error, lsh_width and hash_range must be positive")
        if self.compact_every is not None and self.compact_every <= 0:
            raise ValueError("compact_every must be positive")
        if self.kernel not in ("euclidean", "angular"):
            raise ValueError(f"unknown kernel {self.kernel!r}")
        if self.engine not in ("exact", "eh"):
            raise ValueError(f"unknown engine {self.engine!r}")


@dataclass(frozen=True)
class Scorer:
    """Robust score of the smoothed log density; log_space says that densities are logs already."""

    history: int = 2000
    min_history: int = 400
    smoothing: int = 80
    log_space: bool = False

    def __post_init__(self) -> None:
        if self.smoothing < 1 or self.history < 1:
            raise ValueError("history and smoothing must be positive")
        if self.min_history < 5 * self.smoothing:
            raise ValueError("min_history must be at least five times smoothing")

    @property
    def alpha(self) -> float:
        return 2.0 / (self.smoothing + 1.0)


@dataclass(frozen=True)
class Monitor:
    """The whole pipeline for one asset."""

    sketch: Sketch = field(default_factory=Sketch)
    scorer: Scorer = field(default_factory=Scorer)
    warmup: int = 2000
    query_every: int = 10
    gap_seconds: float = 30.0
    gate: bool = True

    def __post_init__(self) -> None:
        if self.warmup < 1 or self.query_every < 1:
            raise ValueError("warmup and query_every must be positive")


def dsn(name: str = "TIDEWATCH_DSN") -> str:
    """Where the serving tables live; raises if the variable is not set."""
    if not (found := os.environ.get(name)):
        raise RuntimeError(f"set {name} to the address of the serving tables")
    return found


#: Small parameters for the driver's tables.
SMALL = Monitor(
    sketch=Sketch(rows=6, k=3, window=256, kernel="angular"), scorer=Scorer(history=200, min_history=40, smoothing=8),
    warmup=200, gap_seconds=3600.0,
)
