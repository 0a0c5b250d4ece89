"""Sliding-window densities: exact counts of hash cells, exact kernels, un-windowed counts.

A reading is counted before its density is read, so the cell that it reads is the one it has just
entered. Its density is the mean over hash rows of the windowed counts of its own cells: a window
count for each (asset, row, code) and a sum for each (asset, clock), without a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.kernels import angular_kernel, collision_column, distance
from tidewatch.functions.lsh import HashBank, codes


def cells(df: DataFrame, hashes: HashBank, x: str = "x", keep: tuple[str, ...] = ("asset_id", "clock")) -> DataFrame:
    """One row for each reading and hash row: row, code."""
    coded = df.select(*keep, codes(hashes, F.col(x)).alias("__codes"))
    return coded.select(*keep, F.posexplode("__codes").alias("row", "code"))


def _cell() -> Window:
    return Window.partitionBy("asset_id", "row", "code").orderBy("clock")


def windowed_counts(cell_rows: DataFrame, window: int) -> DataFrame:
    """Adds n: hits of the cell in the last `window` ticks, this one included."""
    return cell_rows.withColumn("n", F.count(F.lit(1)).over(_cell().rangeBetween(1 - window, 0)))


def mean_over_rows(counted: DataFrame, rows: int, value: str = "n") -> DataFrame:
    """Sum over the rows of a reading, divided by all rows: absent cells count as 0."""
    return counted.groupBy("asset_id", "clock").agg((F.sum(value) / F.lit(rows)).alias("density"))


def exact_density(df: DataFrame, hashes: HashBank, window: int, query_every: int = 1, x: str = "x") -> DataFrame:
    """asset_id, clock, density; sampling comes after counting."""
    counted = windowed_counts(cells(df, hashes, x), window).filter(F.col("clock") % query_every == 0)
    return mean_over_rows(counted, hashes.rows)


def blocked_density(df: DataFrame, hashes: HashBank, window: int, query_every: int = 1, x: str = "x", row_block: int = 50, ticks: int = 1 << 15) -> DataFrame:
    """The same as exact_density, for banks of many rows: vectors travel instead of cells.

    A task gets a stretch of an asset's clock, with the `window` ticks before it, for a block of hash
    rows; it hashes them and counts each cell's hits by binary search. So work is parallel over
    assets, stretches and rows, and a task's size is bounded by `ticks` + `window`.
    """
    ticks = max(ticks, 2 * window)
    own = F.floor((F.col("clock") - 1) / ticks)
    late = F.col("clock") > (own + 1) * ticks - window
    stretch = F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    blocks = -(-hashes.rows // row_block)
    rows = df.select("asset_id", "clock", F.col(x).alias("x"), stretch.alias("stretch"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = df.schema["asset_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("clock", kind="stable")
        clock = pdf["clock"].to_numpy(np.int64)
        codes = hashes.part(key[2] * row_block, (key[2] + 1) * row_block).codes(np.stack(pdf["x"].to_numpy()))
        total = np.zeros(len(clock), np.int64)
        wide = np.int64(clock[-1] + 1)
        for code in codes.T:
            order = np.argsort(code, kind="stable")
            hit = np.unique(code[order], return_inverse=True)[1] * wide + clock[order]
            total[order] += np.arange(1, len(hit) + 1) - np.searchsorted(hit, np.maximum(hit - window + 1, hit - clock[order] + 1))
        mine = ((clock - 1) // ticks == key[1]) & (clock % query_every == 0)
        return pd.DataFrame({"asset_id": pdf["asset_id"].to_numpy()[mine], "clock": clock[mine], "n": total[mine]})

    counted = rows.groupBy("asset_id", "stretch", "block").applyInPandas(run, f"asset_id {kind}, clock long, n long")
    return mean_over_rows(counted, hashes.rows)


def unwindowed(df: DataFrame, hashes: HashBank, chunk: int = 5, x: str = "x") -> DataFrame:
    """Median of the means over chunks of hash rows of each cell's count so far."""
    counted = cells(df, hashes, x).withColumn("n", F.count(F.lit(1)).over(_cell().rowsBetween(Window.unboundedPreceding, 0)))
    means = counted.groupBy("asset_id", "clock", F.floor(F.col("row") / chunk).alias("chunk")).agg(F.avg("n").alias("mean"))
    return means.groupBy("asset_id", "clock").agg(F.median("mean").alias("density"))


def live_cells(df: DataFrame, hashes: HashBank, window: int, x: str = "x") -> DataFrame:
    """Distinct cells that the last `window` ticks of each asset hit."""
    last = df.groupBy("asset_id").agg(F.max("clock").alias("__last"))
    recent = df.join(last, "asset_id").filter(F.col("clock") > F.col("__last") - window)
    return cells(recent, hashes, x).groupBy("asset_id").agg(F.countDistinct("row", "code").alias("cells"))


def pairs_in_window(queries: DataFrame, points: DataFrame, window: int) -> DataFrame:
    """Each query with the points of the `window` ticks up to it, as an equi-join on bins of the clock.

    A query looks into its own bin and the one before; wide intervals stay out of the plan.
    """
    own = F.floor(F.col("clock") / window)
    q = queries.withColumn("bin", F.explode(F.array(own, own - 1)))
    p = points.select("asset_id", F.col("clock").alias("p_clock"), F.col("x").alias("p_x"), F.floor(F.col("clock") / window).alias("bin"))
    near = q.join(p, ["asset_id", "bin"])
    return near.filter((F.col("p_clock") <= F.col("clock")) & (F.col("p_clock") > F.col("clock") - window)).drop("bin")


def _kernel_sum(pairs: DataFrame, kernel: Column) -> DataFrame:
    return pairs.select("asset_id", "clock", kernel.alias("__k")).groupBy("asset_id", "clock").agg(F.sum("__k").alias("density"))


def exact_angular(df: DataFrame, window: int, k: int, query_every: int = 1) -> DataFrame:
    q = df.filter(F.col("clock") % query_every == 0).select("asset_id", "clock", "x")
    return _kernel_sum(pairs_in_window(q, df, window), angular_kernel(F.col("x"), F.col("p_x"), k))


def exact_euclidean(df: DataFrame, window: int, k: int, width: float, query_every: int = 1) -> DataFrame:
    q = df.filter(F.col("clock") % query_every == 0).select("asset_id", "clock", "x")
    pairs = pairs_in_window(q, df, window).withColumn("__p", collision_column(distance(F.col("x"), F.col("p_x")), width))
    return _kernel_sum(pairs, F.pow("__p", F.lit(float(k))))


def brute_force(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Angular kernel sums over all points of the asset, without a window: `queries` is a small stated set."""
    p = points.select("asset_id", F.col("x").alias("p_x"))
    pairs = p.join(F.broadcast(queries), "asset_id") if queries.limit(1001).count() <= 1000 else p.join(queries, "asset_id")
    return _kernel_sum(pairs, angular_kernel(F.col("x"), F.col("p_x"), k))
