"""What a sketch would take, from real cell counts, against keeping the raw window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Measured bytes of a live cell in an object and in a packed representation.
OBJECT_CELL, PACKED_CELL = 761, 345


def model(cells: DataFrame, window: int, dim: int, cell_bytes: int = PACKED_CELL) -> DataFrame:
    """sketch_bytes, raw_bytes, times_raw and crossover_dim, the dimension from which the sketch is smaller."""
    size = F.col("cells") * F.lit(cell_bytes)
    return cells.select(
        "asset_id", "cells", size.alias("sketch_bytes"), F.lit(window * dim * 8).alias("raw_bytes"),
        (size / F.lit(window * dim * 8)).alias("times_raw"), (size / F.lit(window * 8)).alias("crossover_dim"),
    )


def sweep(cells: DataFrame, rows: int, wanted: tuple[int, ...], window: int, dim: int) -> DataFrame:
    """The model for other numbers of hash rows, cells growing in proportion."""
    each = cells.withColumn("rows", F.explode(F.array(*map(F.lit, wanted)))).withColumn("cells", (F.col("cells") * F.col("rows") / rows).cast("long"))
    return each.select("asset_id", "rows").join(model(each.drop("rows"), window, dim), "asset_id") if len(wanted) == 1 else _stacked(cells, rows, wanted, window, dim)


def _stacked(cells: DataFrame, rows: int, wanted: tuple[int, ...], window: int, dim: int) -> DataFrame:
    out = None
    for n in wanted:  # a handful of settings
        one = model(cells.withColumn("cells", (F.col("cells") * n / rows).cast("long")), window, dim).withColumn("rows", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out
