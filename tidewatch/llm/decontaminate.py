"""Finds short test items inside long documents by size-partitioned MinHash containment search.

All of it is DataFrame operations. Items are partitioned by their number of distinct word shingles,
in steps of a quarter. Each partition has a sketch depth: the items' `depth` smallest shingle hashes
are indexed, with depth = floor((1 - t) * largest size) + 1. A document that contains a share t of
an item misses at most depth - 1 of its shingles, so it holds one of any `depth` of them: no such
document is lost. A partition also has a least document size, below which it isn't searched.
Documents look up the hashes of all their shingles; hits are candidates, which are then checked by
exact containment of the shingles themselves.

The index is broadcast only if it has at most BROADCAST_ROWS rows, else it is joined by shuffle.

Texts are lower-cased and split on ASCII white space. Null texts count as empty. An item with fewer
words than a shingle is one shingle of its own length, looked up among the runs of that length; items
without words are found nowhere, rows with null keys are left out. Rows that repeat a document key are searched each, and the best of them counts; likewise rows
that repeat an item key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

BROADCAST_ROWS = 200_000


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def _runs(made: str, size: int) -> Column:
    """An array with `made` for each start of a shingle in column `w`; in it, i is the start."""
    return F.expr(f"if(size(w) < {size}, array(), transform(sequence(0, size(w) - {size}), i -> {made}))")


def hashed(size: int) -> Column:
    return _runs("xxhash64(" + ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(size)) + ")", size)


def spelled(size: int) -> Column:
    return F.array_distinct(_runs(f"array_join(slice(w, i + 1, {size}), ' ')", size))


def index(items: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """h, item_id, least: the sketches of all items with the least size of documents to search."""
    w = Window.partitionBy("item_id", "copy").orderBy(F.xxhash64("h"), "h")
    item = items.filter(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), F.xxhash64(text).alias("copy"), words(text).alias("w"))
    item = item.select("item_id", "copy", F.array_distinct(hashed(size)).alias("hs"))
    part = F.floor(F.log(F.greatest(F.size("hs"), F.lit(1)).cast("double")) / F.log(F.lit(1.25)))
    item = item.withColumn("n", F.size("hs")).withColumn("part", part)
    parts = item.groupBy("part").agg(
        (F.floor(F.max("n") * (100 - percent) / 100) + 1).alias("depth"), F.ceil(F.min("n") * percent / 100).alias("least")
    )
    item = item.join(parts, "part").select("item_id", "copy", "depth", "least", F.explode_outer("hs").alias("h")).filter("h is not null")
    return item.withColumn("rank", F.row_number().over(w)).filter("rank <= depth").select("h", "item_id", "least").distinct()


def contained(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    size: int = 5, percent: int = 80,
) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of the pairs with 100 * n_shared >= percent * n_item."""
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    items = items.filter(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    n_words = F.size(words("text"))
    short = [r["n"] for r in items.select(n_words.alias("n")).filter(f"n > 0 and n < {size}").distinct().collect()]  # fewer than `size` rows
    near = _held(docs, items, size, percent)
    for n in sorted(short):
        near = near.union(_held(docs, items.filter(n_words == n), n, percent))
    best = near.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", F.round(F.col("b.col1"), 6).alias("containment"))


def _held(docs: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of the pairs, for shingles of `size` words."""
    sketch = materialize(index(items, "item_id", "text", size, percent), "item-sketches")
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    grams = docs.select("doc_id", words("text").alias("w")).select("doc_id", hashed(size).alias("hs"))
    # explode would bring filters on the array that are pushed down and split the text for each shingle
    grams = grams.select("doc_id", F.size("hs").alias("n"), F.explode_outer("hs").alias("h"))
    found = grams.join(sketch, "h").filter("n >= least").select("doc_id", "item_id").distinct()
    found = materialize(found, "candidates")

    item = items.select("item_id", words("text").alias("w")).select("item_id", spelled(size).alias("item"))
    near = docs.join(found, "doc_id").select("doc_id", "item_id", words("text").alias("w"))
    near = near.select("doc_id", "item_id", spelled(size).alias("doc")).join(item, "item_id")
    return near.select(
        "doc_id", "item_id", F.size("item").cast("long").alias("n_item"), F.size(F.array_intersect("item", "doc")).cast("long").alias("n_shared")
    ).filter(f"n_shared > 0 and 100 * n_shared >= {percent} * n_item")
