"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into the shortest phrases not met before (LZ78). The set of
its phrases is hashed and the smallest `size` hashes kept (bottom-k minimum hashing). The likeness
of two fingerprints estimates the Jaccard similarity of the phrase sets: the share of the smallest
hashes of both together that are in both. Texts that compress well together share many phrases.

Null texts count as empty; an empty text has the empty fingerprint, which is like another empty
one (1.0) and unlike all others (0.0). Equal texts have equal fingerprints. Repeated rows and
repeated keys are kept, each on its own row; rows with equal keys are ordered by text.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bucket_bounds, by_bucket, light, shuffle_partitions, text_strings, with_bucket

SIZE = 128


def parse(text: str, phrases: set[str], phrase: str = "") -> str:
    """Adds the phrases of `text` to the set, going on from an open phrase; returns the one left open."""
    add = phrases.add
    for char in text:
        phrase += char
        if phrase not in phrases:
            add(phrase)
            phrase = ""
    return phrase


def hashes(phrases: set[str], size: int = SIZE) -> np.ndarray:
    """The smallest hashes in ascending order."""
    h = np.fromiter(map(zlib.crc32, map(str.encode, phrases)), np.uint32, len(phrases))
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    if len(h) > 4 * size:
        h = np.partition(h, 2 * size)[: 2 * size]
    return np.unique(h)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(shared <= both[-1]) / len(both))


def pack(h: np.ndarray) -> str:
    return base64.b64encode(h.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    phrases: set[str] = set()
    last = parse(text, phrases)
    if last:
        phrases.add(last)
    return hashes(phrases, size)


def fingerprint_pair(text: str, tail: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edit, whose last half gives way to the first as many of `tail`."""
    half = len(text) // 2
    keep, edited = text[: len(text) - half], text[: len(text) - half] + tail[:half]
    phrases: set[str] = set()
    last = parse(keep, phrases)
    other = phrases.copy()
    out = []
    for known, rest in ((phrases, text[len(keep) :]), (other, edited[len(keep) :])):
        if end := parse(rest, known, last):
            known.add(end)
        out.append(hashes(known, size))
    return out[0], out[1], edited


def add_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """Adds the fingerprint of every text; a column of that name that is there already is replaced."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: pack(fingerprint(x or "", size)))

    return df.withColumn(name, F.pandas_udf(of, "string")(F.col(text)))


def chained_likeness(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Fingerprints each document, its edit with the next one's beginning, and compares them.

    The next document is that with the next smaller key; after the last comes the first. Texts move
    once, into key ranges; each range also gets the first document of the range after it. Null keys
    come last.
    """
    spark = df.sparkSession
    plain = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = bucket_bounds(plain, "doc_id", shuffle_partitions(spark))
    dealt = with_bucket(plain, "doc_id", bounds, "bucket")
    # one row for each range, whatever the input
    heads = sorted(dealt.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect(), reverse=True)
    follow = [(heads[i]["doc_id"], heads[i - 1]["bucket"]) for i in range(len(heads))]
    guests = F.broadcast(spark.createDataFrame(follow, "head long, guest long"))
    dealt = dealt.join(guests, F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    lent = F.struct(F.col("guest").alias("bucket"), F.lit(True).alias("guest"))
    rows = F.when(F.col("head").isNull() & F.col("guest").isNull(), F.array(own)).otherwise(F.array(own, lent))
    dealt = dealt.select("doc_id", "text", F.explode(rows).alias("r")).select("doc_id", "text", "r.bucket", "r.guest")
    dealt = by_bucket(dealt, "bucket", len(bounds) + 1).sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before
        rows: list[tuple] = []

        def settle(before: tuple, after: str) -> None:
            doc_id, text = before
            a, b, edited = fingerprint_pair(text, after, size)
            rows.append((doc_id, len(text), sha256(edited.encode()).hexdigest(), a, b))

        last_bucket, last_guest = None, True
        for batch in batches:
            for bucket, guest, doc_id, text in zip(
                batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(),
                batch.column("doc_id").to_pylist(), text_strings(batch.column("text")),
            ):
                if bucket == last_bucket and not last_guest:
                    settle(held, text)
                    if guest:  # the last of this range: only now is its neighbour's fingerprint needed alone
                        rows[-1] += (fingerprint(text, size),)
                held, last_bucket, last_guest = (doc_id, text), bucket, guest
            # near_next needs the fingerprint of the next row, which settles one row later
            ready = [i for i in range(len(rows)) if len(rows[i]) == 6 or i + 1 < len(rows)]
            if ready:
                out = [(r, rows[i + 1][3] if len(r) == 5 else r[5]) for i, r in ((i, rows[i]) for i in ready)]
                rows = rows[len(ready) :]
                yield _compared(out, size)
        if rows:
            yield _compared([(r, r[5]) for r in rows], size)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(light(run), schema)


def _compared(rows: list[tuple], size: int) -> pa.RecordBatch:
    a, b = [r[3] for r, _ in rows], [r[4] for r, _ in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r, _ in rows], pa.int64()),
            pa.array([r[1] for r, _ in rows], pa.int64()),
            pa.array([r[2] for r, _ in rows]),
            pa.array(list(map(pack, a))),
            pa.array(list(map(pack, b))),
            pa.array([likeness(x, y, size) for x, y in zip(a, b)]),
            pa.array([likeness(x, after, size) for x, (_, after) in zip(a, rows)]),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
