"""Exact set-similarity join over word shingles by PartEnum signatures.

Sets are dealt into size bands whose widest members can still be similar. In a band, similar sets
differ in at most k elements. The hashed feature domain is cut into k // 2 + 1 parts, each part into
4 cells, so some part has at most one difference, and then three of its four cells are equal: every
set signs each part once for each cell left out, and similar sets share a signature. Going round the
parts, one of these parts even begins a run in which every l parts together have fewer than 2 * l
differences. A signature therefore carries the parities, by 16 slots, of the four parts after its own;
members of a signature group whose parities differ more are not brought together by it. That takes
away nearly all matches by chance and never a similar pair.

Sets that signatures bring together, directly or through others, are a family. Each distinct set of
a family travels once, to the task of its family, where all its pairs are counted exactly from
posting lists; families of more than BLOCK sets or BLOCK_BYTES are cut into blocks, and each block
meets each. No pair leaves a task: a row goes out for each member, with the smallest node that links
inside the task reach from it and its number of links. Components of these rows are the classes.

Null texts count as empty. Empty sets have zero shingles and link with nothing. Rows with a null key
link with nothing and have a null component. Rows that repeat a key are one node, with the links of
each. Texts of any length are taken whole. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import binary_values, by_bucket, discard, light, materialize, shuffle_partitions, text_bytes
from tidewatch.llm.graph import components
from tidewatch.llm.shingles import chunks, mix, shingle_sets

CELLS, SLOTS, AFTER = 4, 16, 4
BLOCK, BLOCK_BYTES = 1024, 32 << 20


class Bands:
    """Size bands and their parameters for `percent`: similar is 100 * both >= percent * either."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.ratio = Fraction(percent, 100)
        self.lows, self.highs, self.needed = [1], [int(1 / self.ratio)], []
        self._parts_of(0)

    def _parts_of(self, band: int) -> None:
        # |A xor B| <= (1 - r) / (1 + r) * (|A| + |B|), and both sizes are at most the band's highest
        k = int(2 * self.highs[band] * (1 - self.ratio) / (1 + self.ratio))
        self.needed.append(0 if k == 0 else (k + 2) // 2)

    def parts(self) -> np.ndarray:
        """The number of parts of each band; 0 if similar sets are equal."""
        return np.array(self.needed, np.int64)

    def reach(self, size: int) -> None:
        while self.highs[-1] < size or len(self.highs) < 2 or self.highs[-2] < size:
            self.lows.append(self.highs[-1] + 1)
            self.highs.append(int(self.lows[-1] / self.ratio))
            self._parts_of(len(self.highs) - 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.highs), sizes)


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures (64 bits) of non-empty sets, the index of the set of each, and the parities it carries."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = bands.of(sizes)
    parts_of = bands.parts()
    elements = np.concatenate(sets)
    mixed = mix(elements + np.uint64(0x51ED270B))
    which = np.repeat(np.arange(len(sets)), sizes)
    out, owner, carried = [], [], []
    for step in (0, 1):  # a set meets its own band and the next one
        band = own + step
        n1 = parts_of[band]
        n_parts = np.maximum(n1, 1)
        first = np.concatenate(([0], np.cumsum(n_parts)))
        # part from the high half of the hash, cell from its low bits, slot from those between
        part = ((elements >> np.uint64(32)) * n_parts[which].astype(np.uint64)) >> np.uint64(32)
        part = part.astype(np.int64) + first[which]
        cell = part * CELLS + (elements & np.uint64(CELLS - 1)).astype(np.int64)
        sums = np.zeros(first[-1] * CELLS, np.uint64)
        np.add.at(sums, cell, mixed)
        sums = sums.reshape(-1, CELLS)
        rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        slot = part * SLOTS + ((elements >> np.uint64(8)) & np.uint64(SLOTS - 1)).astype(np.int64)
        odd = np.bincount(slot, minlength=first[-1] * SLOTS).reshape(-1, SLOTS) & 1
        odd = (odd << np.arange(SLOTS)).sum(axis=1).astype(np.uint64)
        doc = np.repeat(np.arange(len(sets)), n_parts)
        place = np.arange(first[-1]) - first[doc]
        n = n_parts[doc]
        ring = np.zeros(len(doc), np.uint64)
        for d in range(1, AFTER + 1):
            ring |= np.where(n > d, odd[first[doc] + (place + d) % n], np.uint64(0)) << np.uint64(SLOTS * (d - 1))
        tag = (band[doc].astype(np.uint64) << np.uint64(40)) + (place * CELLS).astype(np.uint64) + np.uint64(1)
        rest = mix(mix(tag[:, None] + np.arange(CELLS, dtype=np.uint64)) + rest)
        whole = n1[doc] == 0  # one signature of the whole set
        out += [mix(mix(tag[whole]) + sums[whole].sum(axis=1, dtype=np.uint64)), rest[~whole].ravel()]
        owner += [doc[whole], np.repeat(doc[~whole], CELLS)]
        carried += [ring[whole], np.repeat(ring[~whole], CELLS)]
    return np.concatenate(out), np.concatenate(owner), np.concatenate(carried)


def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether carried parities leave it possible that the sets are similar."""
    differ = a ^ b
    near = np.bitwise_count(differ) <= 2 * AFTER + 1
    for d in range(1, AFTER):
        near &= np.bitwise_count(differ & np.uint64((1 << SLOTS * d) - 1)) <= 2 * d + 1
    return near


def _plain(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles and the digest of the shingle set (null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest = [], []
            for s in shingle_sets(text_bytes(batch.column("text")), size):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest"])

    return docs.mapInArrow(light(run), "doc_id long, n_shingles long, digest binary")


RECORD = 20  # bytes for each signature: 32 bits of it (the bucket holds further ones), parities, key


def _signed(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Signatures by bucket: blobs of signatures, then parities, then keys.

    A task signs the first set of each digest only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))
            for part in chunks(texts):
                sets, ids = [], []
                for key, s in zip(keys[part], shingle_sets(texts[part], size)):
                    digest = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None
                    if key is not None and digest is not None and digest not in seen:
                        seen.add(digest)
                        sets.append(s)
                        ids.append(key)
                if not sets:
                    continue
                sig, owner, ring = signatures(sets, bands)
                bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                bucket, low, ring = bucket[order], sig[order].astype(np.uint32), ring[order]
                who = np.array(ids, np.int64)[owner[order]]
                ends = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
                rows = [(b, b"".join(x[i:j].tobytes() for x in (low, ring, who))) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"]
                )

    return docs.mapInArrow(light(run), "bucket int, blob binary")


def ties(sig: np.ndarray, ring: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Rows (larger, smaller) that tie together the members of each signature group that its parities allow.

    At most one row for each signature.
    """
    order = np.lexsort((who, sig))
    sig, ring, who = sig[order], ring[order], who[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(new)
    first = np.repeat(start, np.diff(np.append(start, len(sig))))
    near = together(ring, ring[first])
    found = near & (who != who[first])
    out = [np.stack([who[found], who[first[found]]], axis=1)]
    # what is not tied to the first of its group may be tied to others of it
    for i in np.unique(first[~near]).tolist():
        j = i + int(np.searchsorted(sig[i:], sig[i], "right"))
        if j - i > 2:
            out.append(_ties_of(ring[i:j], who[i:j]))
    out = np.concatenate(out)
    return np.unique(out, axis=0)


def _ties_of(ring: np.ndarray, who: np.ndarray) -> np.ndarray:
    rows, left = [], np.arange(len(ring))
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = together(ring[left], ring[i])
            rows += [(who[j], who[i]) for j in left[near]]
            reached += left[near].tolist()
            left = left[~near]
    rows = np.array(rows, np.int64).reshape(-1, 2)
    rows = np.stack([rows.max(axis=1, initial=-(1 << 63)), rows.min(axis=1, initial=(1 << 63) - 1)], axis=1)
    return rows[rows[:, 0] != rows[:, 1]]


def _held(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            held.setdefault(b, []).append(blob)
    return held


def _loose(signed: DataFrame, buckets: int) -> DataFrame:
    """Distinct pairs (u, v) that tie families together.

    The members of a group of near copies share most of their signatures, which lie in all buckets, so
    the ties of a bucket are dealt out once more, by the larger key, and repeated ones fall together.
    """

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        for b in list(held):
            blobs = held.pop(b)
            columns, at = [], 0
            for kind in ("<u4", "<u8", "<i8"):
                columns.append(np.concatenate([np.frombuffer(x, kind, len(x) // RECORD, len(x) // RECORD * at) for x in blobs]))
                at += np.dtype(kind).itemsize
            del blobs
            found = ties(*columns)
            to = ((mix(found[:, 0].view(np.uint64) + np.uint64(3)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            found, ends = found[order], np.searchsorted(to[order], np.arange(buckets + 1).astype(np.uint64))
            rows = [(b, found[i:j].tobytes()) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        for b in list(held):
            found = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in held.pop(b)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    tied = by_bucket(signed, "bucket", buckets).mapInArrow(light(tie), "bucket int, blob binary")
    return by_bucket(tied, "bucket", buckets).mapInArrow(light(merge), "u long, v long")


# ---- families


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> list[np.ndarray]:
    """For each set of `a`, the places in `b` (None: in `a` itself, its own left out) of the sets similar to it."""
    other = a if b is None else b
    n = np.array([len(s) for s in other], np.int64)
    if len(a) * len(other) <= 16:
        found = []
        for i, x in enumerate(a):
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for y in other])
            near = 100 * both >= percent * (len(x) + n - both)
            if b is None:
                near[i] = False
            found.append(np.flatnonzero(near))
        return found
    elements, at = np.unique(np.concatenate(other), return_inverse=True)
    order = np.argsort(at, kind="stable")
    posting = np.repeat(np.arange(len(other), dtype=np.int32), n)[order]
    start = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(elements)))))
    found = []
    for i, x in enumerate(a):
        e = np.minimum(np.searchsorted(elements, x), len(elements) - 1)
        e = e[elements[e] == x]
        both = np.bincount(np.concatenate([posting[:0], *(posting[s:t] for s, t in zip(start[e].tolist(), start[e + 1].tolist()))]), minlength=len(other))
        near = 100 * both >= percent * (len(x) + n - both)
        if b is None:
            near[i] = False
        found.append(np.flatnonzero(near))
    return found


def reached(node: np.ndarray, links: list[np.ndarray], base: int) -> np.ndarray:
    """The smallest node that links reach from each; `links` names, for the i-th node, others by their place from `base`."""
    root = node.copy()
    for i, js in enumerate(links):
        if len(js):
            own = np.unique(np.append(root[js + base], root[i]))
            if len(own) > 1:
                root[np.isin(root, own)] = own[0]
    return root


def _members(sets: DataFrame, percent: int) -> DataFrame:
    """node, root, n_links of the members of each block pair (columns family, i, j) that has links."""
    names = ["node", "root", "n_links"]
    sets = sets.repartition(shuffle_partitions(sets.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made: list[np.ndarray] = []
        size = 0

        def meet() -> None:
            nonlocal size
            node, copies, side = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
            split = int(np.searchsorted(side, 1))
            x = [r[4].view(np.uint64) for r in held]
            found = linked(x[:split], x[split:], percent) if held[0][0][1] < held[0][0][2] else linked(x, None, percent)
            base = split if held[0][0][1] < held[0][0][2] else 0
            n = np.zeros(len(node), np.int64)
            for i, js in enumerate(found):
                if len(js):
                    n[i] += copies[js + base].sum()
                    if base:
                        n[js + base] += copies[i]
            some = n > 0
            if some.any():
                made.append(np.stack([node, reached(node, found, base), n], axis=1)[some])
                size += int(some.sum())

        def flush() -> pa.RecordBatch:
            out = np.concatenate(made)
            return pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(3)], names)

        for batch in batches:
            plain = zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "node", "copies", "side")))
            for (family, i, j, node, copies, side), raw in zip(plain, binary_values(batch.column("elements"))):
                if held and held[0][0] != (family, i, j):
                    if len(held) > 1:
                        meet()
                    held = []
                    if size > 100_000:
                        yield flush()
                        made, size = [], 0
                held.append(((family, i, j), node, copies, side, raw.copy()))
        if len(held) > 1:
            meet()
        if made:
            yield flush()

    return sets.select("family", "i", "j", "node", "copies", "side", "elements").mapInArrow(light(run), "node long, root long, n_links long")


def _dealt(sets: DataFrame) -> DataFrame:
    """Adds the block pairs i <= j that each set goes to, and on which side of them it stands."""
    large = sets.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    large = large.select("family", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")).filter("blocks > 1")
    rows = sets.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j"), (F.col("own") > x).cast("int").alias("side")))
    return rows.select("family", "node", "copies", "elements", F.explode(to).alias("to")).select("family", "to.i", "to.j", "to.side", "node", "copies", "elements")


def near_classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, buckets: int | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (the number of other rows it is similar to) of every row."""
    docs = _plain(df, key, text)
    buckets = buckets or shuffle_partitions(df.sparkSession)
    rows = materialize(summaries(docs, size), "shingle-summaries")
    loose = materialize(_loose(_signed(docs, size, percent, buckets), buckets), "loose-links")

    classes = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.filter("copies > 1"), "classes")
    member = rows.join(classes, "digest", "left")
    member = member.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"))
    member = materialize(member, "members")
    discard(rows, classes)

    family = components(loose)
    nodes = member.join(family, F.col("doc_id") == F.col("node")).groupBy("class").agg(F.min("component").alias("family"), F.max("copies").alias("copies"))
    sets = materialize(_sets(docs, nodes, size), "sets")
    discard(loose, family)
    found = materialize(_members(_dealt(sets), percent), "found")
    discard(sets)
    links = found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    label = components(_tied(links, member))
    number = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = materialize(label.join(number, "node", "left"), "labels")
    discard(found, label)
    out = member.join(known, F.col("class") == F.col("node"), "left")
    more = F.when(F.col("class").isNotNull(), F.col("copies") - 1 + F.coalesce("n_links", F.lit(0)))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id"), F.coalesce(more, F.lit(0)).alias("n_links"))
    out.reads = [member, known]
    return out


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """family, node, copies, n_shingles and elements of the texts of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(shingle_sets(text_bytes(batch.column("text")), size))
            columns = [*(batch.column(c) for c in ("family", "node", "copies")), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["family", "node", "copies", "n_shingles", "elements"])

    rows = docs.join(nodes, F.col("doc_id") == F.col("class")).select("family", F.col("class").alias("node"), "copies", "text")
    return rows.mapInArrow(light(run), "family long, node long, copies long, n_shingles long, elements binary")


def _tied(links: DataFrame, member: DataFrame) -> DataFrame:
    """The links, and the classes of each key that stands in several; repeated keys make one node."""
    same = member.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("lo", "hi")
    return links.union(same)
