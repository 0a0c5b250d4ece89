"""Byte-level BPE encoding and decoding over an Aho-Corasick automaton.

Token bytes are mapped to Latin-1 characters, so one automaton finds every vocabulary entry in a
piece. Encoding walks from left to right: take the longest entry that starts here, keep it if it is
compatible with its left neighbour, else try its longest proper prefix that is an entry, and step
back when none is left. Two neighbours are compatible if merging their joined bytes gives just
these two again; that is memoised. Every position is entered a bounded number of times, so time is
linear, and the result equals that of applying the merges by rank.

Null texts count as empty and give no ids. Empty tables give empty results. Repeated rows are
encoded each on its own. Other columns are kept as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import light, remembered, text_strings

PIECE_CACHE = 200_000
PAIR_CACHE = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder for ranked byte merges; `pattern` cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for byte {missing[0]}")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for raw, i in ranks.items():
            self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def shorter(self, token: int) -> int:
        """The longest proper prefix that is a token, or -1."""
        if (got := self._shorter.get(token)) is None:
            raw, got = self.bytes_of[token], -1
            for end in range(len(raw) - 1, 0, -1):
                if (got := self.ranks.get(raw[:end], -1)) >= 0:
                    break
            self._shorter[token] = got
        return got

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for one that no merge makes."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min(
                    (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i)
                    for i in range(len(parts) - 1)
                )
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (
                (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            )
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens merge into just these two."""
        key = (left, right)
        if (got := self._fits.get(key)) is None:
            if len(self._fits) >= PAIR_CACHE:
                self._fits.clear()
            got = self._fits[key] = self._check(left, right)
        return got

    def _check(self, left: int, right: int) -> bool:
        # Undo the merges of both sides from the last to the first. Whenever the two tokens that
        # touch could have merged before either was taken up in a larger one, the border is broken.
        before = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                # of equal ranks the one on the left merges first, and the border is on the left
                before, right = right + 1, b[0]

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size + 1] = token
        bytes_of, fits = self.bytes_of, self.fits
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(bytes_of[token])
            if not dead[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            while (token := self.shorter(token)) < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(bytes_of[token])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self._pieces
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                if len(cache) >= PIECE_CACHE:  # what was used lately stays for another generation
                    self._older, self._pieces = cache, {}
                    cache = self._pieces
                ids = self._older.get(piece)
                if ids is None:
                    ids = self.encode_piece(piece.encode())
                cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoders(dict):
    """The encoders of a worker process; between tasks they keep their automaton and pairs, not the pieces."""

    def clear(self) -> None:
        for bpe in self.values():
            bpe._pieces, bpe._older = {}, {}


_LOADED: dict[tuple[str, str], ByteBPE] = remembered(Encoders())


def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process, kept between tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_documents(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None
) -> DataFrame:
    """Adds `ids` (array of int), the ids of column `text`; `keep` names the columns to carry.

    A column called `ids` that is there already is replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != ids]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            got = [bpe.encode(x) for x in text_strings(batch.column(text))]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.list_(pa.int32()))], [*keep, ids])

    carried = list(dict.fromkeys([*keep, text]))
    return df.select(*carried).mapInArrow(light(run), schema)


def decode_documents(
    df: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """Adds `raw` (binary), the bytes that column `ids` stands for; null ids give none."""
    keep = [c for c in (df.columns if keep is None else keep) if c != raw]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(raw, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            got = [bpe.decode(x or []) for x in batch.column(ids).to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.binary())], [*keep, raw])

    carried = list(dict.fromkeys([*keep, ids]))
    return df.select(*carried).mapInArrow(light(run), schema)


def digest_documents(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text and keeps counts and digests instead of the ids.

    Same encoder as `encode_documents`; the ids stay in the worker, so that they aren't sent to the
    JVM just to be hashed there.
    """
    from hashlib import sha256

    schema = T.StructType(
        [df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        shown = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            n, a, b = [], [], []
            for x in text_strings(batch.column(text)):
                ids = bpe.encode(x)
                n.append(len(ids))
                a.append(sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                b.append(sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(light(run), schema)
