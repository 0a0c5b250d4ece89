"""WARC archives: a writer, and a reader that salvages what is sound in damaged files.

Writer: one gzip member for each record, payloads deduplicated by SHA-256 (later copies become
revisit records that refer to the first). Files are named by attempt, and only those that a
finished task put in the manifest count.

Reader: streams a file with memory for one record. Each record is checked (gzip CRC, version line,
headers, block length, closing blank lines, block digest). After a failed check it searches for the
next place where a whole valid record begins (a gzip member or a version line), goes on from there,
and reports the bytes between as a quarantined gap. A gzip member may hold many records, up to a whole
file: they are read in turn, a bad one is passed over up to the next version line, and of a damaged
member those before the damage are kept whose block digest is right. Such records carry the member's
offset as start and end, the last one of a sound member its end. Records of more than `most` bytes
are gaps.

Null html is the empty payload, a null url the empty URI, an empty table an empty archive. Of rows
that repeat both key and payload none precedes the other: all are written as responses. Rows with a
null key never become the one that others refer to. Pages of any length up to the reader's limit are
kept whole; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import filesystem, light, materialize, shared_dir, shuffle_partitions

LEAST_SHARED = 100
FILE_BYTES = 64 << 20
MAX_RECORD = 1 << 30
CHUNK = 1 << 20
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
PREFIX = "urn:tidewatch:page:"


# ---- writing


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items())]
    lines += [f"WARC-Block-Digest: sha256:{sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(key: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": f"<{PREFIX}{'' if key is None else key}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is None:
        return record("response", headers, http + payload)
    headers["WARC-Refers-To"] = f"<{PREFIX}{refers_to}>"
    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record("revisit", headers, http)


def gzip_member(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED, folder: str | None = None
) -> DataFrame:
    """Archives one record for each row; returns the manifest: path, records, bytes."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    plain = pages.select(
        F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    )
    plain = plain.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = (
        plain.filter(large).groupBy(F.col("digest").alias("of"))
        .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null").drop("n")
    )
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    joined = plain.join(first, (F.col("digest") == F.col("of")) & large, "left").withColumn("refers_to", refers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, n, size = None, "", 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "digest", "refers_to")]
            for k, u, digest, ref, payload in zip(*columns, batch.column("payload").cast(pa.binary()).to_pylist()):
                if sink is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, at = filesystem(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(at, compression=None)
                raw = gzip_member(page_record(k, u or "", payload, digest, ref))
                sink.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return materialize(joined.mapInArrow(light(run), "path string, records long, bytes long"), "warc-manifest")


# ---- reading


class Bad(Exception):
    """A check that failed."""


class Short(Bad):
    """A record that goes on behind what is there."""


class Tape:
    """A stream with look-ahead; what lies before the read position is dropped on demand."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.base, self.held, self.ended = stream, 0, bytearray(), False

    def fill(self, end: int) -> bool:
        """Whether bytes up to the absolute offset `end` are there."""
        while self.base + len(self.held) < end and not self.ended:
            got = self.stream.read(max(CHUNK, end - self.base - len(self.held)))
            self.ended = not got
            self.held += got
        return self.base + len(self.held) >= end

    def drop(self, to: int) -> None:
        del self.held[: to - self.base]
        self.base = to

    def view(self, start: int, size: int) -> bytes:
        self.fill(start + size)
        return bytes(self.held[start - self.base : start - self.base + size])

    def find(self, pattern: re.Pattern, start: int) -> int | None:
        """Where the pattern begins next; forgets what lies before."""
        while True:
            if m := pattern.search(self.held, start - self.base):
                return self.base + m.start()
            if self.ended:
                return None
            start = max(start, self.base + len(self.held) - 16)
            self.drop(start)
            self.fill(self.base + len(self.held) + CHUNK)

    @property
    def end(self) -> int:
        return self.base + len(self.held)


def parse_record(raw: bytes | bytearray, whole: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of `raw`; raises Bad."""
    m = VERSION.match(raw)
    if not m:
        raise Bad("no version line")
    stop = raw.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise Short("headers do not end")
    headers: dict[str, str] = {}
    for line in bytes(raw[m.end() : stop]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", length := headers.get("content-length", "")):
        raise Bad("no content length")
    start, end = stop + 4, stop + 4 + int(length)
    if len(raw) < end + 4:
        raise Short("block is cut short")
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Bad("no blank lines after the block")
    if whole and len(raw) != end + 4:
        raise Bad("bytes after the record")
    block = bytes(memoryview(raw)[start:end])
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha256" and digest.lower() != sha256(block).hexdigest():
        raise Bad("block digest differs")
    return headers, block, end + 4


def _member(tape: Tape, at: int, most: int) -> Iterator[tuple[str | None, dict[str, str], bytes, int | None]]:
    """What a gzip member holds, in turn: (None, headers, block, None) or (reason, {}, b"", None) for what is
    passed over; at last (None or the reason why the member is damaged, {}, b"", its end)."""
    z, raw, pos = zlib.decompressobj(31), bytearray(), at
    doubtful: list[tuple] = []  # records without a digest, until the member's CRC is known
    held, why, bad = 0, None, None
    while True:
        try:
            if not (part := z.unconsumed_tail):
                if not (part := tape.view(pos, CHUNK)):
                    raise Bad("gzip member is cut short")
                pos += len(part)
            raw += z.decompress(part, 8 * CHUNK)
        except zlib.error as e:
            why = f"gzip: {e}"
        except Bad as e:
            why = str(e)
        while raw and why is None:
            try:
                headers, block, length = parse_record(raw, False)
                if length > most:
                    raise Bad("record is longer than allowed")
            except Short as e:
                if len(raw) <= most and not z.eof:
                    break
                reason = str(e) if z.eof else "record is longer than allowed"
            except Bad as e:
                reason = str(e)
                if not z.eof and len(raw) < 64 and VERSION.match(bytes(raw[:12])) is None and b"WARC/".startswith(bytes(raw[:5])):
                    break
            else:
                if bad:
                    yield bad, {}, b"", None
                    bad = None
                del raw[:length]
                if "sha256:" in headers.get("warc-block-digest", "").lower():
                    yield from doubtful
                    doubtful, held = [], 0
                    yield None, headers, block, None
                else:
                    doubtful.append((None, headers, block, None))
                    held += len(block)
                    if held > most:
                        yield from doubtful
                        doubtful, held = [], 0
                continue
            bad = bad or reason
            m = VERSION.search(raw, 1)
            if m is None and not z.eof:
                del raw[: max(1, len(raw) - 16)]
                break
            del raw[: m.start() if m else len(raw)]
        if why is not None:
            yield why, {}, b"", pos
            return
        if z.eof:
            yield from doubtful
            if bad:
                yield bad, {}, b"", None
            yield None, {}, b"", pos - len(z.unused_data)
            return


def _plain(tape: Tape, at: int, most: int) -> tuple[dict[str, str], bytes, int]:
    size = 1 << 16
    while True:
        raw = tape.view(at, size)
        stop = raw.find(b"\r\n\r\n")
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})\s*\r\n", raw[: stop + 2]) if stop >= 0 else None
        need = stop + 8 + int(m[1]) if m else 0
        if need > most:
            raise Bad("record is longer than allowed")
        if stop < 0 and len(raw) == size and size < 1 << 24:
            size *= 4
            continue
        headers, block, length = parse_record(tape.view(at, need) if need > len(raw) else raw, False)
        return headers, block, at + length


CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")


def salvage(stream: BinaryIO, most: int = MAX_RECORD) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """Yields (start, end, None, headers, block) for a record, (start, end, reason, {}, b"") for a gap."""
    tape, at = Tape(stream), 0
    gap: tuple[int, str] | None = None
    torn, known = 0, set()  # up to where a damaged member was inflated, and the records read from it
    while tape.fill(at + 1):
        try:
            if tape.view(at, 3) == GZIP:
                end, last, ids = None, None, set()
                for why, headers, block, stop in _member(tape, at, most):
                    if stop is not None:
                        end = None if why else stop
                        if why:
                            reason, torn, known = why, stop, ids
                        break
                    ids.add(headers.get("warc-record-id"))
                    if gap:
                        yield gap[0], at, gap[1], {}, b""
                        gap = None
                    if last:
                        yield at, at, *last
                    last = (why, headers, block)
                if end is None:
                    if last:
                        yield at, at, *last
                    raise Bad(reason)
                if gap:
                    yield gap[0], at, gap[1], {}, b""
                    gap = None
                yield at, end, *(last or ("no record", {}, b""))
                tape.drop(at := end)
                continue
            if not VERSION.match(tape.view(at, 12)):
                raise Bad("neither a gzip member nor a version line")
            headers, block, end = _plain(tape, at, most)
            if at < torn and headers.get("warc-record-id") in known:  # stored, not compressed: it was read already
                at = end
                continue
        except Bad as e:
            gap = gap or (at, str(e))
            if (found := tape.find(CANDIDATE, at + 1)) is None:
                break
            at = found
            continue
        if gap:
            yield gap[0], at, gap[1], {}, b""
            gap = None
        yield at, end, None, headers, block
        tape.drop(at := end)
    if gap:
        yield gap[0], tape.end, gap[1], {}, b""


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = (x.decode("utf-8", "replace").partition(":") for x in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}, payload


RECORDS = "path string, start long, end long, gap string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def read_archives(files: DataFrame, path: str = "path", payloads: bool = True, most: int = MAX_RECORD) -> DataFrame:
    """One row for each record and each gap (`gap` says why) of the files in column `path`.

    `payload_digest` is computed from the payload where the record has one, else taken from its
    header; likewise `payload_bytes`. Without `payloads`, the payloads themselves stay behind.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.binary() if n == "payload" else pa.int64() if n in ("start", "end", "payload_bytes") else pa.string()) for n in names]
        )
        for batch in batches:
            for uri in batch.column(path).to_pylist():
                fs, at = filesystem(uri)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for start, end, why, headers, block in salvage(stream, most):
                        if why:
                            rows.append((uri, start, end, why, *[None] * 7))
                        else:
                            http, payload = http_payload(block)
                            kind = headers.get("warc-type")
                            declared = headers.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
                            length = int(x) if (x := http.get("content-length", "")).isdigit() else len(payload)
                            if kind != "revisit":
                                declared, length = sha256(payload).hexdigest(), len(payload)
                            ids = [x.strip("<>") if (x := headers.get(h)) else None for h in ("warc-record-id", "warc-refers-to")]
                            rows.append((uri, start, end, None, kind, *ids, headers.get("warc-target-uri"), declared, length, payload if payloads else None))
                            size += len(payload) if payloads else 0
                        if len(rows) >= 5000 or size > 16 << 20:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    n = shuffle_partitions(files.sparkSession)
    return files.select(path).repartition(n).mapInArrow(light(run), RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def page_of(column: str) -> "F.Column":
    """The page key in a record id; null if it has none."""
    return F.expr(f"try_cast(substring(`{column}`, {len(PREFIX) + 1}) as bigint)")
