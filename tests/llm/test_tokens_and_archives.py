import gzip
import io
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.llm import fixtures
from tidewatch.llm import byte_bpe, lz_fingerprint, token_store, warc

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


# ---- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_merging_by_rank(reference):
    bpe = byte_bpe.loaded(RANKS, P.PATTERN)
    rng = random.Random(1)
    parts = ["a", "aa", "aaa", "the", "in", "  ", "\n", "é", "日", "0", "====", "'s", "er", "th", "A", "\U0001f600", " ", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert bpe.encode(text) == reference.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()
    assert bpe.encode("a" * 50_000) == reference.encode_ordinary("a" * 50_000)


def test_bpe_documents(spark, reference):
    df = fixtures.awkward(spark)
    rows = byte_bpe.encode_documents(df, RANKS, P.PATTERN, keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "")
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert byte_bpe.encode_documents(fixtures.empty(spark), RANKS, P.PATTERN).count() == 0
    digest = byte_bpe.digest_documents(df, RANKS, P.PATTERN).toPandas()
    want = sorted(sha256(" ".join(map(str, reference.encode_ordinary(r.text or ""))).encode()).hexdigest() for r in rows)
    assert sorted(digest.ids_sha256) == want


# ---- token files


def test_tokens_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    df = fixtures.awkward(spark)
    manifest = token_store.write_tokens(df, WORDS, 2, length=64)
    got = sorted(token_store.read_token_digests(manifest).collect(), key=lambda r: r.start)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    assert len(got) == len(rows)
    for r, g in zip(rows, got):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_store.write_tokens(fixtures.empty(spark), WORDS, 2).count() == 0


def test_words_with_marks_take_their_ids_from_stem_and_marks():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    encoder = token_store.WordEncoder(WORDS)
    rng = random.Random(3)
    parts = ["a", "House", "é", "É", "ß", "×", "÷", "ñ", "Σ", "日", "e\u0301", "\u0338", "\u0301", "'", "'s", "'LL", ".", ",%%%", "&&&", "=", "<", "1", "²", "\n", "\t", "\u00a0", " ", "  ", "\x00", "😀", "<unk>"]
    texts = ["", " ", "\n\n", "house,%%% and house.", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(20_000))]
    got = encoder.pack([x.encode() for x in texts])
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    # a new word of a known stem and known marks is put together without the tokenizer
    encoder.pack([b"unheardof !!%%"])
    learnt, encoder._learn = encoder._learn, lambda words: learnt(words) if not words else pytest.fail(f"{words} encoded anew")
    assert encoder.pack([b"Unheardof!!%%"]) == encoder.pack([b"unheardof!!%%"]) != [b""]


def test_words_alone_only_where_that_is_exact(tmp_path):
    import json

    held = json.load(open(WORDS, "rb"))
    assert token_store.splits_at_spaces(WORDS)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Metaspace", "replacement": "_", "prepend_scheme": "always", "split": False}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(held | change))
        assert not token_store.splits_at_spaces(str(path))


def test_sequences_are_views_of_the_file(spark):
    manifest = token_store.write_tokens(fixtures.documents(spark), WORDS, 2, length=32)
    row = manifest.orderBy("base").first()
    held = token_store.SequenceFile(row.path)
    total = 0
    for i in range(len(held)):
        ids, mask = held[i]
        assert len(ids) == len(mask) == 32 and not ids.flags.owndata and not ids.flags.writeable
        total += sum(mask.to_pylist())
    assert total == row.tokens
    whole = token_store.read_tokens(manifest)
    assert whole.count() == sum(len(token_store.SequenceFile(r.path)) for r in manifest.collect())


# ---- Lempel-Ziv fingerprints


def plain_fingerprint(text: str) -> str:
    """LZ78 phrases and their 128 smallest hashes, written anew."""
    import base64

    phrases, at = set(), 0
    while at < len(text):
        end = at + 1
        while text[at:end] in phrases and end < len(text):
            end += 1
        phrases.add(text[at:end])
        at = end

    def mixed(h: int) -> int:
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * by % (1 << 32)
        return h

    least = sorted({mixed(zlib.crc32(p.encode())) for p in phrases})[:128]
    return base64.b64encode(b"".join(x.to_bytes(4, "little") for x in least)).decode()


def test_lz_chain_against_brute_force(spark):
    df = fixtures.awkward(spark)
    rows = sorted(df.collect(), key=lambda r: r.text or "")
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    got = lz_fingerprint.chained_likeness(df).collect()
    assert len(got) == len(rows)
    want = []
    for r in got:  # equal texts, equal fingerprints; and they are those of a plain parse
        assert r.fingerprint == plain_fingerprint(next(x.text or "" for x in rows if x.doc_id == r.doc_id and len(x.text or "") == r.n_chars)) or r.doc_id in (None, 4)
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (lz_fingerprint.fingerprint(x) for x in (text, edited, after))
        want.append((r.doc_id, len(text), sha256(edited.encode()).hexdigest(), lz_fingerprint.pack(a), lz_fingerprint.pack(b), lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert lz_fingerprint.chained_likeness(fixtures.empty(spark)).count() == 0
    alone = lz_fingerprint.chained_likeness(fixtures.documents(spark, [(5, "abcabc")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_lz_likeness():
    a = fixtures.prose(random.Random(1), 400)
    b = fixtures.prose(random.Random(2), 400)
    f = lz_fingerprint.fingerprint
    assert lz_fingerprint.likeness(f(a), f(a)) == 1.0
    assert lz_fingerprint.likeness(f(a), f(a[:-40])) > 0.7 > lz_fingerprint.likeness(f(a), f(b))
    assert lz_fingerprint.likeness(f(""), f("")) == 1.0 and lz_fingerprint.likeness(f(""), f(a)) == 0.0


def test_lz_column(spark):
    got = lz_fingerprint.add_fingerprints(fixtures.awkward(spark)).collect()
    assert all(r.fingerprint == lz_fingerprint.pack(lz_fingerprint.fingerprint(r.text or "")) for r in got)


# ---- WARC


def archive(n: int = 12, gz: bool = True) -> list[bytes]:
    rng = random.Random(3)
    out = []
    for i in range(n):
        payload = fixtures.prose(rng, 50).encode()
        raw = warc.page_record(i, f"http://x/{i}", payload, sha256(payload).hexdigest(), None)
        out.append(warc.gzip_member(raw) if gz else raw)
    return out


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_recovers_later_records(gz):
    parts = archive(gz=gz)
    offsets = np.cumsum([0, *map(len, parts)])
    damaged = bytearray(b"".join(parts))
    middle = offsets[3] + len(parts[3]) // 2
    damaged[middle : middle + 4] = b"\x00\xff\x00\xff"
    damaged[offsets[7] : offsets[7] + 2] = b"XX"  # a lost magic number or version line
    damaged = damaged[: -len(parts[-1]) // 2]  # and an end cut short
    got = list(warc.salvage(io.BytesIO(bytes(damaged))))
    records = [x for x in got if x[2] is None]
    gaps = [x[:2] for x in got if x[2] is not None]
    assert [int(x[3]["warc-record-id"].strip("<>").rpartition(":")[2]) for x in records] == [0, 1, 2, 4, 5, 6, 8, 9, 10]
    assert gaps == [(offsets[3], offsets[4]), (offsets[7], offsets[8]), (offsets[11], len(damaged))]
    ends = sorted((x[0], x[1]) for x in got)
    assert ends[0][0] == 0 and ends[-1][1] == len(damaged) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def numbers(got) -> list[int]:
    return [int(x[3]["warc-record-id"].strip("<>").rpartition(":")[2]) for x in got if x[2] is None]


def test_salvage_of_members_with_many_records():
    parts = archive(40, False)
    whole = gzip.compress(b"".join(parts))
    got = list(warc.salvage(io.BytesIO(whole)))
    assert numbers(got) == list(range(40)) and all(x[2] is None for x in got)
    assert [x[:2] for x in got] == [(0, 0)] * 39 + [(0, len(whole))]
    bad = parts.copy()
    bad[5] = bad[5].replace(b"WARC/1.1", b"XXXX/1.1", 1)  # one record is bad, its member is sound
    bad[9] = bad[9][:-40] + b"?" * 40
    got = list(warc.salvage(io.BytesIO(gzip.compress(b"".join(bad)) + archive(1)[0])))
    assert numbers(got) == [i for i in range(40) if i not in (5, 9)] + [0]
    assert sum(x[2] is not None for x in got) == 2
    torn = bytearray(gzip.compress(b"".join(parts), 0))  # damage within: what stands before it is kept
    torn[len(torn) // 2] ^= 0xFF
    got = list(warc.salvage(io.BytesIO(bytes(torn[: len(torn) * 3 // 4]) + archive(2)[1])))
    found = numbers(got)
    assert found[:15] == list(range(15)) and found[-1] == 1 and len(found) < 40
    assert got[-1][1] == len(torn) * 3 // 4 + len(archive(2)[1]) and any(x[2] for x in got)
    plain = [p.replace(b"WARC-Block-Digest", b"X-Other") for p in parts]  # no digest: kept only if the CRC is right
    assert numbers(warc.salvage(io.BytesIO(gzip.compress(b"".join(plain))))) == list(range(40))
    wrong = bytearray(gzip.compress(b"".join(plain)))
    wrong[-6] ^= 0xFF
    assert numbers(warc.salvage(io.BytesIO(bytes(wrong)))) == []


def test_salvage_of_junk_and_nothing():
    assert list(warc.salvage(io.BytesIO(b""))) == []
    assert [x[:2] for x in warc.salvage(io.BytesIO(b"\x1f\x8b\x08 no archive WARC/1.0 either"))] == [(0, 30)]
    record = archive(1, False)[0]
    assert [x[2] is None for x in warc.salvage(io.BytesIO(b"junk\n" + record + gzip.compress(record)))] == [False, True, True]
    assert [x[2] for x in warc.salvage(io.BytesIO(gzip.compress(record)), most=100)] == ["record is longer than allowed"]


def test_pages_round_trip(spark):
    long = "x" * 500
    pages = [(3, "u", long), (1, "u", long), (2, None, long), (2, None, long), (4, "u\r\nv", "é" * 50), (5, "u", "é" * 50), (6, "u", "a" * 99), (7, "u", "a" * 99), (8, "u", ""), (9, "u", None), (None, "u", long), (10, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as digest", "3 as payload", "4 as refers_to", "5 as first")
    manifest = warc.write_pages(df)
    rows = warc.read_archives(manifest).collect()
    assert all(r.gap is None for r in rows) and len(rows) == len(pages)
    seen = sorted(((int(k) if (k := r.record_id.rpartition(":")[2]) else None), r.record_type, r.refers_to and int(r.refers_to.rpartition(":")[2]), r.payload_bytes, r.payload_digest) for r in rows if r.record_id != f"{warc.PREFIX}")
    want = []
    for k, _, html in pages:
        if k is None:
            continue
        raw = (html or "").encode()
        first = min(x for x, _, h in pages if x is not None and h == html)
        again = len(raw) >= 100 and first != k
        want.append((k, "revisit" if again else "response", first if again else None, len(raw), sha256(raw).hexdigest()))
    assert seen == sorted(want)
    assert [r.refers_to for r in rows if r.record_id == warc.PREFIX] == [f"{warc.PREFIX}1"]
    assert warc.write_pages(df.limit(0)).count() == 0
    assert warc.read_archives(warc.write_pages(df.limit(0))).count() == 0
