"""Toxicity, language-model scores, transcripts: held-out quality, brute force, awkward rows."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tidewatch.llm import bitmix, chat, lm_score, toxicity

# ---- toxicity


def labelled(n: int, seed: int) -> list[tuple[int, str, int]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words, bad = fixtures.prose(rng, rng.randrange(1, 120)).split(), i % 3 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["scum", "moron,", "qvex" + rng.choice("abcdefgh") * 3]))
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = labelled(900, 1)
    docs = fixtures.documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (9999, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, learn=~toxicity.in_fold("doc_id", 3, 1))
    return rows, model, {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}


def test_toxicity_held_out(scored):
    rows, _, score = scored
    held = [(score[i], y) for i, _, y in rows if crc32(str(i).encode()) % 3 == 1]
    right = sum((s >= 0.7) == bool(y) for s, y in held) / len(held)
    assert len(held) > 100 and right > 0.95


def test_toxicity_sees_every_window(scored):
    _, model, _ = scored
    scorer = toxicity.Scorer(model)
    calm = fixtures.prose(random.Random(8), 3000).split()
    for at in (0, 1499, 2999):
        words = calm.copy()
        words[at:at] = ["scum", "moron", "scum"]
        assert scorer.score([" ".join(words).encode()])[0] > 0.7
    assert scorer.score([" ".join(calm).encode()])[0] < 0.5
    for n in (0, 1, 31, 32, 33, 48, 49, 100):
        hit = np.zeros(max(n, 1), bool)
        for s in toxicity.windows_of(n):
            hit[s : s + 32] = True
        assert hit[:n].all()


def test_toxicity_awkward(spark, scored):
    _, model, _ = scored
    df = fixtures.awkward(spark)
    got = toxicity.score(df, model)
    assert got.columns == [c for c in df.columns if c != "score"] + ["score"] and got.count() == df.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(fixtures.empty(spark), model).count() == 0
    none = toxicity.fit(fixtures.empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(fixtures.documents(spark), none).collect()} == {0.5}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(rng).items() if k not in ("word", "gram")}
    p |= {k: rng.standard_normal(p[k].shape) * 0.3 for k in ("cf", "cb", "ba", "bo")}
    x = rng.standard_normal((12, 16))
    rows = rng.integers(1, 12, (6, 7))
    rows[1, 4:], rows[2, 1:], rows[3] = 0, 0, 0  # padded windows, one of nothing else
    target = np.array([1, 0, 1, 0, 0, 1.0])

    def loss() -> float:
        z = toxicity.forward(p, toxicity.project(p, x), rows)
        return float((np.logaddexp(0, z) - target * z).sum())

    k: dict = {}
    z = toxicity.forward(p, toxicity.project(p, x), rows, k)
    g, dx = toxicity.backward(p, x, toxicity.project(p, x), rows, k, toxicity.sigmoid(z) - target)
    for name, array, grad in [*((n, p[n], g[n]) for n in p), ("x", x, dx)]:
        for at in np.ndindex(array.shape):
            held = array[at]
            array[at] = held + 1e-5
            up = loss()
            array[at] = held - 1e-5
            down = loss()
            array[at] = held
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-7, (name, at)
    assert not dx[0].any()


def test_padding_does_not_alter_a_score():
    rng = np.random.default_rng(4)
    p = toxicity.fresh(rng)
    px = toxicity.project(p, rng.standard_normal((9, 16)).astype(np.float32))
    short = rng.integers(1, 9, (3, 5))
    padded = np.pad(short, ((0, 0), (0, 6)))
    assert np.allclose(toxicity.forward(p, px, short), toxicity.forward(p, px, padded), atol=1e-6)


# ---- context mixing


def test_bits_are_those_of_a_distribution():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (bitmix.CONTEXTS // 64, 256))
    odds = bitmix.odds_of(counts[:8])
    for d in range(8):  # the two bytes that differ in bit d have opposite odds of it
        assert (odds[:, 0, d] == -odds[:, 1 << (7 - d), d]).all()
    table = np.zeros(bitmix.CONTEXTS * 256, np.int64)
    assert np.allclose(bitmix.Mixer(table).bits([b"", b"abc"])[0], 8.0, atol=0.6)
    c = bitmix.Counter()
    c.add([fixtures.prose(random.Random(4), 3000).encode()])
    for b, blob in c.blocks():
        part = bitmix.merge_block([blob]).reshape(-1).view(np.int64)
        table[b * bitmix.BLOCK * 256 : b * bitmix.BLOCK * 256 + len(part)] = part
    mixer = bitmix.Mixer(table)
    known, other = fixtures.prose(random.Random(5), 300).encode(), bytes(np.random.default_rng(2).integers(1, 255, 1500, dtype=np.uint8))
    assert mixer.bits([known])[0] / len(known) < 4 < mixer.bits([other])[0] / len(other)
    long = known * 30
    assert mixer.bits([known, long, b"", known])[[0, 3]] == pytest.approx(mixer.bits([known])[0])


def test_next_byte_probabilities_sum_to_one():
    table = np.zeros(bitmix.CONTEXTS * 256, np.int64)
    c = bitmix.Counter()
    c.add([b"abracadabra " * 50])
    for b, blob in c.blocks():
        part = bitmix.merge_block([blob]).reshape(-1).view(np.int64)
        table[b * bitmix.BLOCK * 256 : b * bitmix.BLOCK * 256 + len(part)] = part
    mixer = bitmix.Mixer(table)
    # of a text of one byte, the first factor is the byte's probability, the second that of the closing zero
    x = [bytes([i]) for i in range(256)]
    both = mixer.bits(x)
    empty = mixer.bits([b""])[0]
    first = np.array([_first_bits(mixer, b) for b in x])
    assert np.isclose((2.0**-first).sum(), 1.0, atol=1e-4) and np.isclose(first[0], empty) and (both >= first).all()


def _first_bits(mixer: bitmix.Mixer, raw: bytes) -> float:
    from unittest import mock

    flat = np.frombuffer(b"\0" * bitmix.LEAD + raw, np.uint8)
    with mock.patch.object(bitmix, "laid_out", lambda texts: (flat, np.array([bitmix.LEAD]), np.array([1]))):
        return float(mixer.bits([raw])[0])


def _learnt(texts: list[bytes]) -> bitmix.Mixer:
    c = bitmix.Counter()
    c.add(texts)
    table = np.zeros(bitmix.CONTEXTS * 256, np.int64)
    for b, blob in c.blocks():
        part = bitmix.merge_block([blob]).reshape(-1).view(np.int64)
        table[b * bitmix.BLOCK * 256 : b * bitmix.BLOCK * 256 + len(part)] = part
    return bitmix.Mixer(table)


def test_low_and_high_orders_predict():
    rng = random.Random(8)
    # after q comes u, whatever stands before q: only one byte back tells it where the rest is new
    low = _learnt([bytes([rng.randrange(128, 192), rng.randrange(128, 192)]) + b"qu" for _ in range(3000)])
    fresh = [bytes([x, x]) + b"q" for x in range(200, 230)]
    assert (low.bits([t + b"u" for t in fresh]) < low.bits([t + b"v" for t in fresh]) - 2).all()
    # the byte after four blanks is told by what stands six bytes back only
    pairs = list(zip(b"abcdefgh", b"stuvwxyz"))
    high = _learnt([b"".join(bytes([x, 46]) + b"    " + bytes([y]) for x, y in rng.sample(pairs, 8)) for _ in range(300)])
    right = high.bits([bytes([x, 46]) + b"    " + bytes([y]) for x, y in pairs])
    wrong = high.bits([bytes([x, 46]) + b"    " + bytes([y ^ 1]) for x, y in pairs])
    assert (right < wrong - 1).all()


def _follows(texts: list[bytes]) -> dict[bytes, Counter]:
    """What follows each long context, by the bytes of the context, gathered in plain Python."""
    out: dict[bytes, Counter] = {}
    for t in texts:
        t = bytes(bitmix.LEAD) + t + b"\0"
        for i in range(bitmix.LEAD + bitmix.NEAR, len(t)):
            if _has_long(t[i - bitmix.NEAR : i]):
                out.setdefault(t[i - bitmix.LONG : i], Counter())[t[i : i + 16].ljust(16, b"\0")] += 1
    return out


def _has_long(near: bytes) -> bool:
    step, most = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = (int.from_bytes(b"\0\0" + near, "little") * step) & most
    return ((h ^ h >> 31) * step & most) >> 59 == 0


def _store_of(texts: list[bytes]) -> tuple:
    context, follows = bitmix.continuations(texts)
    return bitmix.likeliest(*bitmix.summed(context, follows, np.ones(len(context), np.int64)))


@pytest.mark.parametrize("with_store", [False, True])
def test_long_text_is_one_adaptive_pass(with_store):
    learnt = fixtures.prose(random.Random(6), 3000).encode()
    taught = [learnt, learnt[4000:9000], learnt[5000:7000] + b" and then"]
    mixer = _learnt([learnt])
    raw = (fixtures.prose(random.Random(7), 400) + " " + "".join(random.Random(9).choices("abcdefgh ", k=2000))).encode() + learnt[4500:7600]
    store, plain = (_store_of(taught), _follows(taught)) if with_store else (None, {})
    flat, starts, sizes = bitmix.laid_out([raw])
    context = np.stack(list(bitmix.slots(flat, np.arange(starts[0], starts[0] + sizes[0]))))
    w, hits, want, said, spoke = mixer.begin["w"].astype(float), mixer.begin["hits"].astype(float), 0.0, (0, b"", 0.0), 0
    for at in range(starts[0], starts[0] + sizes[0]):
        before, byte = bytes(flat[:at]), int(flat[at])
        if at - starts[0] >= bitmix.NEAR and _has_long(before[-bitmix.NEAR :]) and (next_ := plain.get(before[-bitmix.LONG :])):
            most = max(next_.values())
            odds = max(-127, min(127, round(bitmix.SCALE * math.log((most + 0.4) / (next_.total() - most + 0.4)))))
            if odds:  # of ties the first in the order of its two numbers, the later one first
                words = lambda x: (int.from_bytes(x[8:], "little"), int.from_bytes(x[:8], "little"))
                said = at, min((x for x, n in next_.items() if n == most), key=lambda x: words(x)), odds
        words = [mixer.table[int(c) << 8 | byte] for c in context[:, at - starts[0]]]
        words = np.array(words).view(np.int8).reshape(-1, 8)
        foretold = said[1][at - said[0]] if at - said[0] < len(said[1]) and before[said[0] :] == said[1][: at - said[0]] else None
        for d in range(8):  # weights and map are updated before the next bit is read
            agreed = foretold is not None and foretold >> (8 - d) == byte >> (8 - d)
            last = (said[2] if foretold >> (7 - d) == byte >> (7 - d) else -said[2]) if agreed else 0.0
            spoke += last != 0
            x = np.append(words[:, d].astype(float), last)
            s = w[:, d] @ x
            p, side, cell = 1 / (1 + np.exp(-s)), np.sign(s), min(int(2 * abs(s)), bitmix.STEPS - 1)
            want -= np.log2((p + 0.5 + side * (hits[d, cell] - 0.5)) / 2)
            hits[d, cell] += bitmix.HIT_RATE * side * side * ((side > 0) - hits[d, cell])
            w[:, d] += bitmix.RATE / bitmix.SCALE**2 * (1 - p) * x
    assert len(raw) > 2 * 2048 and (spoke > 3000) == with_store
    assert mixer.bits([b"short", raw, b"", raw[:3000]], store)[1] == pytest.approx(want, rel=1e-4)


def test_store_of_long_contexts_grows_and_tells_repeated_texts(spark):
    # contexts learnt grow with the texts, and a text that was learnt twice costs less than one learnt once
    texts = [bytes(random.Random(i).choices(b"abcdefgh ijklmnop", k=3000)) for i in range(60)]
    assert len(_store_of(texts)[0]) > 5 * len(_store_of(texts[:10])[0]) > 0
    df = fixtures.documents(spark, [(i, t.decode()) for i, t in enumerate(texts)] + [(100 + i, texts[i].decode()) for i in range(5)])
    cost = {r.doc_id: -r.score for r in lm_score.scores(df.repartition(7), learn=F.lit(True)).collect()}
    assert len(cost) == 65 and max(cost[i] for i in range(5)) < min(cost[i] for i in range(5, 60))
    assert all(cost[i] == pytest.approx(cost[100 + i], rel=1e-6) for i in range(5))
    again = {r.doc_id: -r.score for r in lm_score.scores(df.coalesce(1), learn=F.lit(True)).collect()}
    assert all(again[i] == pytest.approx(cost[i], rel=1e-6) for i in cost)  # however the rows are dealt


def test_texts_of_several_batches_are_dealt_by_length():
    import pyarrow as pa

    rng = random.Random(2)
    sizes = [[rng.choice([0, 5, 900, 30_000, 90_000]) for _ in range(400)] for _ in range(5)] + [[], [lm_score.AT_ONCE + 7, None], [3]]
    rows = [(i * 1000 + j, j % 3 == 0, None if n is None else "x" * n) for i, part in enumerate(sizes) for j, n in enumerate(part)]
    schema = pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows if r[0] // 1000 == i], schema) for i in range(len(sizes))]
    pieces = list(lm_score._alike(iter(batches)))
    assert sorted(r for p in pieces for r in zip(*p)) == sorted((i, yes, (t or "").encode()) for i, yes, t in rows)
    total = sum(n or 0 for part in sizes for n in part)
    assert len(pieces) < total / lm_score.CHUNK + 4 and any({i // 1000 for i in keys} >= {0, 1} for keys, _, _ in pieces)
    for _, _, texts in pieces:
        assert sum(map(len, texts)) <= lm_score.CHUNK + max(map(len, texts))
    assert list(lm_score._alike(iter([]))) == list(lm_score._alike(iter(batches[5:6]))) == []


def test_tokens_are_the_words_and_ends():
    rng = random.Random(1)
    texts = [b"", b" ", b"a", b"\n\nA a aA ", *(bytes(rng.choice(b"aAbB \t\n\x0b\x0c\r\x00\x1c\xc3") for _ in range(rng.randrange(300))) for _ in range(1000))]
    texts += [b"x" * n + b" " + b"X" * n for n in range(1, 200)] + [b"q" * 700_000 + b"\0"]
    h, sizes = lm_score.tokens(texts)
    words = [w for t in texts for w in (*t.lower().split(), None)]
    known: dict = {}
    assert sizes.tolist() == [len(t.split()) + 1 for t in texts] and len(h) == len(words)
    assert all(known.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(known.values())) == len(known)
    assert [x.tolist() for x in lm_score.tokens([])] == [[], []]


def test_base_scores(spark):
    df = fixtures.awkward(spark)
    got = lm_score.scores(df, learn=~toxicity.in_fold("doc_id", 7, 2)).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    count, tokens = Counter(), []
    for r in rows:
        w = [*(r.text or "").encode().lower().split(), None]
        tokens.append((r.doc_id, w))
        if r.doc_id is not None and crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_score.scores(fixtures.empty(spark), learn=F.lit(True)).count() == 0
    nothing = lm_score.scores(fixtures.documents(spark, [(1, "a b"), (2, None)]), learn=F.lit(False)).collect()
    assert [(r.train_tokens, r.base_score) for r in nothing] == [(0, 0.0)] * 2


# ---- transcripts


def turns(seed: int) -> list[dict]:
    rng = random.Random(seed)
    roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * rng.randrange(1, 5)
    return [{"turn": i, "role": r, "text": "\n".join(fixtures.prose(rng, rng.randrange(2, 30)) for _ in range(rng.randrange(1, 4))) + ("?" if r == "user" else ".")} for i, r in enumerate(roles)]


def test_roles_are_recovered():
    model = chat.train(chat.written(i, turns(i)) for i in range(200))
    right = total = 0
    for i in range(200, 300):
        lines, states = chat.written(i, turns(i))
        path = chat.viterbi(model, chat.observe(lines))
        right += sum(a // 2 == b // 2 for a, b in zip(states, path))
        total += len(lines)
        whole = [(t["role"], t["text"]) for t in turns(i)]
        assert len(chat.turns(model, "\n".join(lines))) == len(whole)
    assert right / total > 0.97
    assert chat.turns(model, "") == []


def test_viterbi_is_the_best_path():
    from itertools import product

    model = chat.train(chat.written(i, turns(i)) for i in range(20))
    for seed in range(20):
        symbols = np.random.default_rng(seed).integers(0, chat.SYMBOLS, 4)

        def value(path):
            s = model["start"][path[0]] + model["emit"][path[0], symbols[0]]
            return s + sum(model["move"][a, b] + model["emit"][b, x] for a, b, x in zip(path, path[1:], symbols[1:]))

        assert value(chat.viterbi(model, symbols)) == pytest.approx(max(value(p) for p in product(range(6), repeat=4)))


def test_transcripts_of_a_table(spark):
    rows = [(i, t["turn"], t["role"], t["text"]) for i in range(60) for t in turns(i)]
    rows += [(None, 0, "user", "x"), (70, None, None, None), (71, 0, "user", "same"), (71, 0, "user", "same"), (72, 5, "narrator", "")]
    rows += [(73, n, "user" if n % 2 == 0 else "assistant", f"line {n}") for n in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.pieces(df)
    got = chat.recovered(pieces, chat.fit(pieces)).collect()
    assert sum(r.n_turns for r in got) == len(rows)
    assert {r.conv_id for r in got if r.conv_id is None} == {None}
    whole = chat.fit(pieces)
    for key in (73,):  # pieces find what the conversation as a whole gives
        said = [{"turn": n, "role": "user" if n % 2 == 0 else "assistant", "text": f"line {n}"} for n in range(600)]
        lines, states = chat.written(key, said)
        want = [chat.ROLES[a // 2] for a in chat.viterbi(whole, chat.observe(lines)) if chat.STATES[a][1]]
        own = sorted((r for r in chat.recovered(pieces, whole).collect() if r.conv_id == key), key=lambda r: r.piece)
        assert ",".join(r.roles for r in own).split(",") == want
    assert max(r.n_turns for r in got) == chat.PIECE and len([r for r in got if r.conv_id == 73]) == 3
    assert sum(r.n_right for r in got) / sum(r.n_lines for r in got) > 0.9
    assert chat.recovered(chat.pieces(df.limit(0)), chat.fit(pieces)).count() == 0
    texts = spark.createDataFrame([("User: hi\n\nAssistant: yes",), (None,), ("",)], "transcript string")
    out = chat.parse(texts, chat.fit(pieces)).collect()
    assert [[(t.role, t.text) for t in r.turns] for r in out] == [[("user", "hi"), ("assistant", "yes")], [], []]
    assert out[0].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n"
