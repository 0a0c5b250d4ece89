"""Set-similarity join, containment search and fuzzy passages against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import fixtures
from tidewatch.llm import chaining, decontaminate, partenum
from tidewatch.llm.graph import components
from tidewatch.llm.shingles import hashes_of


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    out = []
    for w in words:
        u = rng.random()
        if u < share / 3:
            continue
        out.append(f"new{rng.randrange(10**6)}" if u < 2 * share / 3 else w)
        if 2 * share / 3 <= u < share:
            out.append(f"more{rng.randrange(10**6)}")
    return out


def shingles(text: str | None, size: int) -> set[tuple]:
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def classes(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, int]:
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def near_rows(seed: int, n: int = 120) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i < 10 or rng.random() < 0.5:
            words = fixtures.prose(rng, rng.choice([3, 6, 12, 40, 150, 400])).split()
        else:
            words = edited(rng, rng.choice(out)[1].split(), rng.choice([0, 0.01, 0.02, 0.04, 0.08]))
        out.append((i, " ".join(words)))
    rng.shuffle(out)
    return [(1000 - k, t) for k, (_, t) in enumerate(out)]


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3), (1, 100, 4)])
def test_near_classes_lose_no_link(spark, size, percent, seed):
    rows = near_rows(seed)
    got = partenum.near_classes(fixtures.documents(spark, rows), size=size, percent=percent, buckets=3).collect()
    want = classes(rows, size, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, size)) for i, t in rows}
    assert len(set(want.values())) < len(rows)
    sets = [(i, shingles(t, size)) for i, t in rows]
    assert {r.doc_id: r.n_links for r in got} == {i: sum(i != j and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in sets) for i, a in sets}


def test_near_classes_awkward(spark):
    df = fixtures.awkward(spark)
    got = partenum.near_classes(df).collect()
    assert len(got) == df.count()
    want = classes([(r.doc_id, r.text) for r in df.collect()], 5, 80)
    rows = {}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            rows.setdefault(r.doc_id, set()).add(r.component_id)
    for i, c in rows.items():
        assert len(c) == 1
        if i != 4:  # repeated key: a node with the links of each of its rows
            assert c == {want[i]}
    assert partenum.near_classes(fixtures.empty(spark)).count() == 0


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 3)
    rows = near_rows(6, 90)
    got = partenum.near_classes(fixtures.documents(spark, rows), size=4, percent=85, buckets=2).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(rows, 4, 85)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.data())
def test_similar_sets_share_a_signature(base, data):
    percent = data.draw(st.sampled_from([60, 80, 85, 95]))
    drop = data.draw(st.sets(st.sampled_from(sorted(base)), max_size=6))
    other = (base - drop) | data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=6))
    if other and 100 * len(base & other) >= percent * len(base | other):
        a, b = (np.array(sorted(s), np.uint64) for s in (base, other))
        sig, owner, ring = partenum.signatures([a, b], partenum.Bands(percent))
        x, y = (dict(zip(sig[owner == i].tolist(), ring[owner == i].tolist())) for i in (0, 1))
        assert any(partenum.together(np.uint64(x[s]), np.uint64(y[s])) for s in x.keys() & y.keys())
        assert len(partenum.ties(sig, ring, owner)) == 1


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 40)
    rng = random.Random(8)
    seed = fixtures.prose(rng, 90).split()
    rows = [(i, " ".join(edited(rng, seed, rng.choice([0, 0.01, 0.02, 0.03])))) for i in range(300)] + [(900 + i, fixtures.prose(rng, 40)) for i in range(20)]
    got = partenum.near_classes(fixtures.documents(spark, rows), size=4, percent=85).collect()
    sets = {i: shingles(t, 4) for i, t in rows}
    near = {i: sum(i != j and 100 * len(a & b) >= 85 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == classes(rows, 4, 85)
    assert {r.doc_id: r.n_links for r in got} == near and max(near.values()) > 100


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (2000, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            x, y = sorted((find(u), find(v)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- containment


def test_contained_items(spark):
    rng = random.Random(9)
    items = [(i, fixtures.prose(rng, rng.choice([5, 8, 14, 30, 60]))) for i in range(30)] + [(90, "too short item"), (91, None), (None, "a b c d e f"), (92, "")]
    rows = []
    for i in range(80):
        words = fixtures.prose(rng, rng.randrange(1, 500)).split()
        if i % 2:
            inside = edited(rng, items[i % 30][1].split(), rng.choice([0, 0, 0.03, 0.1]))
            at = rng.randrange(len(words))
            words[at:at] = inside
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (None, items[0][1]), (202, items[3][1]), (202, items[3][1])]
    got = decontaminate.contained(fixtures.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, t in rows:
        own = shingles(t, 5)
        for k, x in items:
            item = shingles(x, 5) if x and len(x.split()) >= 5 else set()
            if i is not None and k is not None and item and 100 * len(own & item) >= 80 * len(item):
                want.add((i, k, len(item), len(own & item)))
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want and len(want) > 20 and len(got) == len(want)


def test_contained_short_items(spark):
    items = [(1, "Alpha beta\tgamma"), (2, "omega"), (3, "beta gamma delta epsilon"), (4, ""), (5, None), (6, "a b c d e"), (6, "alpha beta")]
    rows = [(10, "x alpha BETA gamma y"), (11, "alpha gamma beta"), (12, "omega"), (13, "one beta gamma delta epsilon"), (14, None), (15, "z a b c d e")]
    got = decontaminate.contained(fixtures.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(10, 1, 1, 1, 1.0), (10, 6, 1, 1, 1.0), (12, 2, 1, 1, 1.0), (13, 3, 1, 1, 1.0), (15, 6, 1, 1, 1.0)]


def test_contained_empty_and_by_shuffle(spark, monkeypatch):
    docs, items = fixtures.awkward(spark), spark.createDataFrame([(1, fixtures.texts()[7]), (2, fixtures.texts()[9])], "item_id long, text string")
    some = sorted(map(tuple, decontaminate.contained(docs, items).collect()))
    assert {r[0] for r in some} >= {7, 9}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, decontaminate.contained(docs, items).collect())) == some
    assert decontaminate.contained(fixtures.empty(spark), items).count() == 0
    assert decontaminate.contained(docs, items.limit(0)).count() == 0


# ---- passages


def test_passages(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, fuzzy = words(60), words(120)
    rows = []
    for i in range(60):
        own = words(rng.randrange(60, 300))
        at = rng.randrange(len(own))
        if i % 3 == 0:
            own[at:at] = passage
        elif i % 3 == 1:
            own[at:at] = edited(rng, fuzzy, 0.06)
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (None, " ".join(passage)), (102, " ".join(passage[:40]))]
    df = fixtures.documents(spark, rows)
    found = chaining.repeated_passages(df)
    got = found.collect()
    covered = {}
    for r in got:
        assert r.other_id < r.doc_id and r.n_words >= 50 and r.identity >= 0.8
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert {i for i in covered if i % 3 == 2} == set() and 102 not in covered
    assert {i for i in range(3, 60, 3)} <= set(covered)
    assert len({i for i in covered if i % 3 == 1}) >= 18
    texts = dict(rows)
    for i in range(3, 60, 3):
        w = texts[i].split()
        at = next(k for k in range(len(w)) if w[k : k + 60] == passage)
        assert set(range(at, at + 60)) <= covered[i]
    cut = {r.doc_id: r.text for r in chaining.without_repeats(df, found).collect()}
    assert cut[0] == texts[0] and cut[100] is None and cut[101] == ""
    assert all(" ".join(passage) not in cut[i] for i in range(3, 60, 3))
    assert all(cut[i] == texts[i] for i in range(2, 60, 3))


def test_passages_awkward(spark):
    df = fixtures.awkward(spark)
    found = chaining.repeated_passages(df)
    assert {r.doc_id for r in found.collect()} <= set(range(len(fixtures.texts())))
    cut = chaining.without_repeats(df, found)
    assert cut.columns == df.columns
    assert chaining.repeated_passages(fixtures.empty(spark)).count() == 0
    copies = fixtures.documents(spark, [(1, fixtures.prose(random.Random(1), 80)), (2, fixtures.prose(random.Random(1), 80))])
    assert [r.doc_id for r in chaining.without_repeats(copies, chaining.repeated_passages(copies)).collect()] == [1]


@pytest.mark.parametrize("hot", [False, True])
def test_passages_do_not_depend_on_partitions(spark, monkeypatch, hot):
    rng = random.Random(21)
    line = [fixtures.prose(rng, 70) for _ in range(3)]
    rows = [(i, " ".join([fixtures.prose(rng, rng.randrange(20, 150)), line[i % 3], fixtures.prose(rng, 30)])) for i in range(60)]
    if hot:
        monkeypatch.setattr(chaining, "SAMPLE", 1)
        monkeypatch.setattr(chaining, "SALT", 6)
    df = fixtures.documents(spark, rows)
    assert bool(len(chaining._hot(df.select("doc_id", "text"), 50)[0])) == hot
    got = [sorted(map(tuple, chaining.repeated_passages(df.repartition(n)).collect())) for n in (1, 4, 8)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == set(range(3, 60))


def test_passages_recall_against_brute_force(spark):
    """Every run of 50 equal words with an earlier document lies in a row, wherever its seeds are not frequent elsewhere."""
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    kept = [words(rng.randrange(50, 90)) for _ in range(12)]
    docs = []
    for _ in range(80):
        own = words(rng.randrange(20, 120))
        for p in rng.sample(kept, rng.randrange(3)):
            own += p + words(rng.randrange(0, 30))
        docs.append(own)
    got: dict[int, set] = {}
    for r in chaining.repeated_passages(fixtures.documents(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen: set = set()
    want = caught = 0
    for i, d in enumerate(docs):
        runs = [(k, tuple(d[k : k + 50])) for k in range(len(d) - 49)]
        for k, run in runs:
            if run in seen:
                want += 1
                caught += set(range(k, k + 50)) <= got.get(i, set())
        seen |= {run for _, run in runs}
    assert want > 300 and caught >= 0.95 * want


def test_cuts_keep_to_their_own_text(spark):
    rng = random.Random(41)
    passage, fresh = fixtures.prose(rng, 80), fixtures.prose(rng, 200)
    rows = [(1, passage), (5, fresh), (5, "start " + passage + " end"), (5, "start " + passage + " end")]
    df = fixtures.documents(spark, rows)
    cut = chaining.without_repeats(df, chaining.repeated_passages(df)).collect()
    assert sorted((r.doc_id, r.text) for r in cut) == sorted([(1, passage), (5, fresh), (5, "start  end"), (5, "start  end")])


@pytest.mark.parametrize("hot", [False, True])
def test_passages_of_frequent_parts(spark, monkeypatch, hot):
    """Every run of 50 equal words with an earlier document is found, though each part of it is frequent elsewhere."""
    if hot:
        monkeypatch.setattr(chaining, "SAMPLE", 1)
        monkeypatch.setattr(chaining, "SALT", 6)
    rng = random.Random(41)
    words = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    lines = [words(rng.randrange(18, 46)) for _ in range(16)]
    docs = [sum((words(rng.randrange(5, 40)) + rng.choice(lines) for _ in range(4)), words(30)) for _ in range(150)]
    for _ in range(8):
        p, q = rng.sample(lines, 2)
        joint = rng.choice([[], words(1), words(4)])
        whole = p + joint + q if len(p + q) > 55 else p + joint + q + words(30)
        for _ in range(2):  # twice, with documents between that hold the parts
            docs.insert(rng.randrange(20, len(docs)), words(rng.randrange(5, 60)) + whole + words(40))
    core = words(44)  # one that many documents hold, and six words about it that two share
    docs += [words(20) + core + words(20) for _ in range(12)]
    six = words(6)
    for at in (150, 156, 160, 168):
        docs.insert(at, words(30) + (six + core if at in (150, 168) else core + six) + words(30))
    got: dict[int, set] = {}
    found = chaining.repeated_passages(fixtures.documents(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])).collect()
    for r in found:
        assert r.other_id < r.doc_id and r.n_words >= 50
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen: set = set()
    want = missed = 0
    for i, d in enumerate(docs):
        runs = [(k, tuple(d[k : k + 50])) for k in range(len(d) - 49)]
        for k, run in runs:
            if run in seen:
                want += 1
                missed += not set(range(k, k + 50)) <= got.get(i, set())
        seen.update(run for _, run in runs)
    assert want > 60 and missed == 0


def test_edited_passage_of_two_frequent_lines(spark):
    """Two lines of 30 words that unrelated documents hold; together, with edits, they stand in two documents only."""
    rng = random.Random(43)
    words = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    one, two = words(30), words(30)
    docs = [words(40) + (one if i % 2 else two) + words(40) for i in range(20)]
    docs[6], docs[14] = (words(40) + one + words(2) + two + words(40) for _ in range(2))
    found = chaining.repeated_passages(fixtures.documents(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])).collect()
    assert [(r.doc_id, r.other_id) for r in found] == [(14, 6)]
    assert found[0].start <= 41 and found[0].end >= 101


def test_equal_words_stand_though_what_follows_is_unlike():
    """An equal stretch of 50 words is kept when the text goes on alike, but too little, on both sides."""
    rng = np.random.default_rng(5)
    x = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    y = x.copy()
    other = np.r_[174:0:-3, 225:400:3]
    y[other] = rng.integers(1, 1 << 62, len(other)).astype(np.uint64)
    runs = np.array([[180, 212, 180, 212, 9]])
    [found] = chaining.align(x, y, runs)
    assert found[0] <= 175 and found[1] >= 225 and found[4] >= 0.8 * (found[1] - found[0])


def test_chain_is_the_best_one():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 9))
        b = np.sort(rng.choice(200, n, replace=False))
        a = rng.choice(200, n, replace=False)
        runs = chaining.runs_of(b, a)
        best = 0.0
        m = len(runs)
        for mask in range(1, 1 << m):
            pick = [runs[i] for i in range(m) if mask >> i & 1]
            value, fine = float(pick[0][1] - pick[0][0] + chaining.K), True
            for p, q in zip(pick, pick[1:]):
                db, da = q[0] - p[1], q[2] - p[3]
                if db <= 0 or da <= 0 or max(db, da) > chaining.MAX_GAP + chaining.K:
                    fine = False
                    break
                value += q[1] - q[0] + chaining.K - chaining.GAP_COST * (db + da - 2 * chaining.K)
            best = max(best, value) if fine else best
        chains = chaining.chains_of(runs)
        value = max([_value(c) for c in chains], default=0.0)
        assert value == pytest.approx(best if best > chaining.K else 0.0)


def _value(chain) -> float:
    own = float(sum(r[1] - r[0] + chaining.K for r in chain))
    return own - sum(chaining.GAP_COST * (q[0] - p[1] + q[2] - p[3] - 2 * chaining.K) for p, q in zip(chain, chain[1:]))


def test_best_chain_equals_brute_force():
    rng = np.random.default_rng(3)
    linked = 0
    for _ in range(100):
        # a long match, and far behind it several short ones that are near each other
        n = int(rng.integers(3, 9))
        starts = 118 + np.cumsum(rng.integers(16, 40, n))
        b = np.concatenate([np.arange(0, 72, 6), (starts[:, None] + np.array([0, 5, 10])).ravel()])
        a = b + np.concatenate([np.zeros(12, int), np.repeat(rng.choice([0, 0, 4, -3, 30], n), 3)])
        runs = chaining.runs_of(b, a)
        best = 0.0
        for mask in range(1, 1 << len(runs)):
            pick = [runs[i] for i in range(len(runs)) if mask >> i & 1]
            steps = [(q[0] - p[1], q[2] - p[3]) for p, q in zip(pick, pick[1:])]
            if all(0 < min(s) and max(s) <= chaining.MAX_GAP + chaining.K for s in steps):
                best = max(best, _value(pick))
        chains = chaining.chains_of(runs)
        assert bool(chains) == (best > chaining.K)
        if chains:
            linked += len(chains[0]) > 1
            assert _value(chains[0]) == pytest.approx(best)
    assert linked > 10


def test_far_match_does_not_block_a_near_one():
    rng = random.Random(12)
    new = lambda n: [f"u{rng.randrange(10**9)}".encode() for _ in range(n)]
    head, left, right = new(100), new(30), new(30)
    x, y = head + new(60) + left + new(8) + right + new(20), head + new(60) + left + new(3) + right + new(20)
    hx, hy = hashes_of(x), hashes_of(y)
    ax, kx = chaining.minimizers(hx)
    ay, ky = chaining.minimizers(hy)
    where = dict(zip(ky.tolist(), ay.tolist()))
    b, a = map(np.array, zip(*((i, where[h]) for i, h in zip(ax.tolist(), kx.tolist()) if h in where)))
    found = [p for runs in chaining.chains_of(chaining.runs_of(b, a)) for p in chaining.align(hx, hy, runs)]
    assert sorted(found) == [(0, 100, 0, 100, 100), (160, 228, 160, 223, 60)]


def test_align_bridges_edits():
    rng = random.Random(2)
    x = [f"w{rng.randrange(3000)}".encode() for _ in range(100)]
    y = x[:30] + [b"zz"] + x[31:60] + x[62:]
    hx, hy = hashes_of(x), hashes_of(y)
    ax, kx = chaining.minimizers(hx)
    ay, ky = chaining.minimizers(hy)
    where = dict(zip(ky.tolist(), ay.tolist()))
    pairs = [(i, where[h]) for i, h in zip(ax.tolist(), kx.tolist()) if h in where]
    runs = chaining.chains_of(chaining.runs_of(*map(np.array, zip(*pairs))))[0]
    assert chaining.align(hx, hy, runs) == [(0, 100, 0, 98, 97)]
