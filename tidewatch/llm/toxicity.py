"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Each word has two inputs: an embedding of its hashed form (punctuation at its ends removed) and the
maximum over the embeddings of its hashed character 3- to 5-grams, word borders included. A window
of 32 words runs through a GRU in both directions; attention over the steps pools the states, and a
logistic unit gives the window's score. Windows overlap by half and cover every word; a document's
score is that of its highest window.

Training takes place in one task, on a bounded sample: `positives` and `negatives` labelled
documents, those of the smallest hash of the key. It is multiple-instance learning: of a document
labelled 1 the highest window counts as such, of one labelled 0 every window counts as 0; highest
windows are looked up anew several times. Embeddings begin with the smoothed log odds of the
document frequencies in the sample, the rest with small random numbers of a fixed seed.

Null texts count as empty; a text without words is scored as one window of padding. Rows with null
keys are scored and belong to no fold that is learnt from. If the sample lacks a label, all scores
are the smoothed share of label 1 in it. Rows that repeat a labelled key are each in the sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import light, materialize, text_bytes, words_of

WINDOW, STRIDE = 32, 16
PRIOR, DECAY = 5.0, 1e-3
HIDDEN, EMBED, ATTEND = 8, 8, 8
WORD_BITS, GRAM_BITS = 17, 16
WORD_SLOTS, GRAM_SLOTS = 1 << WORD_BITS, 1 << GRAM_BITS
LEAST_DOCS = 3
POSITIVES, NEGATIVES = 1200, 1800
BLOCK = 1024
WORD_CACHE = 150_000
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# ---- inputs


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slot of each word; gram slots of all words, and where each word's grams begin."""
    bare = [w.strip(EDGES) for w in words]
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in bare) + b"\0" * 8, np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in bare], np.int64)
    start = np.concatenate(([0], np.cumsum(sizes)))
    own = np.repeat(np.arange(len(bare)), sizes)
    left = start[own + 1] - np.arange(start[-1])  # characters from here to the word's end
    n = int(start[-1])
    slots, owner = [], []
    acc = np.zeros(n, np.uint64)
    for j in range(5):
        acc = acc * np.uint64(257) + flat[j : j + n] + np.uint64(1)
        if j >= 2:
            at = left >= j + 1 if j > 2 else (left >= 3) | (np.arange(n) == start[own])
            slots.append((_mix(acc + np.uint64(j)) >> np.uint64(64 - GRAM_BITS))[at])
            owner.append(own[at])
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(bare)))
    whole = np.zeros(len(bare), np.uint64)
    np.add.at(whole, own, _mix(flat[:n] + (np.arange(n) - start[own]).astype(np.uint64) * np.uint64(1009)))
    return (_mix(whole) >> np.uint64(64 - WORD_BITS)).astype(np.int64), slots[order].astype(np.int64), begin


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def windows_of(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    return np.minimum(starts, n - WINDOW)


# ---- the network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] / 8)).astype(np.float32)

    p = {"word": rng.standard_normal((WORD_SLOTS, EMBED)).astype(np.float32) * 0.05, "gram": rng.standard_normal((GRAM_SLOTS, EMBED)).astype(np.float32) * 0.05}
    for d in "fb":
        p |= {f"x{d}": draw(2 * EMBED, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"wa": draw(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND, 1)[:, 0], "wo": draw(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(1, np.float32)}


def embed(p: dict, word: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Inputs of words, one row each."""
    return np.concatenate([p["word"][word], np.maximum.reduceat(p["gram"][grams], begin, axis=0)], axis=1)


def project(p: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"]], axis=1)


def _gru(px: np.ndarray, rows: np.ndarray, u: np.ndarray, at: int, order: range, keep: list | None = None) -> np.ndarray:
    """States (step, window, hidden); px has the projected inputs of words, rows (window, step) picks them.

    Padding leaves the state as it is.
    """
    h = np.zeros((len(rows), HIDDEN), px.dtype)
    out = np.empty((rows.shape[1], len(rows), HIDDEN), px.dtype)
    px = px[:, at : at + 3 * HIDDEN]
    live = rows.T > 0
    full = live.all(axis=1)
    for t in order:
        x = px[rows[:, t]]
        g = h @ u
        zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        on = None if full[t] else live[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, n, g[:, 2 * HIDDEN :], on))
        new = n + z * (h - n)
        h = new if on is None else np.where(on, new, h)
        out[t] = h
    return out


def forward(p: dict, px: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; rows is (window, step), row 0 of px stands for padding."""
    steps = rows.shape[1]
    kf, kb = ([], []) if keep is not None else (None, None)
    h = np.concatenate([_gru(px, rows, p["uf"], 0, range(steps), kf), _gru(px, rows, p["ub"], 3 * HIDDEN, range(steps - 1, -1, -1), kb)], axis=2)
    a = np.tanh(h @ p["wa"] + p["ba"])
    e = a @ p["va"] - 1e4 * (rows.T == 0)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tb,tbk->bk", w, h)
    if keep is not None:
        keep |= {"f": kf, "b": kb, "h": h, "a": a, "w": w, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"][0]


def backward(p: dict, x: np.ndarray, px: np.ndarray, rows: np.ndarray, k: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of all but the embeddings, and that of the words' inputs x."""
    g = {"bo": dlogit.sum(keepdims=True), "wo": k["pooled"].T @ dlogit}
    dpool = dlogit[:, None] * p["wo"]
    h, w, a = k["h"], k["w"], k["a"]
    dw = np.einsum("bk,tbk->tb", dpool, h)
    de = w * (dw - (w * dw).sum(axis=0))
    g["va"] = np.einsum("tb,tbk->k", de, a)
    da = de[:, :, None] * p["va"] * (1 - a * a)
    g["wa"] = np.einsum("tbi,tbj->ij", h, da)
    g["ba"] = da.sum(axis=(0, 1))
    dh_all = w[:, :, None] * dpool + da @ p["wa"].T
    dpx = np.zeros_like(px)
    for d, at, lo in (("f", 0, 0), ("b", 3 * HIDDEN, HIDDEN)):
        u = p[f"u{d}"]
        du = np.zeros_like(u)
        dh = np.zeros((len(rows), HIDDEN), px.dtype)
        for t, before, z, r, n, gn, on in reversed(k[d]):
            dh = dh + dh_all[t][:, lo : lo + HIDDEN]
            own = dh if on is None else dh * on
            dn = own * (1 - z) * (1 - n * n)
            dz = own * (before - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            du += before.T @ dg
            np.add.at(dpx[:, at : at + 3 * HIDDEN], rows[:, t], dx)
            back = own * z + dg @ u.T
            dh = back if on is None else np.where(on, back, dh)
        g[f"u{d}"] = du
        part = dpx[:, at : at + 3 * HIDDEN]
        g[f"x{d}"] = x.T @ part
        g[f"c{d}"] = part.sum(axis=0)
    dx = dpx[:, : 3 * HIDDEN] @ p["xf"].T + dpx[:, 3 * HIDDEN :] @ p["xb"].T
    return g, dx


# ---- training


class Lexicon:
    """The distinct words of some texts with their slots; word 0 is padding."""

    def __init__(self, docs: list[list[bytes]]):
        self.ids: dict[bytes, int] = {b"": 0}
        self.docs = [np.array([self.ids.setdefault(w, len(self.ids)) for w in d] or [0], np.int64) for d in docs]
        self.word, self.grams, begin = grams_of(list(self.ids))
        self.begin = np.concatenate((begin, [len(self.grams)]))

    def gram_rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.begin[words + 1] - self.begin[words]
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.arange(sizes.sum()) - np.repeat(begin - self.begin[words], sizes)
        return self.grams[at], begin


def window_rows(doc: np.ndarray) -> np.ndarray:
    if len(doc) < WINDOW:
        return np.pad(doc, (0, WINDOW - len(doc)))[None]
    return doc[windows_of(len(doc))[:, None] + np.arange(WINDOW)]


def train(texts: list[bytes], labels: list[int], seed: int = 7, batch: int = 192) -> dict:
    """Parameters of the network, or {"prior": share} if there is one label only.

    Small samples get fewer steps and slower embeddings, lest they be learnt by heart.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return {"prior": float((y.sum() + 0.5) / (len(y) + 1))}
    rng = np.random.default_rng(seed)
    steps = 150 + min(len(texts), POSITIVES + NEGATIVES) // 9
    embed_rate = min(1.0, int(y.sum()) / POSITIVES)
    lex = Lexicon([words_of(t) for t in texts])
    p = fresh(rng)
    # Log odds of document frequencies as the embeddings' first column. What fewer than LEAST_DOCS
    # texts have stays at zero for good: it could only be learnt by heart.
    present = [np.unique(d) for d in lex.docs]
    known = {}
    for name, slots in (("word", None), ("gram", lex)):
        count = np.zeros((2, WORD_SLOTS if slots is None else GRAM_SLOTS))
        for words, label in zip(present, y):
            s = lex.word[words] if slots is None else lex.gram_rows(words)[0]
            count[label][np.unique(s)] += 1
        n = np.bincount(y, minlength=2)
        prior = n / n.sum() * PRIOR
        odds = np.log((count[1] + prior[1]) / (count[0] + prior[0])) - np.log(n[1] / n[0])
        known[name] = count.sum(axis=0) >= LEAST_DOCS
        p[name][:, 0] = np.clip(odds, -3, 4) / 2
        p[name][~known[name]] = 0
    rows = [window_rows(d) for d in lex.docs]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    every = np.arange(len(lex.ids))

    def best(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((-score, owner))
        return order[first[:-1]]

    odds = p["word"][lex.word, 0] + np.maximum.reduceat(p["gram"][lex.grams, 0], lex.begin[:-1])
    top = best(np.where(flat > 0, odds[flat], -9).max(axis=1))
    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    neg_windows = np.flatnonzero(y[owner] == 0)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    third = batch // 3
    for step in range(1, steps + 1):
        if step % 100 == 0:
            grams, begin = lex.gram_rows(every)
            top = best(_scores(p, project(p, embed(p, lex.word, grams, begin)), flat))
        picked = np.concatenate([top[rng.choice(positive, third)], top[rng.choice(negative, third)], rng.choice(neg_windows, third)])
        target = np.concatenate([np.ones(third, np.float32), np.zeros(2 * third, np.float32)])
        words, inverse = np.unique(np.concatenate(([0], flat[picked].ravel())), return_inverse=True)
        local = inverse[1:].reshape(-1, WINDOW)
        grams, begin = lex.gram_rows(words)
        x = embed(p, lex.word[words], grams, begin)
        px = project(p, x)
        k: dict = {}
        logit = forward(p, px, local, k)
        dlogit = ((sigmoid(logit) - target) * np.where(target > 0, 1.0, 0.5) / third).astype(np.float32)
        g, dx = backward(p, x, px, local, k, dlogit)
        size = np.diff(np.concatenate((begin, [len(grams)])))
        hit = p["gram"][grams] == np.repeat(x[:, EMBED:], size, axis=0)
        g["word"] = _summed(lex.word[words], dx[:, :EMBED], known["word"])
        g["gram"] = _summed(grams, np.where(hit, np.repeat(dx[:, EMBED:], size, axis=0), 0), known["gram"])
        rate = 0.01 * min(1, 2 * (1 - (step - 1) / steps))
        for name, q in p.items():
            rows_of, grad = g[name] if name in known else (slice(None), g[name])
            if name not in known:
                grad = grad + DECAY * q
            m[name][rows_of] += 0.1 * (grad - m[name][rows_of])
            v[name][rows_of] += 0.01 * (grad * grad - v[name][rows_of])
            push = m[name][rows_of] / (1 - 0.9**step) / (np.sqrt(v[name][rows_of] / (1 - 0.99**step)) + 1e-6)
            q[rows_of] -= ((embed_rate if name in known else 1.0) * rate * push).astype(np.float32)
    return p


def _summed(slots: np.ndarray, grad: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The known slots with the sum of the gradients of each."""
    rows, at = np.unique(slots, return_inverse=True)
    out = np.zeros((len(rows), grad.shape[1]), np.float32)
    np.add.at(out, at, grad)
    return rows[known[rows]], out[known[rows]]


def _scores(p: dict, px: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.float32)
    for i in range(0, len(rows), BLOCK):
        out[i : i + BLOCK] = forward(p, px, rows[i : i + BLOCK])
    return out


# ---- scoring


class Scorer:
    """Scores batches of texts; remembers the projected inputs of words."""

    def __init__(self, p: dict):
        self.p = p
        self.ids: dict[bytes, int] = {}

    def _reset(self) -> None:
        self.ids = {b"": 0}
        self.px = project(self.p, embed(self.p, *grams_of([b""])))
        self.used = 1

    def _rows(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        if not self.ids or self.used > WORD_CACHE:
            self._reset()
        ids = self.ids
        if new := list(set().union(*docs) - ids.keys()):
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                px = project(self.p, embed(self.p, *grams_of(part)))
                if self.used + len(part) > len(self.px):
                    self.px = np.concatenate([self.px[: self.used], np.empty((max(len(self.px), 50_000, len(part)), px.shape[1]), np.float32)])
                self.px[self.used : self.used + len(part)] = px
                ids.update(zip(part, range(self.used, self.used + len(part))))
                self.used += len(part)
        return [np.fromiter(map(ids.__getitem__, d), np.int32, len(d)) if d else np.zeros(1, np.int32) for d in docs]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if "prior" in self.p:
            return np.full(len(texts), self.p["prior"])
        out, i = np.empty(len(texts)), 0
        while i < len(texts):
            j, n, docs = i, 0, []
            while j < len(texts) and (j == i or n < 150_000):
                docs.append(words_of(texts[j]))
                n += len(docs[-1])
                j += 1
            rows = [window_rows(d) for d in self._rows(docs)]
            logits = _scores(self.p, self.px, np.concatenate(rows))
            first = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
            out[i:j] = sigmoid(np.maximum.reduceat(logits, first).astype(np.float64))
            i = j
        return out


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text has this remainder."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None,
        positives: int = POSITIVES, negatives: int = NEGATIVES) -> dict:
    """Trains on a bounded sample of the labelled documents for which `learn` (on the key) holds."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null")
    if learn is not None:
        known = known.filter(learn)
    order = F.xxhash64("doc_id"), "doc_id", "label"
    picked = [known.filter(F.col("label") == y).distinct().orderBy(*order).limit(n) for y, n in ((1, positives), (0, negatives))]
    sample = materialize(picked[0].union(picked[1]), "labelled-keys")  # at most positives + negatives rows
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = materialize(rows, "labelled-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, t, y) for b in batches for d, t, y in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), b.column("label").to_pylist())]
        got.sort()
        p = train([t for _, t, _ in got], [y for _, _, y in got])
        p = {k: v.astype(np.float16) if k in ("word", "gram") else v for k, v in p.items()}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(p)], pa.binary())], ["model"])

    found = rows.coalesce(1).mapInArrow(light(run), "model binary").first()
    p = pickle.loads(found["model"]) if found else {"prior": 0.5}
    return {k: v.astype(np.float32) if isinstance(v, np.ndarray) else v for k, v in p.items()}


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the score of every text; a column of that name that is there already is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            got = pa.array(scorer.score(text_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), got], [*keep, name])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(light(run), schema)
