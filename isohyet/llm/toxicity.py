"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Every word of a text is a step. Its word input is how toxic the word's bucket is, its character inputs how toxic the
buckets of its 4- to 6-grams are (edges marked), each as a smoothed log odds over training documents with the document's
own label left out; so an inflected or unseen form of a word is met by its characters. A GRU of HIDDEN units reads each
window of WINDOW words in both directions, attention pools its states, and a linear layer gives the window's logit.
All windows, overlapping by half, are scored; the largest logit, calibrated, is the document's score. The network is
trained in numpy by back-propagation; of a document its highest window is taken, and of clean ones a random one too.

Fitted in one task on at most SAMPLE[1] toxic and SAMPLE[0] clean labelled documents, those with the smallest hash of
their id, none held out (crc32 of the id modulo 5 is 0). Only the text is an input. Scoring covers every document and
every word; words of more than 32 bytes are read in pieces of 32. The model, about 4 MB, is broadcast.

Defined results: null and empty texts get the score of an empty window. Null ids are not held out. Repeated rows are
scored alike. Without labels of both kinds every score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .runtime import trim

#: Most clean and toxic documents the model is fitted on.
SAMPLE = (2000, 1000)
WINDOW, STRIDE, HIDDEN, ATTENTION = 64, 32, 8, 8
#: Updates of the network, in whole epochs, 3 at least.
BUCKETS, PRIOR, UPDATES = 1 << 20, 2.0, 350
_STRIP = b".,!?;:\"'()[]*&%#$|"
_PIECE, _BATCH, _TYPES, _TEXT = 32, 1024, 40_000, 3_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    if max(map(len, words), default=0) > _PIECE:
        words = [w[i : i + _PIECE] for w in words for i in range(0, len(w), _PIECE)]
    return words


def buckets_of(types: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each type's word bucket; the buckets of all its n-grams, and where each type's begin. Every type has some."""
    marked = [b"^" + (w.strip(_STRIP) or w) + b"$" + b"$$$" for w in types]
    blob = np.frombuffer(b"".join(marked) + b"\0" * 8, np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in marked])
    starts = np.cumsum(sizes) - sizes
    n, mult = len(blob) - 8, np.uint64(0x100000001B3)
    rolling, grams = np.zeros(n, np.uint64), []
    for k in range(6):
        rolling = (rolling ^ blob[k : n + k]) * mult
        rolling ^= rolling >> np.uint64(29)
        if k >= 3:
            grams.append(((rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32))
    # An n-gram starts at a byte of its word; those that would pass the end read the padding and so the last one's tail.
    last = np.repeat(starts + sizes - 4, sizes)
    at = np.arange(n)
    ok = at <= np.maximum(last, np.repeat(starts, sizes))
    first = np.cumsum(ok) - ok
    grams = np.stack([g[ok] for g in grams], axis=1)
    begin = first[starts]
    word = np.array([hash_bytes(w) for w in marked], np.int64)
    return word, grams, begin


def hash_bytes(w: bytes) -> int:
    h = 0xCBF29CE484222325
    h ^= int.from_bytes(w[:8], "little") * 0x9E3779B97F4A7C15
    for i in range(8, len(w), 8):
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 ^ int.from_bytes(w[i : i + 8], "little")) * 0x94D049BB133111EB & (1 << 64) - 1
    h = (h ^ (h >> 29)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return h >> 44


def log_odds(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    pos, neg = np.maximum(pos, 0), np.maximum(neg, 0)
    return (np.log((pos + PRIOR * share) / (neg + PRIOR * (1 - share))) - np.log(share / (1 - share))).astype(np.float16)


def inputs_of(types: list[bytes], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The network's inputs for each type; the last row is the padding's."""
    out = np.zeros((len(types) + 1, 6), np.float32)
    for a in range(0, len(types), _TYPES):
        word, grams, begin = buckets_of(types[a : a + _TYPES])
        b = a + len(word)
        value = tables[1][grams].astype(np.float32)
        out[a:b, 0] = tables[0][word]
        out[a:b, 1:4] = np.maximum.reduceat(value, begin)
        out[a:b, 4] = np.add.reduceat(value.mean(axis=1), begin) / np.diff(np.r_[begin, len(value)])
        out[a:b, 5] = 1
    return out / np.array([3, 3, 3, 3, 1, 1], np.float32)


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    h, r = HIDDEN, lambda *s: (rng.standard_normal(s) * np.sqrt(1 / s[0])).astype(np.float32)
    p = {}
    for d in "fb":
        p |= {f"w{d}": r(6, 3 * h), f"u{d}": r(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
    return p | {"a": r(2 * h, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "v": r(ATTENTION), "o": r(2 * h), "ob": np.zeros(1, np.float32)}


def _gru(p: dict, d: str, projected: np.ndarray, steps: np.ndarray, keep: list | None) -> np.ndarray:
    """States [WINDOW, B, HIDDEN] of one direction; steps [WINDOW, B] are rows of projected. keep: gets what back-propagation needs."""
    h, n = HIDDEN, steps.shape[1]
    states, s = np.empty((WINDOW, n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
        x, g = projected[steps[t]], s @ p[f"u{d}"]
        rz = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
        r, z = rz[:, :h], rz[:, h:]
        m = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
        if keep is not None:
            keep.append((t, s, r, z, m, g[:, 2 * h :]))
        s = m + z * (s - m)
        states[t] = s
    return states


def forward(p: dict, inputs: np.ndarray, steps: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; real [WINDOW, B] marks the steps that are words (the first one always counts)."""
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    both = np.concatenate([_gru(p, d, inputs @ p[f"w{d}"] + p[f"c{d}"], steps, kept[d]) for d in "fb"], axis=2)
    e = np.tanh(both.reshape(-1, 2 * HIDDEN) @ p["a"] + p["ab"])
    score = (e @ p["v"]).reshape(real.shape)
    score[~real] = -1e9
    w = np.exp(score - score.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", w, both)
    if keep is not None:
        keep |= {"kept": kept, "both": both, "e": e, "w": w, "pooled": pooled}
    return pooled @ p["o"] + p["ob"][0]


def gradients(p: dict, inputs: np.ndarray, steps: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean cross entropy of windows with labels y, and the loss."""
    k: dict = {}
    logit = forward(p, inputs, steps, real, k)
    q, n, h = _sigmoid(logit), len(y), HIDDEN
    d = (q - y) / n
    g = {"o": k["pooled"].T @ d, "ob": np.array([d.sum()])}
    dp = d[:, None] * p["o"]
    dw = np.einsum("bh,tbh->tb", dp, k["both"])
    ds = k["w"] * (dw - (k["w"] * dw).sum(axis=0))
    dboth = k["w"][:, :, None] * dp
    de = ds.reshape(-1, 1) * p["v"] * (1 - k["e"] ** 2)
    g |= {"v": k["e"].T @ ds.ravel(), "a": k["both"].reshape(-1, 2 * h).T @ de, "ab": de.sum(0)}
    dboth = dboth + (de @ p["a"].T).reshape(dboth.shape)
    for at, name in ((0, "f"), (h, "b")):
        gw, gu, gc, back = np.zeros_like(p[f"w{name}"]), np.zeros_like(p[f"u{name}"]), np.zeros(3 * h, np.float32), np.zeros((n, h), np.float32)
        for t, s, r, z, m, gm in reversed(k["kept"][name]):
            dh = dboth[t][:, at : at + h] + back
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (s - m) * z * (1 - z)
            dr = dm * gm * r * (1 - r)
            dx = np.concatenate([dr, dz, dm], axis=1)
            dg = np.concatenate([dr, dz, dm * r], axis=1)
            gw += inputs[steps[t]].T @ dx
            gc += dx.sum(0)
            gu += s.T @ dg
            back = dh * z + dg @ p[f"u{name}"].T
        g |= {f"w{name}": gw, f"u{name}": gu, f"c{name}": gc}
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    return g, loss


def _steps(ids: np.ndarray, starts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """[WINDOW, B] rows of the inputs for windows that start at (document's offset, word) and what of it is real."""
    at = starts[:, 0] + np.arange(WINDOW)[:, None]
    real = at < starts[:, 1]
    steps = np.where(real, ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else pad, pad)
    real[0] = True
    return steps, real


def index_texts(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers of these, and the texts' bounds."""
    known: dict[bytes, int] = {}
    put = known.setdefault
    ids, bounds = [], [0]
    for t in texts:
        ids += [put(w, len(known)) for w in words_of(t)]
        bounds.append(len(ids))
    return list(known), np.array(ids, np.int64), np.array(bounds, np.int64)


def window_table(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end of its text) of every window, and its text."""
    per = [windows_of(b - a) + a for a, b in zip(bounds, bounds[1:], strict=False)]
    doc = np.repeat(np.arange(len(per)), [len(x) for x in per])
    return np.stack([np.concatenate(per), bounds[1:][doc]], axis=1), doc


def window_logits(p: dict, inputs: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.float32)
    for a in range(0, len(starts), _BATCH):
        steps, real = _steps(ids, starts[a : a + _BATCH], len(inputs) - 1)
        out[a : a + _BATCH] = forward(p, inputs, steps, real)
    return out


def fit(texts: list[str], toxic: list[int], seed: int = 3) -> dict:
    """The model for labelled texts."""
    y = np.array(toxic, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return {"constant": share}
    types, ids, bounds = index_texts(texts)
    if not types:
        return {"constant": share}
    chunks = [buckets_of(types[a : a + _TYPES]) for a in range(0, len(types), _TYPES)]
    sizes = np.cumsum([0, *(len(c[1]) for c in chunks)])
    word, grams = np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks])
    begin = np.concatenate([c[2] + k for c, k in zip(chunks, sizes, strict=False)])
    del chunks
    ends = np.r_[begin[1:], len(grams)]
    counts = np.zeros((2, 2, BUCKETS), np.float32)  # word or gram, label
    for i, label in enumerate(toxic):
        own = np.unique(ids[bounds[i] : bounds[i + 1]])
        counts[0, label, np.unique(word[own])] += 1
        flat = np.concatenate([grams[begin[k] : ends[k]].ravel() for k in own]) if len(own) else np.zeros(0, np.int64)
        counts[1, label, np.unique(flat)] += 1
    tables = lambda less: tuple(log_odds(c[1] - less * 1.0, c[0] - (1 - less) * 1.0, share) for c in counts) if less is not None else tuple(log_odds(c[1], c[0], share) for c in counts)
    del word, grams, begin, ends
    # A training document is read with its own label taken out of the counts: one table a label does that for all.
    pad = len(types)
    inputs = np.concatenate([inputs_of(types, tables(0)), inputs_of(types, tables(1))])
    starts, doc = window_table(bounds)
    shifted = ids + np.repeat(y.astype(np.int64), np.diff(bounds)) * (pad + 1)
    rng, p = np.random.default_rng(seed), new_network(seed)
    first, second, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    peak = np.maximum.reduceat(np.r_[inputs[shifted, :4].max(axis=1) if len(shifted) else np.zeros(0), -9.0], np.minimum(starts[:, 0], len(shifted)))
    logits = peak.astype(np.float32)
    epochs = max(3, round(UPDATES * 64 / (1.5 * len(y))))
    for _ in range(epochs):
        order = np.lexsort((logits, doc))
        top = order[np.r_[doc[order][1:] != doc[order][:-1], True]]
        any_ = rng.permutation(len(doc))
        chosen = np.r_[top, any_[y[doc[any_]] == 0][: len(top) // 2]]
        rng.shuffle(chosen)
        for a in range(0, len(chosen), 64):
            at = chosen[a : a + 64]
            steps, real = _steps(shifted, starts[at], pad)
            g, _ = gradients(p, inputs, steps, real, y[doc[at]])
            step += 1
            for k, v in g.items():
                v = v + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] = (p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        logits = window_logits(p, inputs, shifted, starts)
    best = np.maximum.reduceat(logits, np.searchsorted(doc, np.arange(len(y))))
    scale, shift = 1.0, 0.0  # logistic calibration of the documents' largest logits, by Newton's method
    for _ in range(50):
        q = np.clip(_sigmoid(scale * best + shift), 1e-6, 1 - 1e-6)
        w = q * (1 - q)
        grad = np.array([((q - y) * best).sum() + 0.1 * (scale - 1), (q - y).sum()])
        hess = np.array([[(w * best * best).sum() + 0.1, (w * best).sum()], [(w * best).sum(), w.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        scale, shift = max(0.05, scale - move[0]), shift - move[1]
    return {"network": p, "tables": tables(None), "scale": float(scale), "shift": float(shift)}


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """Scores of whole texts, from all their windows."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    types, ids, bounds = index_texts(texts)
    starts, doc = window_table(bounds)
    logits = window_logits(model["network"], inputs_of(types, model["tables"]), ids, starts)
    best = np.maximum.reduceat(logits.astype(np.float64), np.searchsorted(doc, np.arange(len(texts))))
    return _sigmoid(model["scale"] * best + model["shift"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Fit on the bounded sample of labelled documents that are not held out."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(F.col("doc_id")))
    few = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[y])
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(few(0).union(few(1))), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        return pa.table({"model": [pickle.dumps(fit(t["text"].to_pylist(), t["y"].to_pylist()))]})

    found = rows.groupBy(F.isnull("y").alias("one_group")).applyInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], [])


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score and predicted; other columns stay, but for any of these names."""
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    docs = docs.select(*rest)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b, found in _scored(shared.value, batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*rest, "score"])
        trim()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.mapInArrow(run, schema).withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= 0.5).cast("int")})


def accept(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b, found in _scored(shared.value, batches, at):
            yield b.filter(pa.array(found < 0.5))
        trim()

    return docs.mapInArrow(run, docs.schema)


def _scored(model: dict, batches, at: int):
    """Batches with the scores of their column, some batches of a bounded amount of text at a time: they share words."""
    held, texts, size = [], [], 0
    for b in batches:
        held.append(b)
        texts += [x or "" for x in b.column(at).to_pylist()]
        size += b.column(at).nbytes
        if size > _TEXT:
            yield from _apart(model, held, texts)
            held, texts, size = [], [], 0
    if held:
        yield from _apart(model, held, texts)


def _apart(model: dict, held: list, texts: list[str]):
    found, k = score_texts(model, texts) if texts else np.zeros(0), 0
    for b in held:
        yield b, found[k : k + b.num_rows]
        k += b.num_rows
