"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy on the driver by backpropagation through time, on at most SAMPLE windows of WINDOW bytes for each
language and at most TOTAL windows in all (documented bounds), cut at hashed places from the labelled documents that are
not held out. Every byte of a text is labelled by the states of both directions; a document's probabilities are the
means over its bytes. Long texts are read in chunks of CHUNK bytes, each with CONTEXT bytes on either side, so that a
text of any length needs bounded memory and all of its bytes count.

A null text, or one without a letter (Unicode category L), is ``und`` with score 0. Without any labelled row every
document is ``und``. Equally probable languages: the first in alphabetical order. Repeated rows of one doc_id are one
document. Predictions see the text alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SAMPLE, WINDOW, HIDDEN, STEPS, BATCH = 1500, 96, 16, 450, 96
TOTAL = 64 * SAMPLE
CHUNK, CONTEXT, ROWS = 384, 24, 1024
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def states(p, x):
    """Hidden states (steps, 2, rows, HIDDEN) of both directions; x is (steps, rows) bytes. Also what training needs."""
    h = np.zeros((2, x.shape[1], HIDDEN), np.float32)
    hs, kept = [], []
    for t in range(len(x)):
        a = np.stack([p["in"][0][x[t]], p["in"][1][x[-1 - t]]])
        u = h @ p["re"]
        zr = 0.5 + 0.5 * np.tanh(0.5 * (a[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN]))
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        un = u[..., 2 * HIDDEN :]
        n = np.tanh(a[..., 2 * HIDDEN :] + r * un)
        new = n + z * (h - n)
        kept.append((h, z, r, un, n))
        h = new
        hs.append(h)
    return np.stack(hs), kept


def probabilities(p, hs):
    logits = hs[:, 0] @ p["out"][:HIDDEN] + hs[::-1, 1] @ p["out"][HIDDEN:] + p["bias"]
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(p, x, y):
    """Mean cross-entropy of every position's label, and its gradient."""
    hs, kept = states(p, x)
    prob = probabilities(p, hs)
    steps, rows = x.shape
    loss = -np.log(prob[:, np.arange(rows), y] + 1e-9).mean()
    d = prob.copy()
    d[:, np.arange(rows), y] -= 1
    d /= steps * rows
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["bias"] = d.sum((0, 1))
    g["out"][:HIDDEN] = np.tensordot(hs[:, 0], d, ((0, 1), (0, 1)))
    g["out"][HIDDEN:] = np.tensordot(hs[::-1, 1], d, ((0, 1), (0, 1)))
    dh_out = np.stack([d @ p["out"][:HIDDEN].T, (d @ p["out"][HIDDEN:].T)[::-1]], 1)
    dh = np.zeros_like(hs[0])
    das = np.empty((steps, 2, rows, 3 * HIDDEN), np.float32)
    back = p["re"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, un, n = kept[t]
        dh = dh + dh_out[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r], -1)
        das[t] = np.concatenate([dz, dr, dn], -1)
        g["re"] += h.transpose(0, 2, 1) @ du
        dh = dh * z + du @ back
    for k, bytes_ in ((0, x), (1, x[::-1])):
        hot = np.zeros((steps * rows, 256), np.float32)
        hot[np.arange(steps * rows), bytes_.reshape(-1)] = 1
        g["in"][k] = hot.T @ das[:, k].reshape(-1, 3 * HIDDEN)
    return loss, g


def train(x: np.ndarray, y: np.ndarray, langs: int, steps: int = STEPS, seed: int = 7) -> dict:
    """x: (windows, WINDOW) bytes, y: language numbers; batches are balanced over the languages; Adam."""
    rng = np.random.default_rng(seed)
    p = {
        "in": rng.normal(0, 0.3, (2, 256, 3 * HIDDEN)).astype(np.float32),
        "re": rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "out": rng.normal(0, 0.3, (2 * HIDDEN, langs)).astype(np.float32),
        "bias": np.zeros(langs, np.float32),
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    of = [np.flatnonzero(y == k) for k in range(langs)]
    for i in range(1, steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(0, langs, BATCH)])
        _, g = gradients(p, x[pick].T, y[pick])
        norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
        rate = 0.02 * min(1.0, i / 20) * (1 - 0.9 * i / steps)
        for k in p:
            w = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * w
            v[k] = 0.99 * v[k] + 0.01 * w * w
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return p


def by_gate(p):
    """Input and recurrent weights of each gate apart, those of the two sigmoid gates halved: sigmoid(x) is 0.5 + 0.5 tanh(x / 2)."""
    inputs = p["in"].reshape(2, 256, 3, HIDDEN).transpose(2, 0, 1, 3).copy()
    again = p["re"].reshape(2, HIDDEN, 3, HIDDEN).transpose(2, 0, 1, 3).copy()
    inputs[:2] *= np.float32(0.5)
    again[:2] *= np.float32(0.5)
    return inputs, again, p["out"].reshape(2, HIDDEN, -1).copy(), p["bias"]


def position_logits(gates, x, ends):
    """(steps, rows, languages) of x, (steps, rows) bytes: as probabilities(states()), in place and without the states.

    ends: how many bytes each row has, ascending; the backward states begin there, so that no row's result depends on others.
    """
    inputs, again, out, _ = gates
    steps, rows = x.shape
    made = np.empty((2, steps, rows, out.shape[2]), np.float32)
    h = np.zeros((2, rows, HIDDEN), np.float32)
    z, r, n, a = (np.empty_like(h) for _ in range(4))
    x = x.astype(np.intp)
    half = np.float32(0.5)
    for t in range(steps):
        here, there = x[t], x[steps - 1 - t]
        for k, gate in ((0, z), (1, r), (2, n)):
            np.matmul(h, again[k], out=gate)
            if k == 2:
                gate *= r
            np.take(inputs[k, 0], here, axis=0, out=a[0], mode="clip")
            np.take(inputs[k, 1], there, axis=0, out=a[1], mode="clip")
            gate += a
            np.tanh(gate, out=gate)
            if k < 2:
                gate *= half
                gate += half
        h -= n
        h *= z
        h += n
        h[1, : np.searchsorted(ends, steps - 1 - t, "right")] = 0
        np.dot(h[0], out[0], out=made[0, t])
        np.dot(h[1], out[1], out=made[1, steps - 1 - t])
    made[0] += made[1]
    return made[0]


def summed(gates, logits, use):
    """(rows, languages): the probabilities of the used positions, added up."""
    steps, rows, langs = logits.shape
    e = np.ascontiguousarray(logits.reshape(-1, langs).T)
    e += gates[3][:, None]
    e -= e.max(0)
    np.exp(e, out=e)
    e *= np.ascontiguousarray(use.T).reshape(-1) / e.sum(0)
    return e.reshape(langs, steps, rows).sum(1).T


def text_probabilities(p: dict, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all bytes of each text; texts are cut into chunks that overlap by CONTEXT on each side."""
    gates = by_gate(p)
    total = np.zeros((len(texts), len(p["bias"])))
    pieces = [(i, a) for i, text in enumerate(texts) for a in range(0, len(text), CHUNK)]
    pieces.sort(key=lambda q: min(len(texts[q[0]]) - q[1], CHUNK))
    for lo in range(0, len(pieces), ROWS):
        part = pieces[lo : lo + ROWS]
        width = min(CHUNK, max(len(texts[i]) - a for i, a in part))
        x = np.zeros((len(part), width + 2 * CONTEXT), np.uint8)
        use = np.zeros(x.shape, np.float32)
        for k, (i, a) in enumerate(part):
            begin = max(0, a - CONTEXT)
            cut = texts[i][begin : a + min(width, CHUNK) + CONTEXT]
            at = CONTEXT - (a - begin)
            x[k, at : at + len(cut)] = np.frombuffer(cut, np.uint8)
            use[k, CONTEXT : CONTEXT + min(width, len(texts[i]) - a)] = 1
        ends = np.array([min(CHUNK, len(texts[i]) - a) + 2 * CONTEXT for i, a in part])
        np.add.at(total, [i for i, _ in part], summed(gates, position_logits(gates, x.T, ends), use))
    return total / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


def held_out(doc_id="doc_id"):
    return F.expr(f"coalesce(crc32(cast(cast({doc_id} as string) as binary)) % 5 = 0, false)")


def fit(docs: DataFrame) -> tuple[list[str], dict] | None:
    """Languages and network, from labelled rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and length(trim(text)) > 0").where(~held_out())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(1, min(SAMPLE, TOTAL // len(sizes)))
    rates = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, 1.3 * each / n))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.element_at(rates, F.col("lang")) * (1 << 20))

    edge = bytes(CONTEXT)  # as beyond the ends of a text when it is read

    def cut(batches):
        for batch in batches:
            out = []
            for key, text, lang in zip(*(c.column(batch, k).to_pylist() for k in ("doc_id", "text", "lang"))):
                raw = edge + text.encode() + edge
                at = zlib.crc32(f"{key} place".encode()) % max(1, len(raw) - WINDOW + 1)
                out.append((zlib.crc32(f"{key} order".encode()), lang, raw[at : at + WINDOW].ljust(WINDOW, b"\0")))
            cols = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, (pa.int64(), pa.string(), pa.binary()))], names=["place", "lang", "window"])

    first = Window.partitionBy("lang").orderBy("place", "window")
    made = drawn.mapInArrow(cut, "place long, lang string, window binary").withColumn("nth", F.row_number().over(first))
    got = made.where(F.col("nth") <= each).orderBy("lang", "nth").collect()
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    x = np.stack([np.frombuffer(bytes(r["window"]), np.uint8) for r in got])
    return langs, train(x, np.array([langs.index(r["lang"]) for r in got]), len(langs))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each document."""
    made = c.own_id(predicted(c.documents(docs), fit(docs)))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def label(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one row for each doc_id, and lang_pred and score."""
    return c.own_id(predicted(c.one_row(docs), fit(docs)))


def predicted(docs: DataFrame, fitted) -> DataFrame:
    """The columns (of doc_id and text alone: doc_id) with lang_pred and score."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    names = docs.columns if len(docs.columns) > 2 else ["doc_id"]
    schema = docs.select(names).schema.add("lang_pred", "string").add("score", "double")

    def rows(batches):
        for batch in batches:
            texts = c.column(batch, "text").to_pylist()
            for lo, hi in c.slices(np.cumsum([0, *(len(x or "") for x in texts)]), 1 << 20):
                part = texts[lo:hi]
                known = [bool(model.value and x and LETTER.search(x)) for x in part]
                pred, score = [UNDETERMINED] * len(part), np.zeros(len(part))
                if any(known):
                    prob = text_probabilities(model.value[1], [x.encode() if k else b"" for x, k in zip(part, known)])
                    best = prob.argmax(1)
                    score = np.where(known, np.clip(prob.max(1), 0, 1), 0.0)
                    pred = [model.value[0][b] if k else UNDETERMINED for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays([*(c.column(batch, n)[lo:hi] for n in names), pa.array(pred), pa.array(score)], names=[*names, "lang_pred", "score"])
        c.tidy()

    return docs.mapInArrow(rows, schema)
