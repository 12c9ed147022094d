"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in stretches of ``STEPS`` bytes (all of them, to the end). A GRU reads each stretch forwards and another one
backwards, each beginning ``LEAD`` bytes outside the stretch, so that no state starts in the middle of a word or character
that it has to label. At every position both states give probabilities of the languages; a document's are the mean over
its positions. The network is trained here in numpy by backpropagation through time on stretches of ``LEARNED`` bytes, drawn
from the whole texts of a bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.llm.common import bound_batches, hashed_sample
from tracewright.llm.sampling import remainder

STEPS = 256
LEAD = 16
LEARNED = 64
HIDDEN = 12
SAMPLE_ROWS = 2000
UNKNOWN = "und"
SLICE_ROWS = 512


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Piecewise linear gate (0 below -2, 1 above 2): cheap, with a simple slope."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


def _slope(y: np.ndarray) -> np.ndarray:
    return np.where((y > 0) & (y < 1), np.float32(0.25), np.float32(0))


class ByteGRU:
    """One direction. Parameters: table of byte inputs (256, 3h), recurrent matrix (h, 3h), bias (3h)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.e = (rng.standard_normal((256, 3 * hidden)) * 0.5).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def run(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """x: bytes (steps, batch) -> states (steps, batch, h). trace: gets what the backward pass needs."""
        steps, n = x.shape
        k = self.h
        table = self.e + self.b
        out = np.empty((steps, n, k), np.float32)
        state = np.zeros((n, k), np.float32)
        for t in range(steps):
            inp = table[x[t]]
            rec = state @ self.u
            gates = _sigmoid(inp[:, : 2 * k] + rec[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            cand = np.tanh(inp[:, 2 * k :] + r * rec[:, 2 * k :])
            if trace is not None:
                trace.append((state, gates, cand, rec[:, 2 * k :].copy()))
            state = cand + z * (state - cand)
            out[t] = state
        return out

    def back(self, x: np.ndarray, trace: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        k = self.h
        grads = {"e": np.zeros_like(self.e), "u": np.zeros_like(self.u), "b": np.zeros_like(self.b)}
        ds = np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            before, gates, cand, rec = trace[t]
            z, r = gates[:, :k], gates[:, k:]
            ds = ds + dout[t]
            dcand = ds * (1 - z) * (1 - cand * cand)
            dgates = np.concatenate([ds * (before - cand), dcand * rec], 1) * _slope(gates)
            dinp = np.concatenate([dgates, dcand], 1)
            drec = np.concatenate([dgates, dcand * r], 1)
            np.add.at(grads["e"], x[t], dinp)
            grads["b"] += dinp.sum(0)
            grads["u"] += before.T @ drec
            ds = ds * z + drec @ self.u.T
        return grads


class LanguageModel:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.fw, self.bw = ByteGRU(hidden, rng), ByteGRU(hidden, rng)
        self.o = (rng.standard_normal((2 * hidden, max(1, len(langs)))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.c = np.zeros(max(1, len(langs)), np.float32)

    def positions(self, x: np.ndarray, traces: tuple[list, list] | tuple[None, None] = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (steps, batch, langs) and states (steps, batch, 2h)."""
        s = np.concatenate([self.fw.run(x, traces[0]), self.bw.run(x[::-1], traces[1])[::-1]], 2)
        logit = s.reshape(-1, s.shape[2]) @ self.o + self.c
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        return p.reshape(*s.shape[:2], -1), s

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 160, batch: int = 192, rate: float = 0.02) -> LanguageModel:
        """x: stretches (n, LEARNED), y: language numbers. Languages are drawn alike often."""
        rng = np.random.default_rng(7)
        groups = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        params = {"fe": self.fw.e, "fu": self.fw.u, "fb": self.fw.b, "be": self.bw.e, "bu": self.bw.u, "bb": self.bw.b, "o": self.o, "c": self.c}
        m1 = {k: np.zeros_like(v) for k, v in params.items()}
        m2 = {k: np.zeros_like(v) for k, v in params.items()}
        for step in range(1, rounds + 1):
            own = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups])
            xs, ys = x[own].T, y[own]
            t1: list = []
            t2: list = []
            p, s = self.positions(xs, (t1, t2))
            d = p.copy()
            d[:, np.arange(len(ys)), ys] -= 1
            d /= d.shape[0] * d.shape[1]
            flat = d.reshape(-1, d.shape[2])
            ds = (flat @ self.o.T).reshape(s.shape)
            k = self.fw.h
            gf = self.fw.back(xs, t1, ds[:, :, :k])
            gb = self.bw.back(xs[::-1], t2, ds[::-1, :, k:])
            grads = {**{"f" + n: g for n, g in gf.items()}, **{"b" + n: g for n, g in gb.items()}, "o": s.reshape(-1, s.shape[2]).T @ flat, "c": flat.sum(0)}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for n, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1[n] = 0.9 * m1[n] + 0.1 * g
                m2[n] = 0.99 * m2[n] + 0.01 * g * g
                params[n] -= rate * min(1.0, 2 * (1 - step / (rounds + 1))) * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-7)
        return self

    def score(self, texts: list[bytes], block: int = 1024) -> np.ndarray:
        """Mean probabilities of each text over all of its bytes; block: stretches at a time, of about one length."""
        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        space = b" " * (STEPS + LEAD)  # around every text
        joined = np.frombuffer(space + b"".join(t + space for t in texts), np.uint8)
        begin = np.cumsum(sizes + len(space)) - sizes
        at = begin[owner] + number * STEPS - LEAD
        left = np.minimum(sizes[owner] - number * STEPS, STEPS)
        order = np.argsort(-left, kind="stable")
        for a in range(0, len(order), block):
            own = order[a : a + block]
            short = left[own]
            steps = int(short[0])
            p = self.positions(joined[at[own] + np.arange(steps + 2 * LEAD)[:, None]])[0][LEAD:-LEAD]
            if short[-1] < steps:
                p = p * (np.arange(steps)[:, None] < short)[:, :, None]
            np.add.at(total, owner[own], p.sum(0))
        return total / np.maximum(sizes, 1)[:, None]


def stretches(text: str) -> np.ndarray:
    """The whole text in stretches of LEARNED bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    raw += b" " * (-len(raw) % LEARNED)
    return np.frombuffer(raw, np.uint8).reshape(-1, LEARNED)


def train(docs: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """From at most `rows` rows (those of least id hash) with a language and a text among the allowed ones."""
    picked = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .where(allowed)
        .where("lang is not null and length(text) > 0")
    )
    ids = hashed_sample(picked.select("doc_id", "lang"), rows, "doc_id", "lang")
    sample = sorted((r["lang"], r["text"]) for r in picked.join(F.broadcast(ids.distinct()), ["doc_id", "lang"]).collect())
    langs = sorted({lang for lang, _ in sample})
    model = LanguageModel(langs)
    if len(langs) > 1:
        grids = [stretches(t) for _, t in sample]
        truth = np.repeat([langs.index(lang) for lang, _ in sample], [len(g) for g in grids])
        model.fit(np.concatenate(grids), truth)
    return model


def _predict(model: LanguageModel, with_text: bool):  # noqa: ANN202
    """Text is the last column; it comes back where with_text is set. A few rows at a time bound the working memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, SLICE_ROWS) for whole in batches for a in range(0, whole.num_rows, SLICE_ROWS)):
            texts = b.column(b.num_columns - 1).to_pylist()
            known = [bool(t) and any(map(str.isalpha, t)) and bool(model.langs) for t in texts]
            prob = model.score([t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known)])
            best = prob.argmax(1) if len(model.langs) else np.zeros(len(texts), int)
            pred = [model.langs[i] if k else UNKNOWN for i, k in zip(best, known)]
            score = [float(min(1.0, p[i])) if k else 0.0 for p, i, k in zip(prob, best, known)]
            n = b.num_columns - (not with_text)
            cols = [b.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:n], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, modulus: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, read over its whole text.

    * keep: columns of docs that are handed through unchanged, so that no join has to bring them back. The result's own
      names cannot be among them.
    * Learned from at most `rows` rows whose crc32(doc_id) mod modulus is not held and whose lang is not null.
    * A null or empty text, or one without any letter, is "und" with score 0; so is every text where no language could be
      learned. With a single learned language each text with a letter has it, with score 1.
    * A null doc_id is predicted, never learned from and never held out. Repeated rows stay repeated; other columns are
      ignored. No rows give no rows.
    """
    if {"doc_id", "held_out", "lang_pred", "score"} & set(keep):
        raise ValueError("keep names a column of the result")
    bound_batches(docs.sparkSession)
    model = train(docs, remainder(F.col("doc_id"), modulus) != held, rows)
    table = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
        *(F.col(c) for c in keep if c != "text"),
        F.col("text").cast("string").alias("text"),
    )
    fields = StructType(table.schema.fields[: None if "text" in keep else -1])
    return table.mapInArrow(_predict(model, "text" in keep), fields.add("lang_pred", "string").add("score", "double"))
