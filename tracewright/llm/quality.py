"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded (a tanh layer over its byte histogram and figures of
repetition and shape), gated attention (tanh times sigmoid) weighs the passages, and a logistic unit scores the weighted
sum. All weights are learned together, in numpy, from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import bound_batches
from tracewright.llm.sampling import labelled_sample, remainder

PASSAGE = 64
SAMPLE_PER_CLASS = 2000
CUT = 0.7
HIDDEN = 32
GATES = 16
_FIGURES = 8
WIDTH = 129 + _FIGURES
_CLASS = np.r_[np.arange(128), np.full(128, 128)]
_KIND = np.zeros((256, 4), np.float32)  # upper, digit, punctuation, line ends
_KIND[ord("A") : ord("Z") + 1, 0] = 1
_KIND[ord("0") : ord("9") + 1, 1] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()], 2] = 1
_KIND[10, 3] = 1


def passages(text: str | None) -> np.ndarray:
    """Features of each passage (at least one, also of an empty text)."""
    words = (text or "").encode("utf-8", "surrogatepass").replace(b"\n", b"\n ").split(b" ")
    out = np.zeros(((len(words) + PASSAGE - 1) // PASSAGE, WIDTH), np.float32)
    for i in range(len(out)):
        own = words[i * PASSAGE : (i + 1) * PASSAGE]
        raw = np.frombuffer(b" ".join(own), np.uint8)
        if not len(raw):
            continue
        hist = np.bincount(raw, minlength=256).astype(np.float32)
        n = len(own)
        again = sum([a == b for a, b in zip(own, own[1:])])
        out[i, :128] = hist[:128]
        out[i, 128] = hist[128:].sum()
        out[i, :129] = np.sqrt(out[i, :129] / len(raw))
        out[i, 129:133] = np.sqrt(hist @ _KIND / len(raw))
        out[i, 133:] = (len(set(own)) / n, again / n, len(raw) / n / 10, n / PASSAGE)
    return out


class AttentionModel:
    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, gates: int = GATES, seed: int = 1):
        r = np.random.default_rng(seed)
        g = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"w": g(width, hidden), "b": np.zeros(hidden, np.float32), "v": g(hidden, gates), "u": g(hidden, gates), "a": g(gates, 1), "o": g(hidden, 1), "c": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def forward(self, x: np.ndarray, heads: np.ndarray) -> dict:
        """x: passages of all bags one after another; heads: first passage of each bag."""
        p = self.p
        bag = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(x)]))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s @ p["a"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, heads)[bag])
        att = e / np.add.reduceat(e, heads)[bag]
        z = np.add.reduceat(h * att[:, None], heads)
        y = 1 / (1 + np.exp(-(z @ p["o"] + p["c"])[:, 0]))
        return {"x": x, "bag": bag, "h": h, "t": t, "s": s, "att": att, "z": z, "y": y}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        heads = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), heads)["y"]

    def fit(self, bags: list[np.ndarray], truth: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.004, seed: int = 2) -> AttentionModel:
        """Adam on the log loss, weighed so that both labels count alike."""
        if not len(bags) or truth.min() == truth.max():
            if len(bags):
                self.p["o"][:] = 0
                self.p["c"][:] = 4.0 if truth[0] else -4.0
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weigh = np.where(truth == 1, 0.5 / truth.mean(), 0.5 / (1 - truth.mean())).astype(np.float32)
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                f = self.forward(np.concatenate([bags[i] for i in own]), np.cumsum([0, *(len(bags[i]) for i in own[:-1])]))
                grads = self._gradients(f, (f["y"] - truth[own]) * weigh[own] / len(own))
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, f: dict, dy: np.ndarray) -> dict[str, np.ndarray]:
        p, h, t, s, att, bag = self.p, f["h"], f["t"], f["s"], f["att"], f["bag"]
        dz = dy[:, None] * p["o"][:, 0]
        dh = dz[bag] * att[:, None]
        datt = (dz[bag] * h).sum(1)
        heads = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        de = att * (datt - np.add.reduceat(att * datt, heads)[bag])
        dt, ds = de[:, None] * p["a"][:, 0] * s * (1 - t * t), de[:, None] * p["a"][:, 0] * t * s * (1 - s)
        dh = dh + dt @ p["v"].T + ds @ p["u"].T
        dpre = dh * (1 - h * h)
        return {"w": f["x"].T @ dpre, "b": dpre.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": ((t * s).T @ de)[:, None], "o": f["z"].T @ dy[:, None], "c": dy.sum(keepdims=True)}


def _scores(model: AttentionModel):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            bags: list[np.ndarray] = []
            size = 0
            for text in b.column(2):
                bags.append(passages(text.as_py()))
                size += len(bags[-1])
                if size > 20_000:
                    out.append(model.score(bags))
                    bags, size = [], 0
            if bags:
                out.append(model.score(bags))
            got = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.astype(np.float64))], ["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, rows_per_class: int = SAMPLE_PER_CLASS) -> AttentionModel:
    sample = labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), modulus) != held, rows_per_class)
    return AttentionModel().fit([passages(t) for t, _ in sample], np.array([y for _, y in sample], np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, rows_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, scored over its whole text.

    * Fitted on at most rows_per_class rows of each label whose crc32(doc_id) mod modulus is not held.
    * Null and empty texts are one empty passage and get its score. A null doc_id is scored, and never held out. Without
      labels every score is that of the untrained network; with one label only, near that label.
    * Repeated rows stay repeated; other columns are ignored. No rows give no rows.
    """
    bound_batches(docs.sparkSession)
    model = train(docs, labels, modulus, held, rows_per_class)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )
