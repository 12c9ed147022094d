"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned: terms, and beginnings of words, that documents labelled toxic have far oftener than others. Its trie
is run together with a Levenshtein automaton: a state is a set of (trie node, errors so far), made when first reached and
kept, so a word takes one table step per character. Hits are weighed in context: near quotation marks or words of saying
they count apart from plain ones, and the densest window of words is a feature of its own. A logistic unit over these
figures gives the score; figures for fitting it come from lexicons learned on the other half of the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import bound_batches
from tracewright.llm.sampling import labelled_sample, remainder

SAMPLE_PER_CLASS = 2500
CUT = 0.5
CONTEXT = 12
#: Words of the window of which the densest counts.
WINDOW = 50
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»‹›]")
_QUOTES = frozenset("\"“”„«»‹›")
#: Words of saying in English, German, French and Spanish.
_SAYING = frozenset("said says wrote quoted called sagte schrieb zitiert nannte dit écrit cité appelé dijo escribió citó llamó".split())


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Trie of terms times Levenshtein automaton, made deterministic as it is used."""

    LIMIT = 100_000

    def __init__(self, terms: dict[str, bool]):
        """terms: term -> whether it also stands for words that begin with it (then without errors)."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.prefix: list[bool] = [False]
        self.most = [0]
        for term, prefix in sorted(terms.items()):
            node, k = 0, 0 if prefix else allowed_errors(term)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.prefix.append(False)
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node] = term
            self.prefix[node] = prefix
        self._clear()

    def _clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        todo = list(at.items())
        while todo:  # skipping a character of the term is an error
            node, e = todo.pop()
            if at.get(node, 99) < e:
                continue
            for child in self.next[node].values():
                if e < self.most[child] and at.get(child, 99) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(at.items())
        if key in self.states:
            return self.states[key]
        self.states[key] = len(self.sets)
        self.sets.append(key)
        self.steps.append({})
        best = [(e, self.ends[n]) for n, e in key if self.ends[n] and e <= (0 if self.prefix[n] else allowed_errors(self.ends[n]))]
        self.accept.append((min(best)[1], min(best)[0]) if best else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            if self.prefix[node] and e == 0:
                out[node] = 0
            for ch, child in self.next[node].items():
                cost = e if ch == c else e + 1
                if cost <= self.most[child] and out.get(child, 99) > cost:
                    out[child] = cost
            if e + 1 <= self.most[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, errors) of the closest term, or None."""
        if len(self.sets) > self.LIMIT:
            self._clear()
        state = self.start
        for c in word:
            nxt = self.steps[state].get(c)
            if nxt is None:
                nxt = self._step(state, c)
                self.steps[state][c] = nxt
            if nxt < 0:
                return None
            state = nxt
        return self.accept[state]


def learn_lexicon(texts: list[list[str]], truth: list[int]) -> dict[str, bool]:
    """Terms and word beginnings of at least 4 letters with log odds of over 3 in toxic documents.

    In toxic documents a word counts once for each pair of neighbours, so words that merely come along in many copies of
    one document stay rare; in the others it counts each time.
    """
    seen: set[int] = set()
    words: Counter = Counter()
    n1 = n0 = 0
    for own, y in zip(texts, truth):
        if not y:
            n0 += len(own)
            continue
        for a, w, b in zip(["", *own], own, [*own[1:], ""]):
            context = hash((a, w, b))
            if context not in seen:
                seen.add(context)
                n1 += 1
                if len(w) >= 3:
                    words[w] += 1
    least = max(5, 0.01 * sum(truth))
    stems: Counter = Counter()
    for w, c in words.items():
        for k in range(4, min(len(w), 9)):
            stems[w[:k] + "*"] += c
    bad = {w: c for counts in (words, stems) for w, c in counts.items() if c >= least}
    good: Counter = Counter()
    for own, y in zip(texts, truth):
        if not y:
            for w in own:
                if w in bad:
                    good[w] += 1
                for k in range(4, min(len(w), 9)):
                    if (stem := w[:k] + "*") in bad:
                        good[stem] += 1
    strong = {w: o for w, c in bad.items() if (o := np.log((c + 0.5) / max(1, n1)) - np.log((good[w] + 0.5) / max(1, n0))) > 3}
    out: dict[str, bool] = {}
    # a beginning stands where several words share it; words that it covers and longer beginnings are left out
    for w in sorted((w for w in strong if w.endswith("*")), key=len):
        stem = w[:-1]
        if any(stem[:k] in out for k in range(4, len(stem))):
            continue
        if bad[w] >= 1.5 * max([bad[x] for x in strong if x.startswith(stem) and not x.endswith("*")], default=0):
            out[stem] = True
    for w in sorted((w for w in strong if not w.endswith("*")), key=lambda w: (-strong[w] * bad[w], w)):
        if not any(w[:k] in out and out[w[:k]] for k in range(4, len(w) + 1)):
            out[w] = False
    return out


class Detector:
    CACHE = 500_000

    def __init__(self, lexicon: dict[str, bool], weights: np.ndarray | None = None):
        self.lexicon = lexicon
        self.weights = weights
        self.automaton = LexiconAutomaton(lexicon)
        self.cache: dict[str, tuple[str, int] | None] = {}

    def __reduce__(self):  # the automaton is made anew where the detector arrives
        return Detector, (self.lexicon, self.weights)

    def hits(self, text: str | None) -> tuple[list[tuple[int, str, int]], list[str]]:
        """(word number, term, errors) of each hit, and the words."""
        if len(self.cache) > self.CACHE:
            self.cache = {}
        words = words_of(text)
        cache, match = self.cache, self.automaton.match
        found = []
        for w in set(words):
            if w not in cache:
                cache[w] = match(w)
            if cache[w]:
                found.append(w)
        if not found:
            return [], words
        own = set(found)
        return [(i, *cache[w]) for i, w in enumerate(words) if w in own], words

    def figures(self, text: str | None) -> np.ndarray:
        """Exact, misspelled and stem hits outside quotation; quoted hits; hits in the densest window; hits per word."""
        hits, words = self.hits(text)
        if not hits:
            return np.zeros(6, np.float64)
        exact = near = stem = quoted = 0
        at = []
        for i, term, errors in hits:
            around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            before, after = words[max(0, i - CONTEXT) : i], words[i + 1 : i + CONTEXT + 1]
            if (not _QUOTES.isdisjoint(before) and not _QUOTES.isdisjoint(after)) or not _SAYING.isdisjoint(around):
                quoted += 1
                continue
            at.append(i)
            if self.lexicon[term]:
                stem += 1
            elif errors:
                near += 1
            else:
                exact += 1
        places = np.array(at)
        dense = int((np.searchsorted(places, places + WINDOW) - np.arange(len(at))).max()) if at else 0
        return np.log1p(np.array([exact, near, stem, quoted, dense, 100 * len(at) / len(words)], np.float64))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.figures(t) for t in texts], np.float64).reshape(len(texts), 6)
        return 1 / (1 + np.exp(-(x @ self.weights[:6] + self.weights[6])))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> np.ndarray:
    """Newton steps, both labels weighed alike; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 0 if not len(y) else 4 * (2 * y[0] - 1)
        return w
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    keep = np.diag([*[ridge / len(y)] * (len(w) - 1), 1e-6 / len(y)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weigh * (p - y)) + keep @ w
        hess = (x * (weigh * p * (1 - p))[:, None]).T @ x + keep
        w -= np.linalg.solve(hess, grad)
    return w


def fit(sample: list[tuple[str, int]]) -> Detector:
    texts = [t for t, _ in sample]
    truth = [y for _, y in sample]
    sets = [words_of(t) for t in texts]
    figures, marks = [], []
    for half in (0, 1):
        lexicon = learn_lexicon(sets[half::2], truth[half::2])
        d = Detector(lexicon)
        figures += [d.figures(t) for t in texts[1 - half :: 2]]
        marks += truth[1 - half :: 2]
    w = logistic(np.array(figures).reshape(len(figures), 6), np.array(marks, float))
    w[[0, 1, 2, 4, 5]] = np.maximum(w[[0, 1, 2, 4, 5]], 0)  # more hits never lower a score
    return Detector(learn_lexicon(sets, truth), w)


def _scores(detector: Detector):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = detector.scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, rows_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, scored over its whole text.

    * Lexicon and weights are learned on at most rows_per_class rows of each label whose crc32(doc_id) mod modulus is not held.
    * Null and empty texts have no hits and get the score of a text without hits. A null doc_id is scored, and never held
      out. Without labels the lexicon is empty and every score is 0.5 or less.
    * Repeated rows stay repeated; other columns are ignored. No rows give no rows.
    """
    bound_batches(docs.sparkSession)
    detector = fit(labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), modulus) != held, rows_per_class))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(_scores(detector), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )
