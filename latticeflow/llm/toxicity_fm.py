"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words, lower-cased and without punctuation at either end, and the beginnings
that such words share, counted in levels, as 64-bit hashes.
The score is the logistic of a bias, a weight for each known term, and the products of the terms' factor
vectors, which learn pairs such as an insult with a group mention that additive weights miss.  Labels,
language, source and ids are never inputs of a score.

The model is fitted on at most ``SAMPLE`` labelled rows outside the held-out fifth; it holds terms that
at least ``SUPPORT`` of these rows have, so its size is bounded, and is broadcast to score every text.

Defined cases: null and empty texts get the score of the bias alone; without any labelled row every score
is 0.5; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import Replayed, held_out, labelled_sample, map_arrow, session

SAMPLE = 8000
SUPPORT = 5
FACTORS = 4
THRESHOLD = 0.5
#: Lengths of words' beginnings that are terms, and how many distinct words make the same beginning a further term.
BEGINNINGS = (3, 5, 7)
LEVELS = (1, 2, 4)
EDGES = b".,;:!?\"'()[]{}#$%&*|<>-_=+/\\~`^@"


def pieces(word: bytes) -> list[bytes]:
    """The term of a word as it stands in a lower-cased text, then the beginnings it shares with others."""
    term = word.strip(EDGES)
    if not term:
        return []
    letters = term.decode("utf-8", "surrogatepass")
    return [term, *(f"{letters[:k]}~".encode("utf-8", "surrogatepass") for k in BEGINNINGS if len(letters) > k)]


def hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of a whole text's terms; a beginning counts anew with 2, 4, 8 distinct words that have it."""
    found: set[int] = set()
    starts: Counter[bytes] = Counter()
    for term, *begun in filter(None, map(pieces, set((text or "").lower().encode("utf-8", "surrogatepass").split()))):
        found.add(xxhash.xxh64_intdigest(term))
        starts.update(begun)
    for begun, n in starts.items():
        found.update(xxhash.xxh64_intdigest(begun, seed=k) for k in LEVELS if n >= k)
    return np.fromiter(found, dtype=np.uint64, count=len(found))


def fit(rows: Iterable[tuple[np.ndarray, int]], support: int = SUPPORT, factors: int = FACTORS, epochs: int = 4, rate: float = 0.1, l1: float = 6.0, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Known hashes in ascending order, weights, factors and bias, from (distinct hashes, label), gone through ``epochs`` times and once before.

    Weights follow FTRL-Proximal updates, whose L1 term keeps chance terms at zero, so that a long text's many
    terms don't add up to noise; factors follow AdaGrad updates from small fixed pseudo-random values and
    belong to terms that have a weight.
    """
    every, seen, positive, labelled = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    waiting: list[np.ndarray] = []

    def counted() -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate([every, *waiting]), return_inverse=True)
        return found, np.bincount(where.reshape(-1), np.r_[seen, np.ones(sum(map(len, waiting)), np.int64)], len(found)).astype(np.int64)

    for h, y in rows:
        labelled, positive = labelled + 1, positive + y
        waiting.append(h)
        if sum(map(len, waiting[-64:])) > 1_000_000 or len(waiting) >= 1000:
            every, seen = counted()
            waiting = []
    if not labelled:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, factors)), 0.0
    every, seen = counted()
    known = every[seen >= support]

    def numbers(h: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(0, np.int64)
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        return np.sort(at[known[at] == h])

    z, n = np.zeros(len(known)), np.zeros(len(known))
    v = (np.random.default_rng(5).random((len(known), factors)) - 0.5) * 0.1
    gv = np.full((len(known), factors), 1e-2)
    share = min(max(positive / labelled, 0.01), 0.99)
    bias, gb = float(np.log(share / (1 - share))), 1.0
    alpha, beta = 0.5, 1.0

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for h, y in rows:
            i = numbers(h)
            w = weight(i)
            live = i[w != 0]
            f = v[live]
            total = f.sum(0)
            s = bias + w.sum() + 0.5 * float((total * total - (f * f).sum(0)).sum())
            d = 1 / (1 + np.exp(-np.clip(s, -35, 35))) - y
            sigma = (np.sqrt(n[i] + d * d) - np.sqrt(n[i])) / alpha
            z[i] += d - sigma * w
            n[i] += d * d
            if len(live) > 1:
                g = d * (total - f) + l2 * f
                gv[live] += g * g
                v[live] = np.clip(f - rate * g / np.sqrt(gv[live]), -1, 1)
            gb += d * d
            bias -= rate * d / np.sqrt(gb)
    w = weight(np.arange(len(known)))
    live = w != 0
    return known[live], w[live], v[live], bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The model of at most ``sample`` labelled rows; only their terms' hashes reach the driver, some at a time."""

    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        yield {"doc_id": cols["doc_id"], "y": cols["y"], "h": [np.sort(hashes(t)).tobytes() for t in cols["text"]]}

    rows = map_arrow(labelled_sample(docs, labels, label, sample), ["doc_id", "y", "text"], "doc_id long, y int, h binary", run)
    return fit(Replayed(rows, "doc_id", [F.xxhash64("doc_id"), "doc_id", "h"], lambda r: (np.frombuffer(r.h, np.uint64), r.y)))


class _Lookup(dict):
    """Word as it stands in a lower-cased text -> the number of its term in the model, or -1, and those of its
    beginnings that the model knows; emptied when it gets large."""

    def __init__(self, known: np.ndarray):
        super().__init__()
        self.known = {int(h): i for i, h in enumerate(known)}

    def __missing__(self, word: bytes) -> tuple[int, tuple[bytes, ...]]:
        found = pieces(word)
        value = (-1, ())
        if found:
            begun = tuple(b for b in found[1:] if any(xxhash.xxh64_intdigest(b, seed=k) in self.known for k in LEVELS))
            value = (self.known.get(xxhash.xxh64_intdigest(found[0]), -1), begun)
        if len(self) > 300_000:
            self.clear()
        self[word] = value
        return value

    def terms(self, text: str | None) -> list[int]:
        """Numbers of the model's terms that the whole text has, in ascending order."""
        found: set[int] = set()
        starts: Counter[bytes] = Counter()
        for i, begun in map(self.__getitem__, set((text or "").lower().encode("utf-8", "surrogatepass").split())):
            if i >= 0:
                found.add(i)
            if begun:
                starts.update(begun)
        for b, n in starts.items():
            found.update(i for k in LEVELS if n >= k and (i := self.known.get(xxhash.xxh64_intdigest(b, seed=k), -1)) >= 0)
        return sorted(found)


_lookups: dict[bytes, _Lookup] = {}


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray, float], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score`` double of every row."""
    sent = session(docs).sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    columns = list(dict.fromkeys([*keep, text]))

    def one(text: str | None, lookup: _Lookup, w: np.ndarray, v: np.ndarray, bias: float) -> float:
        s = bias
        if at := lookup.terms(text):
            f = v[at]
            s += w[at].sum() + 0.5 * float((f.sum(0) ** 2 - (f * f).sum(0)).sum())
        return float(1 / (1 + np.exp(-min(35.0, max(-35.0, s)))))

    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        known, w, v, bias = sent.value
        key = known.tobytes()
        if key not in _lookups:
            _lookups.clear()
            _lookups[key] = _Lookup(known)
        yield {c: cols[c] for c in keep} | {"score": [one(t, _lookups[key], w, v, bias) for t in cols[text]]}

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return map_arrow(docs.withColumn(text, F.col(text).cast("string")), columns, f"{schema}, score double", run)


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) of every document."""
    scored = score(docs, train(docs, labels, sample=sample), keep)
    return scored.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
