"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A document's features are its words, its word pairs, and the same for word shapes (``abc$$`` -> ``x$``, so
that unseen words count too; a pair of shapes also tells if its words are equal), hashed into ``2 ** BITS`` slots.  Each family's counts are divided by the
family's size; the score is the logistic of a sparse dot product.  Labels, language, source and ids are
never inputs of a score.

The model is fitted on a sample of at most ``SAMPLE`` labelled rows outside the held-out fifth (the bound
is the parameter ``sample``); its weights, ``4 * 2 ** BITS`` bytes, are broadcast to score every text.

Defined cases: null and empty texts get the score of the bias alone; without any labelled row every score
is 0.5; contradicting labels of a document count as the smaller; repeated rows score alike; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import Replayed, held_out, labelled_sample, map_arrow, session, words_of

BITS = 18
SAMPLE = 6000
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Each family's values add up to this.
SCALE = 8.0

_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"([^xX9])\1+"), rb"\1"))


class WordHashes(dict):
    """Word -> its hash in the high and its shape's hash in the low 32 bits; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        shape = word
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
        value = (xxhash.xxh32_intdigest(word) << 32) | xxhash.xxh32_intdigest(shape, seed=7)
        if len(self) > 400_000:
            self.clear()
        self[word] = value
        return value


_hashes = WordHashes()


def _mixed(x: np.ndarray, family: int) -> np.ndarray:
    x = (x + np.uint64(family * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x >> np.uint64(64 - BITS)


def slots(text: str | None) -> list[np.ndarray]:
    """The slots of each family's n-grams, repeats included."""
    words = words_of(text)
    if not words:
        return []
    packed = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    word, shape = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    found = [_mixed(word, 1), _mixed(shape, 2)]
    if len(words) > 1:
        found += [_mixed(word[:-1] << np.uint64(32) | word[1:], 3), _mixed((shape[:-1] << np.uint64(32) | shape[1:]) + (word[:-1] == word[1:]), 4)]
    return found


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots in ascending order and their values."""
    found = slots(text)
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    index = np.concatenate(found).astype(np.int64)
    value = np.concatenate([np.full(len(x), SCALE / len(x)) for x in found])
    order, where = np.unique(index, return_inverse=True)
    return order.astype(np.int32), np.bincount(where, value).astype(np.float32)


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """FTRL-Proximal over (slots in ascending order, values, label), gone through ``epochs`` times; the last weight is the bias, which isn't regularised."""
    size = 2**BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        if len(i) and i[-1] == size:
            w[-1] = -z[size] * alpha / (beta + np.sqrt(n[size]))
        return w

    for _ in range(epochs):
        for index, value, y in rows:
            i, x = np.append(index, size), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on at most ``sample`` labelled rows; only their sparse features reach the driver, some at a time."""

    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        found = [sparse(t) for t in cols["text"]]
        yield {"doc_id": cols["doc_id"], "y": cols["y"], "i": [i.tobytes() for i, _ in found], "x": [x.tobytes() for _, x in found]}

    rows = map_arrow(labelled_sample(docs, labels, label, sample), ["doc_id", "y", "text"], "doc_id long, y int, i binary, x binary", run)
    return fit(Replayed(rows, "doc_id", [F.xxhash64("doc_id"), "doc_id", "i", "x"], lambda r: (np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float32), r.y)))


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score`` double of every row."""
    sent = session(docs).sparkContext.broadcast(weights.tobytes())
    types = dict(docs.dtypes)
    columns = list(dict.fromkeys([*keep, text]))

    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        w = np.frombuffer(sent.value, np.float32)
        z = [float(w[-1]) + SCALE * sum(float(w[s].mean(dtype=np.float64)) for s in slots(t)) for t in cols[text]]
        yield {c: cols[c] for c in keep} | {"score": [float(1 / (1 + np.exp(-min(35.0, max(-35.0, x))))) for x in z]}

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return map_arrow(docs.withColumn(text, F.col(text).cast("string")), columns, f"{schema}, score double", run)


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) of every document."""
    scored = score(docs, train(docs, labels, sample=sample), keep)
    return scored.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
