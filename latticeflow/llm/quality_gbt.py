"""Quality rules: gradient-boosted trees over document statistics.

Base rules are exact counts; the verdict beyond them comes from trees fitted on labelled rows, flattened
into numpy node arrays and scored for many documents at once.  Trees are monotone in the statistics listed
in ``FALLING``: more symbols, repeated lines, repeated words or capitals never raise a score.

The trees are fitted on at most ``SAMPLE`` labelled rows outside the held-out fifth, of which only the
statistics reach the driver.

Defined cases: null and empty texts have no words and fail the base rules; without labelled rows the trees
keep every document that the base rules keep; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import labelled_sample, map_arrow, session

SAMPLE = 8000
THRESHOLD = 0.5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BREAKS = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "shouts", "stops", "bars", "distinct_words", "pair_repeats", "longest_word")
FALLING = ("symbols", "dup_lines", "repeat_words", "capitals", "shouts", "bars", "pair_repeats")


def repeated(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    if size < 2**21:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        _, where, counts = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    again = counts[where.reshape(-1)] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the statistics of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0] * len(COUNTS), [0.0] * len(STATISTICS)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    lines, seen, dup = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    n = len(words)
    word_chars = len(text) - int(chars[BREAKS].sum())
    symbols, again = int(chars[SYMBOLS].sum()), repeated(ids)
    letters = max(1, word_chars)
    return [n, word_chars, symbols, dup, again], [
        float(np.log1p(n)), word_chars / n, symbols / n, dup / lines, again / n, float(chars[0x41:0x5B].sum()) / letters, float(chars[0x30:0x3A].sum()) / letters,
        float(chars[0x21]) / n, float(chars[0x2E]) / n, words.count(b"|") / n, len(numbers) / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, float(np.log1p(max(map(len, numbers)))),
    ]


class Forest:
    """Trees as flat node arrays: statistic, threshold, children; a leaf's children are itself."""

    def __init__(self, base: float, trees: list[list[list[float]]]):
        offsets = np.cumsum([0, *map(len, trees)])
        nodes = np.array([x for t in trees for x in t], float).reshape(-1, 5)
        shift = np.repeat(offsets[:-1], [len(t) for t in trees])
        self.base, self.roots = base, offsets[:-1]
        self.feature, self.threshold, self.value = nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 4]
        self.left, self.right = nodes[:, 2].astype(int) + shift, nodes[:, 3].astype(int) + shift
        self.depth = 0 if not len(nodes) else DEPTH

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(1), -35, 35)))


DEPTH = 3


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3, bins: int = 64, least: float = 3.0, l2: float = 1.0) -> Forest:
    """Newton boosting on binned statistics; a split against a statistic's direction isn't taken, and the
    children's values stay on their side of the middle between them."""
    if not len(y):
        return Forest(35.0, [])
    p = min(max(y.mean(), 0.01), 0.99)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return Forest(base, [])
    falling = np.array([s in FALLING for s in STATISTICS])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    z = np.full(len(y), base)
    forest = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
            at = len(nodes)
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
            nodes.append([0, np.inf, at, at, rate * value])
            best = (1e-6, None)
            if depth < DEPTH:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(c) + 1))[:-1]
                    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if falling[f]:
                        gain[vl < vr] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (f, k, float(vl[k] + vr[k]) / 2))
            if best[1]:
                f, k, middle = best[1]
                go = binned[rows, f] <= k
                side = ((middle, high), (low, middle)) if falling[f] else ((low, high), (low, high))
                left = grow(rows[go], depth + 1, *side[0])
                right = grow(rows[~go], depth + 1, *side[1])
                nodes[at] = [f, float(cuts[f][k]), left, right, 0.0]
            else:
                leaf[rows] = rate * value
            return at

        leaf = np.zeros(len(y))
        grow(np.arange(len(y)), 0, -np.inf, np.inf)
        z += leaf
        forest.append(nodes)
    return Forest(base, forest)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        yield {"doc_id": cols["doc_id"], "y": cols["y"], "x": [np.array(measure(t)[1]).tobytes() for t in cols["text"]]}

    rows = map_arrow(labelled_sample(docs, labels, label, sample), ["doc_id", "y", "text"], "doc_id long, y int, x binary", run).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    return fit(np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([r.y for r in rows], float))


def judge(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns, the base counts, ``base_failed``, ``score`` and ``kept`` of every row."""
    sent = session(docs).sparkContext.broadcast(forest)
    types = dict(docs.dtypes)
    columns = list(dict.fromkeys([*keep, text]))

    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        found = [measure(t) for t in cols[text]]
        score = sent.value.score(np.array([s for _, s in found]))
        yield {c: cols[c] for c in keep} | {c: [b[i] for b, _ in found] for i, c in enumerate(COUNTS)} | {"score": score.tolist()}

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} long" for c in COUNTS), "score double"])
    found = map_arrow(docs.withColumn(text, F.col(text).cast("string")), columns, schema, run)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def apply(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return judge(docs, train(docs, labels, sample=sample))
