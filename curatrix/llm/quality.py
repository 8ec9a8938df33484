"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on binned statistics of a bounded sample of labelled documents, then flattened
into five arrays (feature, threshold, left, right, value) that numpy walks for a whole batch at once.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import id_text
from curatrix.llm.toxicity import labelled

#: Labelled rows, by smallest hash of doc_id, on which the trees are grown.
TRAINING_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeats_next", "short_words", "long_words",
    "lower", "upper", "digit", "space", "line_ends", "pipes", "marks", "stops", "bangs", "commas", "other", "wide",
    "distinct_lines", "line_length",
)

# Character classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 pipe, 7 marks, 8 stop, 9 bang, 10 comma
_CLASS = np.zeros(0x250, np.uint8)
for _i in range(0x250):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c == "|" else 7 if _c in "#$%&*@^~<>{}[]\\=+_/" else 8 if _c in ".?" else 9 if _c == "!" else 10 if _c in ",;:" else 0


def statistics(text: str | None) -> list[float]:
    """FEATURES of one text; null and empty texts give zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.bincount(_CLASS[np.minimum(code, 0x24F)], minlength=11) / len(code)
    words = text.split()
    n = len(words) or 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(code)), np.log1p(len(words)), sizes.sum() / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n, (sizes <= 3).sum() / n, (sizes >= 12).sum() / n,
        *kind[1:11], kind[0], (code > 0x24F).mean(), len(set(lines)) / (len(lines) or 1), np.log1p(len(code) / (len(lines) or 1)),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))


class Trees:
    """Boosted trees for a 0/1 label, flattened."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.roots: list[int] = []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def _node(self) -> int:
        for part, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part.append(empty)
        return len(self.feature) - 1

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 8) -> Trees:
        """One class only, or no rows: no tree is grown and the base rate stands."""
        if not len(y):
            return self.flat()
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self.flat()
        d = x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) + np.arange(d) * bins
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q)
            root = self._node()
            self.roots.append(root)
            open_nodes = [(root, np.arange(len(y)), 0)]
            while open_nodes:
                node, rows, level = open_nodes.pop()
                best = self._split(binned[rows], g[rows], h[rows], d, bins, l2, least) if level < depth and len(rows) >= 2 * least else None
                if best is None or best[1] >= len(edges[best[0]]):
                    value = -rate * g[rows].sum() / (h[rows].sum() + l2)
                    self.value[node] = value
                    f[rows] += value
                    continue
                j, b = best
                self.feature[node], self.threshold[node] = j, float(edges[j][b])
                left = binned[rows, j] - j * bins <= b
                self.left[node], self.right[node] = self._node(), self._node()
                open_nodes += [(self.left[node], rows[left], level + 1), (self.right[node], rows[~left], level + 1)]
        return self.flat()

    @staticmethod
    def _split(binned, g, h, d, bins, l2, least):
        flat = binned.ravel()
        hist = [np.bincount(flat, np.repeat(v, d), d * bins).reshape(d, bins).cumsum(1) for v in (g, h, np.ones(len(g)))]
        gl, hl, nl = hist
        gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(nl < least) | (nt - nl < least)] = -1
        at = int(gain.argmax())
        return divmod(at, bins) if gain.flat[at] > 1e-6 else None

    def flat(self) -> Trees:
        self.feature, self.left, self.right = (np.array(a, np.int32) for a in (self.feature, self.left, self.right))
        self.threshold, self.value = np.array(self.threshold, float), np.array(self.value, float)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; every row walks a level of a tree in the same numpy step."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                j = self.feature[node]
                inner = j >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(j, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            f += self.value[node]
        return 1 / (1 + np.exp(-f))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("y")], ["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees on the statistics of the labelled rows; texts are measured where they lie and never reach the driver."""
    rows = labelled(docs, labels, "quality", TRAINING_ROWS).mapInArrow(_measured, "doc_id long, x array<double>, y int").orderBy("doc_id").toPandas()
    return Trees().fit(np.array(rows.x.tolist(), float).reshape(len(rows), len(FEATURES)), rows.y.to_numpy(float))


def scorer(trees: Trees):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(trees.predict(matrix(s.tolist())), dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_quality, keep) for every row of docs that has a doc_id.

    Null and empty texts have statistics of 0 and are scored like any other. Repeated rows are
    scored alike. Empty tables give no rows. Null labels and labels other than 0 and 1 are ignored;
    with no labels, or a single class, every document gets the base rate (0.5 without labels, so all
    are kept). A score equal to the threshold is kept. Other columns are never read.
    """
    score = scorer(train(docs, labels))
    return id_text(docs).select("doc_id", score("text").alias("p_quality")).withColumn("keep", F.col("p_quality") >= threshold)


def with_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, that quality() keeps; rows without doc_id go."""
    score = scorer(train(docs, labels))
    return docs.where(F.col("doc_id").isNotNull() & (score(F.col("text").cast("string")) >= threshold))
