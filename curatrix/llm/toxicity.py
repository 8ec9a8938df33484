"""Toxicity by weak supervision.

Sixteen voters (lexicon groups and patterns) look at every document. A generative label model is
fitted to the counts of all vote patterns: each voter's firing rates in either class and, within a
class, its correlations with the others, which discount voters that repeat each other. A linear
classifier over hashed words and word stems is then trained on the posterior labels and decides.

Lexicons: SEED_WORDS are English. For other languages stems are induced from labelled rows: word
beginnings that occur nearly only in documents labelled toxic. Without labels the seeds stand alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import MEMO, id_text, sliced, words_of

SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "disgusting", "loser", "clown")
#: Labelled rows, by smallest hash of doc_id, from which stems are induced.
LABELLED_ROWS = 10_000
#: Documents, by smallest hash of doc_id, on whose posterior labels the linear classifier is trained.
TRAINING_ROWS = 20_000
BITS = 18
VOTERS = (
    *(f"seed_{i}" for i in range(5)),
    *(f"stem_{i}" for i in range(4)),
    "any_hit", "two_hits", "four_hits", "two_kinds", "dense", "two_lines", "close_hits",
)
STEM = range(3, 9)


def stems_in(text: str | None) -> set[str]:
    """Beginnings of STEM lengths of a text's distinct words."""
    return {w[:n] for w in set(words_of(text)) for n in STEM if len(w) >= n}


def good_stems(counts: Iterable[tuple[str, int, int]], least: int, precision: float) -> list[str]:
    """Of (stem, toxic documents, other documents), those with enough of the former and nearly none of the latter, best first."""
    good = [(-hit, miss, len(s), s) for s, hit, miss in counts if hit >= least and hit >= precision * (hit + miss) and not s.isdigit()]
    return [x[-1] for x in sorted(good)]


def chosen_stems(good: list[str], found: list[list[int]], least: int, most: int) -> list[str]:
    """A stem must gain documents over the stems chosen before; found[i]: the toxic documents of good[i]."""
    chosen: list[str] = []
    covered: Counter = Counter()
    for s, where in zip(good, found, strict=True):
        if len(chosen) >= most:
            break
        if any(s.startswith(c) for c in chosen):
            continue
        if sum(covered[i] < 3 for i in where) >= max(3, least // 2):
            chosen.append(s)
            covered.update(where)
    return chosen


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2_000):
        hit, miss = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            (hit if y else miss).update(stems_in(text))
        stems = [*hit, *(s for s in miss if s not in hit)]
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([hit[s] for s in stems], pa.int64()), pa.array([miss[s] for s in stems], pa.int64())], ["stem", "hit", "miss"])


def induced_stems(rows: DataFrame, least: int = 6, precision: float = 0.95, most: int = 400) -> list[str]:
    """Shortest word beginnings found in at least `least` toxic documents and nearly no other ones; rows: (text, y)."""
    counts = rows.mapInArrow(_stem_counts, "stem string, hit long, miss long").groupBy("stem").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    kept = counts.where((F.col("hit") >= least) & (F.col("hit") >= precision * (F.col("hit") + F.col("miss"))))
    good = good_stems(((r.stem, r.hit, r.miss) for r in kept.toLocalIterator()), least, precision)
    place = {s: i for i, s in enumerate(good)}

    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([sorted(place[x] for x in stems_in(t) if x in place) for t in s])

    found: list[list[int]] = [[] for _ in good]
    bad = rows.where("y = 1").orderBy("doc_id").select(F.pandas_udf(holds, "array<int>")("text").alias("at"))
    for i, row in enumerate(bad.toLocalIterator()):
        for j in row.at:
            found[j].append(i)
    return chosen_stems(good, found, least, most)


class Voters:
    """Votes of one document as a bit mask; bit j is VOTERS[j]."""

    def __init__(self, words: tuple[str, ...], stems: list[str]):
        self.group = {w: i % 5 for i, w in enumerate(words)}
        stems = [s for s in stems if not any(w.startswith(s) for w in words)]
        self.stem_group = {s: 5 + xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % 4 for s in stems}
        sides = [rf"(?:{'|'.join(map(re.escape, words))})\b"] if words else []
        if stems:
            sides.append(rf"(?:{'|'.join(map(re.escape, sorted(stems, key=len, reverse=True)))})\w*")
        self.pattern = re.compile(rf"\b(?:{'|'.join(sides)})") if sides else None

    def mask(self, text: str | None) -> int:
        if not text or self.pattern is None:
            return 0
        low = text.lower()
        hits = [(m.start(), m.group()) for m in self.pattern.finditer(low)]
        if not hits:
            return 0
        mask, kinds = 1 << 9, set()
        for _, word in hits:
            g = self.group.get(word)
            if g is None:
                stem = next((word[:n] for n in reversed(STEM) if word[:n] in self.stem_group), None)
                g, kind = (self.stem_group[stem], word) if stem else (5, word)
            else:
                kind = word
            kinds.add(kind)
            mask |= 1 << g
        at = [p for p, _ in hits]
        tests = (len(hits) >= 2, len(hits) >= 4, len(kinds) >= 2, len(hits) * 400 >= len(text), any("\n" in low[a:b] for a, b in zip(at, at[1:])), any(b - a <= 200 for a, b in zip(at, at[1:])))
        for j, yes in enumerate(tests):
            mask |= yes << (10 + j)
        return mask


class LabelModel:
    """Two classes, a firing rate per voter and class, weights from within-class correlation."""

    def __init__(self, prior: float = 0.1):
        m = len(VOTERS)
        self.prior, self.rate, self.weight = prior, np.array([np.full(m, 0.02), np.full(m, 0.4)]), np.ones(m)
        self.correlation = np.zeros((2, m, m))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.log(self.prior / (1 - self.prior))
        for c, sign in ((1, 1), (0, -1)):
            r = self.rate[c]
            logit = logit + sign * (self.weight * (votes * np.log(r) + (1 - votes) * np.log1p(-r))).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def fit(self, masks: np.ndarray, counts: np.ndarray, rounds: int = 40) -> LabelModel:
        """Expectation-maximisation over vote patterns with counts. No patterns leave the prior model."""
        votes = ((masks[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
        total = counts.sum()
        if not total:
            return self
        for _ in range(rounds):
            p = self.posterior(votes)
            shared = np.zeros(votes.shape[1])
            for c, q in ((0, 1 - p), (1, p)):
                w = counts * q
                n = w.sum() + 2.0
                self.rate[c] = np.clip(((w[:, None] * votes).sum(0) + (0.02, 0.8)[c]) / n, 1e-6, 1 - 1e-6)
                x = votes - self.rate[c]
                cov = (w[:, None] * x).T @ x / n
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                self.correlation[c] = cov / np.outer(sd, sd)
                mine = np.abs(self.correlation[c]) * (np.diag(cov) > 1e-6)[:, None]
                shared += 0.5 * (mine.sum(1) - np.diag(mine))
            self.prior = float(np.clip((counts * p).sum() / total, 1e-4, 0.5))
            self.weight = 1 / (1 + shared)
        return self


def word_ids(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its five-letter beginning."""
    return tuple(xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) >> (32 - BITS) for s in ([word] if len(word) <= 5 else [word, word[:5] + "+"]))


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's distinct words, one entry for each word that falls there."""
    return np.array([i for w in set(words_of(text)) for i in word_ids(w)], np.int32)


def flat_rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all entries."""
    return np.concatenate([*rows, np.empty(0, np.int32)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


class Weights(dict):
    """A word's weight, worked out once while it stays in the store."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = {int(i): float(w[i]) for i in np.flatnonzero(w)}

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = sum(self.w.get(i, 0.0) for i in word_ids(word))
        return value


class Linear:
    """Logistic regression over hashed features of a text's distinct words, trained on soft labels."""

    def __init__(self, w: np.ndarray | None = None, b: float = -4.0):
        self.w, self.b = (np.zeros(1 << BITS, np.float32) if w is None else w), b

    def fit(self, rows: list[np.ndarray], p: np.ndarray, rounds: int = 400, l2: float = 1e-5, least_z: float = 6.0) -> Linear:
        """rows: features() of each text. Features whose association with p is below least_z standard errors keep weight 0."""
        n, a = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for i in range(0, len(rows), 500):
            idx, doc = flat_rows(rows[i : i + 500])
            n += np.bincount(idx, minlength=1 << BITS)
            a += np.bincount(idx, p[i + doc], 1 << BITS)
        if not n.any():
            return self
        m = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
        z = (a - n * m) / np.sqrt(np.maximum(n, 1) * m * (1 - m))
        keep = (np.abs(z) >= least_z) & (n >= 4)
        idx, doc = flat_rows([r[keep[r]] for r in rows])
        used, idx = np.unique(idx, return_inverse=True)
        w, b = np.zeros(len(used) + 1), self.b
        first, second = np.zeros(len(w)), np.zeros(len(w))
        w[-1] = b
        for t in range(1, rounds + 1):
            e = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[idx], len(rows)) + w[-1], -60, 60))) - p
            g = np.append(np.bincount(idx, e[doc], len(used)), e.sum()) / len(rows)
            g[:-1] += l2 * w[:-1]
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        self.w[used] = w[:-1]
        self.b = float(w[-1])
        return self

    def score(self, texts: list[str | None], memo: Weights) -> np.ndarray:
        z = np.fromiter((sum(map(memo.__getitem__, set(words_of(t))), self.b) for t in texts), float, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _smallest(docs: DataFrame, n: int) -> DataFrame:
    return docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def labelled(docs: DataFrame, labels: DataFrame, column: str, n: int) -> DataFrame:
    """(doc_id, text, y) of at most n labelled documents, those whose doc_id hashes lowest; y is 0 or 1."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = _smallest(rows.groupBy("doc_id").agg(F.max("y").alias("y")), n)
    return id_text(docs).where("text is not null").join(F.broadcast(rows), "doc_id")


def _training(voters: Voters):
    """(mask, entries) of each text: its votes and its features; only these reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([voters.mask(t) for t in texts], pa.int32()), pa.array([features(t).tobytes() for t in texts], pa.binary())], ["doc_id", "mask", "entries"])

    return run


def train(docs: DataFrame, labels: DataFrame | None, words: tuple[str, ...] = SEED_WORDS) -> tuple[Voters, LabelModel, Linear]:
    voters = Voters(words, [] if labels is None else induced_stems(labelled(docs, labels, "toxic", LABELLED_ROWS)))
    texts = id_text(docs)

    def masks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([voters.mask(t) for t in s], dtype="int32")

    # At most 2 ** 16 patterns, whatever the input; counts cover every document.
    vote = F.pandas_udf(masks, "int")
    patterns = texts.select(vote("text").alias("m")).groupBy("m").count().toPandas()
    model = LabelModel().fit(patterns.m.to_numpy(np.int64), patterns["count"].to_numpy(float))
    sample = _smallest(texts.where("text is not null").select("doc_id"), TRAINING_ROWS)
    sample = texts.where("text is not null").join(F.broadcast(sample.distinct()), "doc_id", "left_semi")
    got = sample.mapInArrow(_training(voters), "doc_id long, mask int, entries binary").orderBy("doc_id").select("mask", "entries").toPandas()
    votes = ((got["mask"].to_numpy(np.int64)[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    return voters, model, Linear().fit([np.frombuffer(e, np.int32) for e in got.entries], model.posterior(votes) if len(votes) else np.empty(0))


def scorer(linear: Linear):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Weights(linear.w)
        for s in batches:
            yield pd.Series(linear.score(s.tolist(), memo), dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def toxicity(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.4) -> DataFrame:
    """(doc_id, p_toxic, toxic) for every row of docs that has a doc_id.

    Null and empty texts, and texts without a word, score about 0 and are not toxic. Repeated rows
    are scored alike, once each. Empty tables give no rows. Null labels and labels other than 0 and 1
    are ignored; without labels, or with labels=None, only the seed words and what the classifier
    learns from them count. A score equal to the threshold is toxic. Only doc_id, text and the
    labels' doc_id and toxic are read, so other columns can have any name.
    """
    _, _, linear = train(docs, labels)
    score = scorer(linear)
    return id_text(docs).select("doc_id", score("text").alias("p_toxic")).withColumn("toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.4) -> DataFrame:
    """The rows of docs, all columns kept, that toxicity() does not reject; rows without doc_id go."""
    _, _, linear = train(docs, labels)
    score = scorer(linear)
    return docs.where(F.col("doc_id").isNotNull() & (score(F.col("text").cast("string")) < threshold))
