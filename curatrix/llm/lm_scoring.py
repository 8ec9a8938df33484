"""Language-model scoring: a hashed maximum-entropy model under counts of all n-grams of the documents.

The base of the next word's probability is p(class | context) * p(place | class, context) * p(word | place).
The first two factors are softmax models over three hashed context features: the last word, the last
two words, and the word before the last (a skip), plus a bias. Frequent words have places of their own,
ordered by frequency and cut into classes of equal size; all other words share the places of the last
class by hash, and their last factor is the word's share of all words there. A word that occurs nowhere
else has the share of the words seen once, times its spelling by pairs of characters, so an invented
word costs by its letters. The softmax tables have a fixed size; the vocabulary and all that is learned
of n-grams beyond the tables is in counts that grow with the documents.

On the base stand the counts of all words, skip pairs, pairs and triples of the documents, each level
smoothed by the one before: (count + SMOOTH * lower) / (count of the context + SMOOTH). Every count leaves
out the occurrence that is being scored, so a text is predicted from all others; what occurs in one text
alone is unseen, and copies predict each other. The counts are partitioned by hash. Each run of documents
asks the partitions for its own distinct n-grams (32 bits each within a partition, sent as packed
differences) and gets their counts back; no table of counts is ever in one place.

Training passes over all documents once, in ROUNDS shares by hash of doc_id. In a round every task
starts from the broadcast model and makes Adagrad updates on its documents; it emits its change of
the weights in blocks, with the number of positions that touched each row, and the blocks are summed
with these weights. Scoring runs the final model over all documents in numpy batches that gather only
the weight rows of the features present.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import code_points, hashed_words, id_text, mixed_bits, runs_of, text_runs
from curatrix.session import dropped, shuffles_freed, stored

CLASSES, WIDTH = 16, 32
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 14
FEATURES = 3
ROUNDS, RATE, STEP = 2, 0.3, 8_192
#: Sums of weights between -SAFE and SAFE need no shift before exp in 32 bits.
SAFE = 80.0
#: Rows that are summed one after the other; longer lists of rows are summed in pieces of so many.
SPAN = 16
#: Rows of a weight table in a block of the exchange.
BLOCK = 1_024
PLACES = CLASSES * WIDTH
#: Weight of the lower level against the counts of a context.
SMOOTH = 2.0
#: Words of a run of documents that asks for its counts together, and of a partition of the counts, on average.
RUN, PART = 800_000, 1_000_000
#: Bits of an n-gram's hash within its partition: of the some 2 million there, 0.05 % share theirs with another.
BITS = 32
#: Kinds of n-grams, in the order of the levels.
SINGLE, SKIP, PAIR, TRIPLE = range(4)
#: Classes of characters that words are spelled with: letters a to z, digits, 36 of others by hash; 0 is outside a word.
CHARS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _chars() -> np.ndarray:
    """The class of each code point."""
    code = np.arange(0x110000)
    inside = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), np.bool_, 0x110000)
    kind = np.where((code >= 97) & (code <= 122), code - 96, np.where((code >= 48) & (code <= 57), 27, 28 + code % 36))
    return np.where(inside, kind, 0).astype(np.uint8)


def _pairs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: (pairs of character classes, word starts, word ends); pair i is characters i - 1 and i."""
    for pieces, _ in runs_of([t.lower() if t else None for t in texts]):
        code, _ = code_points(["", *pieces])
        kind = _chars()[code]
        inside = kind > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        yield np.append(np.uint16(0), kind[:-1].astype(np.uint16) * CHARS + kind[1:]), edge[::2], edge[1::2]


def spelled_pairs(texts: list[str | None]) -> np.ndarray:
    """How often each pair of character classes occurs in words, their first and last characters against 0."""
    out = np.zeros(CHARS * CHARS, np.int64)
    for pair, _, _ in _pairs(texts):
        out += np.bincount(pair, minlength=CHARS * CHARS)
    out[0] = 0
    return out


def spelling(counts: np.ndarray) -> np.ndarray:
    """ln p(character | last character) of each pair."""
    n = counts.reshape(CHARS, CHARS) + 0.05
    return np.log(n / n.sum(1, keepdims=True)).ravel()


def spelled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """ln of each word's probability by its characters and its end."""
    out = []
    for pair, start, end in _pairs(texts):
        total = np.cumsum(table[pair])
        out.append(total[end] - total[start - 1])
    return np.concatenate(out) if out else np.empty(0)


class Places:
    """Places (class * WIDTH + position) of hashed words: their own for frequent words, shared by hash in the last class for others."""

    def __init__(self, frequent: list[int]):
        hashes = np.array(frequent, np.int64).view(np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def of(self, h: np.ndarray) -> np.ndarray:
        other = (CLASSES - 1) * WIDTH + ((h >> np.uint64(40)) % np.uint64(WIDTH)).astype(np.int64)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], other)


def positions(texts: list[str | None], places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, context hashes of shape (FEATURES, n), word hashes, words of each text); contexts don't cross texts."""
    word, sizes = hashed_words(texts)
    n = len(word)
    context = np.zeros((FEATURES, n), np.uint64)
    if n:
        with np.errstate(over="ignore"):
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            last, before = np.empty_like(word), np.empty_like(word)
            last[1:], before[2:] = word[:-1], word[:-2]
            last[starts] = before[starts] = 1
            second = starts[starts + 1 < np.append(starts[1:], n)] + 1
            before[second] = 2
            context[0] = mixed_bits(last, 3)
            context[1] = mixed_bits(last * _STEP + before, 5)
            context[2] = mixed_bits(before, 7)
    return places.of(word), context, word, sizes


def grams(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether there is one), each of shape (4, n): the n-grams that end at each word, none across texts."""
    n = len(word)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key, there = np.zeros((4, n), np.uint64), np.empty((4, n), np.bool_)
    there[SINGLE], there[PAIR] = True, at >= 1
    there[SKIP] = there[TRIPLE] = at >= 2
    with np.errstate(over="ignore"):
        key[SINGLE] = mixed_bits(word, 21)
        key[SKIP, 2:] = mixed_bits(word[:-2] * _STEP + word[2:], 23)
        key[PAIR, 1:] = mixed_bits(word[:-1] * _STEP + word[1:], 25)
        key[TRIPLE, 2:] = mixed_bits((word[:-2] * _STEP + word[1:-1]) * _STEP + word[2:], 27)
    return key, there


def row_max(z: np.ndarray) -> np.ndarray:
    """z.max(1) of a width that is a power of two, by halving: each step runs over long rows."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z[:, 0]


def listed_sums(x: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Row i is the sum of the next count[i] (one at least) of the rows of x that at lists.

    Ordered by size, the lists with a j-th member come first, so each step adds whole rows to a leading part.
    Lists beyond SPAN are summed in pieces, then the pieces one by one.
    """
    pieces = -(-count // SPAN)
    last = np.cumsum(pieces) - 1
    sizes = np.full(pieces.sum(), SPAN)
    sizes[last] = count - (pieces - 1) * SPAN
    by = np.argsort((SPAN - sizes).astype(np.uint8), kind="stable")
    start = (np.cumsum(sizes) - sizes)[by]
    total = x.take(at[start], 0)
    longer = len(sizes) - np.cumsum(np.bincount(sizes, minlength=SPAN + 1))
    for j, m in enumerate(longer[1:SPAN].tolist(), 1):
        total[:m] += x.take(at[start[:m] + j], 0)
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    more = np.flatnonzero(pieces > 1)
    if not len(more):
        return total.take(place, 0)
    out = total.take(place[last], 0)
    out[more] = np.add.reduceat(total.take(place[np.repeat(pieces > 1, pieces)], 0), np.cumsum(pieces[more]) - pieces[more], 0)
    return out


def row_sums(rows: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows used, how often, sum of g over the positions that use each); rows: (features, n), g: (n, width)."""
    flat = rows.ravel()
    n = np.bincount(flat, minlength=size)
    used = np.flatnonzero(n)
    order = np.argsort(flat.astype(np.min_scalar_type(size - 1)), kind="stable")  # numbers of 16 bits are sorted by digits
    return used, n[used].astype(np.float32), listed_sums(g, order % max(1, len(g)), n[used])


class Model:
    """Weights of both factors; row 0 of either table is the bias (for words, rows 0 to CLASSES - 1)."""

    def __init__(self, class_w: np.ndarray | None = None, word_w: np.ndarray | None = None):
        self.tables = [np.zeros((CLASS_ROWS, CLASSES), np.float32) if class_w is None else class_w, np.zeros((WORD_ROWS, WIDTH), np.float32) if word_w is None else word_w]

    @staticmethod
    def rows(target: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight rows (FEATURES + 1, n) of the class factor and of the word factor, the latter given the class."""
        n = len(target)
        c = np.zeros((FEATURES + 1, n), np.int64)
        w = np.empty((FEATURES + 1, n), np.int64)
        c[1:] = 1 + context % np.uint64(CLASS_ROWS - 1)
        w[0] = target // WIDTH
        with np.errstate(over="ignore"):
            given = context * np.uint64(0x9E3779B97F4A7C15) + (target // WIDTH + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        w[1:] = CLASSES + (given >> np.uint64(20)) % np.uint64(WORD_ROWS - CLASSES)
        return c, w

    @staticmethod
    def weights(table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the outcomes at each position, their sums), which a softmax divides by."""
        z = table.take(rows[0], 0)
        for r in rows[1:]:
            z += table.take(r, 0)
        if not (-SAFE < z.min(initial=0) and z.max(initial=0) < SAFE):
            z -= row_max(z)[:, None]
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], np.float32)

    @classmethod
    def softmax(cls, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        z, total = cls.weights(table, rows)
        z *= (1 / total)[:, None]
        return z

    def log_places(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for a in range(0, len(target), STEP):
            t, x = target[a : a + STEP], context[:, a : a + STEP]
            i = np.arange(len(t))
            out[a : a + STEP] = 0
            for table, rows, y in zip(self.tables, self.rows(t, x), (t // WIDTH, t % WIDTH), strict=True):
                z, total = self.weights(table, rows)
                out[a : a + STEP] += np.log(z[i, y] / total.astype(float))
        return out


class Trainer:
    """Adagrad from a start model, keeping which rows were touched how often."""

    def __init__(self, start: Model):
        self.start = start
        self.model = Model(*(t.copy() for t in start.tables))
        self.squares = [np.full(t.shape[0], 1e-3, np.float32) for t in self.model.tables]
        self.touched = [np.zeros(t.shape[0], np.float32) for t in self.model.tables]

    def update(self, target: np.ndarray, context: np.ndarray) -> None:
        for a in range(0, len(target), STEP):
            t, x = target[a : a + STEP], context[:, a : a + STEP]
            i = np.arange(len(t))
            for f, (table, rows, y) in enumerate(zip(self.model.tables, self.model.rows(t, x), (t // WIDTH, t % WIDTH), strict=True)):
                g = self.model.softmax(table, rows)
                g[i, y] -= 1
                used, n, total = row_sums(rows, g, len(table))
                # Mean gradient of a row: its size doesn't grow with how often the row occurs in a step.
                total *= (1 / n)[:, None]
                squares = self.squares[f][used] + np.einsum("ij,ij->i", total, total) / total.shape[1]
                self.squares[f][used] = squares
                total *= (-RATE / np.sqrt(squares))[:, None]
                total += table.take(used, 0)
                table[used] = total
                self.touched[f][used] += n

    def change(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(table, block, touch counts, touch counts times change) of blocks with a touched row."""
        for f, (new, old, n) in enumerate(zip(self.model.tables, self.start.tables, self.touched, strict=True)):
            for b in range(0, len(n), BLOCK):
                part = n[b : b + BLOCK]
                if part.any():
                    yield f, b // BLOCK, part.tobytes(), ((new[b : b + BLOCK] - old[b : b + BLOCK]) * part[:, None]).tobytes()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, w, n): 0 with the hash and occurrences of each word of a run, 1 with each pair of characters and the task's occurrences."""
    spelled_ = np.zeros(CHARS * CHARS, np.int64)
    for batch in batches:
        for _, part in text_runs(batch.column(0)):
            w, n = np.unique(hashed_words(part)[0], return_counts=True)
            spelled_ += spelled_pairs(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(w), np.int32)), pa.array(w.view(np.int64)), pa.array(n)], ["kind", "w", "n"])
    used = np.flatnonzero(spelled_)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(spelled_[used])], ["kind", "w", "n"])


def _train(model, frequent: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, trainer = Places(frequent), Trainer(Model(*model.value))
        for batch in batches:
            for _, part in text_runs(batch.column(0)):
                target, context, _, _ = positions(part, places)
                trainer.update(target, context)
        for f, b, n, change in trainer.change():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((f, pa.int32()), (b, pa.int32()), (n, pa.binary()), (change, pa.binary()))], ["f", "b", "n", "change"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    n = np.sum([np.frombuffer(x, np.float32) for x in pdf.n], 0, dtype=np.float64)
    change = np.sum([np.frombuffer(x, np.float32) for x in pdf.change], 0, dtype=np.float64).reshape(len(n), -1)
    mean = (change / np.maximum(n, 1)[:, None]).astype(np.float32)
    return pd.DataFrame({"f": pdf.f.iloc[:1], "b": pdf.b.iloc[:1], "mean": [mean.tobytes()]})


def _packed(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers by rank: how many of the lowest ranks are left as they are, the others compressed, then those.

    Ranks below the size of the mean are as good as random: compressing them costs time and saves nothing.
    """
    ranks = np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    mean = x.mean(dtype=float) if len(x) else 0.0
    plain = sum(mean >= 256.0**k for k in (1, 2, 3))
    return bytes([plain]) + zlib.compress(ranks[plain:].tobytes(), 1) + ranks[:plain].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    unzip = zlib.decompressobj()
    high = unzip.decompress(data[1:])
    return np.ascontiguousarray(np.frombuffer(unzip.unused_data + high, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _filed(key: np.ndarray, parts: int) -> np.ndarray:
    """partition << 32 | BITS of hash."""
    return ((key >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (key & np.uint64((1 << BITS) - 1))


def distinct_grams(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(filed keys, sorted, distinct; where each given one is among them). Keys are sorted together with their places, as many at once as places fit beside a key in 64 bits."""
    flat = _filed(key, parts)
    found, where = [], np.empty(len(flat), np.int64)
    bits = np.uint64(64 - (32 + parts.bit_length()))
    most = 1 << int(bits)
    for a in range(0, max(1, len(flat)), most):
        part = flat[a : a + most]
        line = np.sort(part << bits | np.arange(len(part), dtype=np.uint64))
        at, value = (line & np.uint64(most - 1)).astype(np.int64), line >> bits
        first = np.append(True, value[1:] != value[:-1])[: len(value)]
        found.append(value[first])
        where[a + at] = np.cumsum(first) - 1
    if len(found) == 1:
        return found[0], where
    line = np.sort(np.concatenate(found))
    asked = line[np.append(True, line[1:] != line[:-1])]  # np.unique of values alone goes through a hash table, several times slower
    for a, part in zip(range(0, len(flat), most), found, strict=True):
        where[a : a + most] = np.searchsorted(asked, part)[where[a : a + most]]
    return asked, where


def counted_grams(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(filed keys, sorted, distinct; how often each occurs). Sorting values is several times faster than sorting places."""
    return np.unique(_filed(key, parts), return_counts=True)


def summed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key the sum of the counts of all that are equal to it; keys of 32 bits are sorted together with their places."""
    line = np.sort((keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64))
    at, key = (line & np.uint64(0xFFFFFFFF)).astype(np.int64), line >> np.uint64(32)
    first = np.append(True, key[1:] != key[:-1])[: len(keys)]
    out = np.empty(len(keys), np.uint32)
    out[at] = np.add.reduceat(counts[at].astype(np.int64), np.flatnonzero(first))[np.cumsum(first) - 1] if len(keys) else 0
    return out


def _requests(run: int, asked: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """A row for each partition asked: the sorted keys as differences, and their counts in the run."""
    part = asked >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
    pieces = list(zip(cuts, cuts[1:], strict=False))
    low = asked.astype(np.uint32)
    return pd.DataFrame({"part": [int(part[a]) for a, _ in pieces], "run": np.full(len(pieces), run, np.int64), "keys": [_packed(np.diff(low[a:b], prepend=np.uint32(0))) for a, b in pieces], "counts": [_packed(count[a:b]) for a, b in pieces]})


def _ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[str | None]]:
    pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
    return pdf, [t if isinstance(t, str) else None for t in pdf.text]


def _ask(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, texts = _ordered(pdf)
        key, there = grams(*hashed_words(texts))
        asked, count = counted_grams(key[there], parts)
        return _requests(int(pdf.run.iloc[0]), asked, count)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each run, for the keys it asked for in turn, their counts in all runs."""
    asked = [np.cumsum(_unpacked(k), dtype=np.uint32) for k in pdf["keys"]]
    total = summed(np.concatenate(asked), np.concatenate([_unpacked(c) for c in pdf["counts"]]))
    ends = np.cumsum([0, *map(len, asked)])
    return pd.DataFrame({"run": pdf.run, "part": pdf.part, "answer": [_packed(total[a:b]) for a, b in zip(ends, ends[1:], strict=False)]})


class Shares:
    """Of the places of the last class: occurrences, and words seen once (at least one), which is the share of unseen words."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.total, self.once = np.zeros(WIDTH), np.ones(WIDTH)
        for place, total, once in rows:
            self.total[place], self.once[place] = total, max(1, once)


def chain(place: np.ndarray, place_p: np.ndarray, ln_spelled: np.ndarray, counts: np.ndarray, there: np.ndarray, shares: Shares) -> np.ndarray:
    """Probability of each word given those before it, from the other occurrences; counts: (4, n) of its n-grams, itself included."""
    others = np.maximum(counts.astype(float) - 1, 0)
    i = np.maximum(place - (CLASSES - 1) * WIDTH, 0)
    share = np.where(others[SINGLE] > 0, others[SINGLE], shares.once[i] * np.exp(np.maximum(ln_spelled, -600))) / (shares.total[i] + shares.once[i])
    p = place_p * np.where(place < (CLASSES - 1) * WIDTH, 1.0, share)
    before = np.zeros_like(others)
    # How often the context occurs elsewhere: the n-gram that ended one or two words ago.
    before[SKIP, 2:], before[PAIR, 1:], before[TRIPLE, 1:] = others[SINGLE, :-2], others[SINGLE, :-1], others[PAIR, :-1]
    for level in (SKIP, PAIR, TRIPLE):
        total = np.maximum(before[level], others[level])
        p = np.where(there[level], (others[level] + SMOOTH * p) / (total + SMOOTH), p)
    return p


def _score(model, frequent: list[int], parts: int, shares: Shares, table: np.ndarray):
    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        final = Model(*model.value)
        pdf, texts = _ordered(pdf)
        place, context, word, sizes = positions(texts, Places(frequent))
        log_p = np.zeros(len(sizes))
        if len(word):
            key, there = grams(word, sizes)
            _, where = distinct_grams(key[there], parts)
            counts = np.zeros(key.shape, np.int64)
            counts[there] = np.concatenate([_unpacked(a) for a in answers.sort_values("part").answer])[where]
            p = chain(place, np.exp(final.log_places(place, context)), spelled(texts, table), counts, there, shares)
            total = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(p, 1e-300)))])
            ends = np.cumsum(sizes)
            log_p = total[ends] - total[ends - sizes]
        bits = np.divide(-log_p, sizes * np.log(2), out=np.zeros(len(sizes)), where=sizes > 0)
        return pd.DataFrame({"doc_id": pdf.doc_id.to_numpy(), "n_words": sizes, "log_p": np.round(log_p, 6), "bits_per_word": pd.arrays.FloatingArray(np.round(bits, 6), sizes == 0)})

    return run


_ASK, _TOLD = "part long, run long, keys binary, counts binary", "run long, part long, answer binary"


def counted(texts: DataFrame) -> tuple[list[int], int, Shares, np.ndarray]:
    """(hashes of the most frequent words, as many as have places, equal counts by hash; words in all; shares of the other places; spelling)."""
    counts = stored(texts.select("text").mapInArrow(_count, "kind int, w long, n long").groupBy("kind", "w").agg(F.sum("n").alias("n")), "words")
    words = counts.where("kind = 0").select("w", "n")
    frequent = [r.w for r in words.orderBy(F.desc("n"), "w").limit((CLASSES - 1) * WIDTH).collect()]
    total = words.agg(F.sum("n")).first()[0] or 0
    place = F.expr(f"shiftrightunsigned(w, 40) % {WIDTH}").alias("place")
    others = words.where(~F.col("w").isin(frequent)).groupBy(place).agg(F.sum("n"), F.sum((F.col("n") == 1).cast("long"))).collect()
    pairs = np.zeros(CHARS * CHARS)
    for r in counts.where("kind = 1").collect():  # CHARS * CHARS rows at most
        pairs[r.w] = r.n
    dropped(counts)
    return frequent, total, Shares([tuple(r) for r in others]), spelling(pairs)


def train(texts: DataFrame, frequent: list[int], rounds: int = ROUNDS) -> Model:
    context = texts.sparkSession.sparkContext
    model = Model()
    for r in range(rounds):
        share = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        # The softmax tables have a fixed size, 2.5 MB, so broadcasting and collecting it doesn't grow with the input.
        changes = share.mapInArrow(_train(context.broadcast(tuple(model.tables)), frequent), "f int, b int, n binary, change binary")
        for row in changes.groupBy("f", "b").applyInPandas(_sum, "f int, b int, mean binary").collect():
            block = model.tables[row.f][row.b * BLOCK : (row.b + 1) * BLOCK]
            block += np.frombuffer(row.mean, np.float32).reshape(block.shape)
    return model


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, log_p, bits_per_word) for every row that has a doc_id, by a model of docs itself.

    log_p: natural logarithm of the document's probability, word by word, each word predicted from all its
    other occurrences in docs; the end of a text isn't counted. Null and empty texts and texts without a
    word have 0 words, log_p 0 and null bits_per_word. Repeated rows are trained on and scored once each,
    and predict each other. Empty tables give no rows. Only doc_id and text are read.
    """
    texts = id_text(docs)
    with shuffles_freed(docs.sparkSession):
        frequent, words, shares, table = counted(texts)
        model = train(texts, frequent, rounds)
        parts = max(1, -(-words // PART))
        runs = texts.withColumn("run", F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(max(1, -(-words // RUN)))))
        asked = runs.groupBy("run").applyInPandas(_ask(parts), _ASK)
        answers = stored(asked.groupBy("part").applyInPandas(_answer, _TOLD), "answers")
    final = docs.sparkSession.sparkContext.broadcast(tuple(model.tables))
    score = _score(final, frequent, parts, shares, table)
    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(score, "doc_id long, n_words long, log_p double, bits_per_word double")
