"""What the operators of this subpackage share: words, hashes, tables, size-checked joins."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: A side of a join is broadcast up to so many ids (about 32 MB as a hash table); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Word hashes that a worker keeps; the store is emptied when it is full.
MEMO = 150_000


class Memo(dict):
    """A word's 64-bit hash, computed once while it stays in the store."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in small runs of rows, so that no more texts at once are Python objects; an empty batch stays one."""
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(i, rows)


#: Characters that are hashed in one numpy pass, about; a longer text is cut at white space.
LONG = 1 << 19
_SPACE = re.compile(r"\s")


@functools.cache
def _word_chars() -> np.ndarray:
    r"""Whether each code point belongs to a word, as \w has it."""
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), np.bool_, 0x110000)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))


def mixed_bits(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def piece_hashes(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces of code points that begin at starts; code holds them back to back.

    A polynomial in the piece's own characters: summed with running powers, then shifted back to its start.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(1 << max(10, int(len(code) - 1).bit_length()))
    with np.errstate(over="ignore"):
        return mixed_bits(np.add.reduceat((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], starts) * inverse[starts], 1)


def runs_of(texts: list[str | None], cuts: re.Pattern = _SPACE, most: int = LONG) -> Iterator[tuple[list[str], list[int]]]:
    """(pieces, the text of each) of about `most` characters in all; only texts longer than that are cut, where `cuts` matches."""
    pieces: list[str] = []
    owner: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        at, size = 0, len(text) if text else 0
        while at < size:
            end = size
            if size - at > most and (m := cuts.search(text, at + most)):
                end = m.start()
            pieces.append(text if end - at == size else text[at:end])
            owner.append(i)
            total += end - at
            at = end
            if total >= most:
                yield pieces, owner
                pieces, owner, total = [], [], 0
    if pieces:
        yield pieces, owner


def code_points(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all pieces, each followed by a line end; where each piece's line end is)."""
    code = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.cumsum([len(p) + 1 for p in pieces]) - 1


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-case word of all texts in turn, words of each text); null texts have none."""
    found, counts = [], np.zeros(len(texts), np.int64)
    for pieces, owner in runs_of([t.lower() if t else None for t in texts]):
        code, ends = code_points(pieces)
        inside = _word_chars()[code]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.append(0, edge)  # every piece ends outside a word, so edges come in pairs
        start, size = edge[::2], edge[1::2] - edge[::2]
        np.add.at(counts, owner, np.diff(np.searchsorted(start, ends), prepend=0))
        found.append(piece_hashes(code[inside], np.cumsum(size) - size))
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), counts


def text_runs(texts: pa.Array, chars: int = LONG) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts) of runs of about that many characters; a longer text is a run of its own."""
    start, n = 0, len(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    while start < n:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + chars, "right")))
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k neighbouring words, mixed; none if there are fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string) alone, so other columns can't clash; rows without doc_id are dropped."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def by_ids(df: DataFrame, ids: DataFrame, how: str, n: int | None = None) -> DataFrame:
    """left_semi or left_anti join on doc_id; ids is broadcast only if it holds at most BROADCAST_IDS rows."""
    n = ids.count() if n is None else n
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", how)
