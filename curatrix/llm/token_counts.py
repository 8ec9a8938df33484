"""Token counts with a map-side two-tier lookup.

A byte-pair token count is the sum of the counts of a text's pre-tokens. Pre-tokens are found and
hashed for a run of texts in a few numpy passes. Tier one is a compact table of the frequent
pre-tokens' hashes and lengths, sorted and broadcast to all workers; tier two is each worker's cache
of hashes and lengths, which encodes what it hasn't met. Neither keeps strings, so both are bounded in
bytes. Pre-tokens are never shuffled: the frequent ones are found by summing small summaries, one for
each task.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import code_points, id_text, piece_hashes, runs_of, text_runs

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a task reports, entries of the broadcast table (10 bytes each) and of a worker's cache (12 bytes each).
REPORTED, FREQUENT, CACHE = 1_000, 16_384, 1_000_000
OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Where a very long text may be cut: a pre-token begins at a single space before a letter.
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")


def encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@functools.cache
def _kinds() -> np.ndarray:
    """The class of each code point, as the pattern's parts have it."""
    chars, out = "".join(map(chr, range(0x110000))), np.full(0x110000, OTHER, np.uint8)
    for kind, part in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(part, chars):
            out[m.start() : m.end()] = kind
    return out


def pretokens(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the pre-tokens that PATTERN finds in pieces of code points, each closed by one at `ends`."""
    kind = _kinds()[code]
    kind[ends] = END
    start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    k = kind[start]
    after = np.append(start[1:], len(kind))  # the last run is END
    follows = np.append(k[1:], END)
    begins = np.zeros(len(kind), np.bool_)
    begins[start] = True
    # White space before a text's end is one pre-token; else its last character stands apart, and a
    # single space goes with what follows.
    space = (k == SPACE) & (follows != END)
    begins[after[space] - 1] = True
    joins = after[space][code[after[space] - 1] == 0x20]
    begins[joins] = False
    # 's and the like, where the apostrophe itself begins a pre-token.
    mark = start[(k == OTHER) & (after - start == 1) & (follows == LETTER)]
    mark = mark[(code[mark] == 0x27) & begins[mark]]
    first, second = code[mark + 1], code[mark + 2]
    one = np.isin(first, [0x73, 0x74, 0x6D, 0x64])
    two = ((first == 0x72) | (first == 0x76)) & (second == 0x65) | (first == 0x6C) & (second == 0x6C)
    begins[mark[one | two] + 1] = False
    rest = mark[one | two] + np.where(one, 2, 3)[one | two]
    begins[rest[kind[rest] == LETTER]] = True
    begins[kind == END] = True
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(kind)))
    real = kind[at] != END
    return at[real], size[real]


def _split(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: (code points, pre-token starts, sizes, hashes, the text of each pre-token)."""
    for pieces, owner in runs_of(texts, _CUT):
        code, ends = code_points(pieces)
        start, size = pretokens(code, ends)
        inside = np.ones(len(code), np.bool_)
        inside[ends] = False
        h = piece_hashes(code[inside], np.cumsum(size) - size)
        yield code, start, size, h, np.asarray(owner)[np.searchsorted(ends, start)]


def _piece(code: np.ndarray, start: int, size: int) -> bytes:
    return code[start : start + size].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n) of the task's most frequent pre-tokens, the best of each run of texts added up."""
    seen: Counter = Counter()
    for batch in batches:
        for _, texts in text_runs(batch.column(0)):
            for code, start, size, h, _ in _split(texts):
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                best = np.argsort(-n, kind="stable")[:REPORTED]
                for i, count in zip(first[best].tolist(), n[best].tolist(), strict=True):
                    if size[i] <= 32:
                        seen[_piece(code, start[i], size[i])] += count
        if len(seen) > 20 * REPORTED:
            seen = Counter(dict(seen.most_common(10 * REPORTED)))
    top = seen.most_common(REPORTED)
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])


class Lengths:
    """Tokens of hashed pre-tokens: frequent ones from the start, others when first met."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, encode: Callable[[bytes], list[int]]):
        self.encode = encode
        self.tables = [(hashes, sizes.astype(np.uint32)), (np.empty(0, np.uint64), np.empty(0, np.uint32))]

    def of(self, code: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        u, first, where = np.unique(h, return_index=True, return_inverse=True)
        n, known = np.zeros(len(u), np.uint32), np.zeros(len(u), np.bool_)
        for hashes, sizes in self.tables:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, u), len(hashes) - 1)
                hit = hashes[at] == u
                n[hit], known = sizes[at[hit]], known | hit
        new = np.flatnonzero(~known)
        if len(new):
            n[new] = [len(self.encode(_piece(code, start[i], size[i]))) for i in first[new].tolist()]
            hashes, sizes = self.tables[1] if len(self.tables[1][0]) + len(new) <= CACHE else (u[:0], n[:0])
            hashes, sizes = np.append(hashes, u[new]), np.append(sizes, n[new])
            order = np.argsort(hashes)
            self.tables[1] = hashes[order], sizes[order]
        return n[where]


def _counter(table, raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(*(np.frombuffer(x, t) for x, t in zip(table.value, (np.uint64, np.uint16), strict=True)), encoding(raw.value)._encode_single_piece)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for base, texts in text_runs(batch.column(batch.num_columns - 1)):
                for code, start, size, h, owner in _split(texts):
                    counts[base : base + len(texts)] += np.bincount(owner, lengths.of(code, start, size, h), len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], [*batch.schema.names[:-1], "n_tokens"])

    return run


def frequent_pretokens(texts: DataFrame) -> list[bytes]:
    """About the FREQUENT most frequent pre-tokens of all texts; a task hands on REPORTED of its own at most."""
    sums = texts.select("text").mapInArrow(_report, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [bytes(r.piece) for r in sums.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()]


def with_tokens(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """rows with their last column, text, replaced by n_tokens; one pass finds the frequent pre-tokens, the returned one counts."""
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    encode = encoding(ranks)._encode_single_piece
    frequent = frequent_pretokens(rows)
    h = np.array([piece_hashes(np.frombuffer(p.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(1, np.int64))[0] for p in frequent], np.uint64)
    sizes = np.array([len(encode(p)) for p in frequent], np.uint16)
    order = np.argsort(h)
    context = rows.sparkSession.sparkContext
    # Both are of fixed size: at most FREQUENT entries, and a vocabulary.
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_tokens long"])
    return rows.mapInArrow(_counter(context.broadcast((h[order].tobytes(), sizes[order].tobytes())), context.broadcast(ranks)), schema)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) for every row that has a doc_id.

    Null and empty texts have 0 tokens; strings that spell special tokens are ordinary text. Repeated
    rows are counted alike. Empty tables give no rows. Only doc_id and text are read. tokenizer is the
    path of a rank file that the driver can read; workers get its bytes by broadcast. Its pre-tokens
    are those of PATTERN.
    """
    return with_tokens(id_text(docs), tokenizer)
