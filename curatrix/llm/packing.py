"""Best-fit packing of documents into training sequences, certified by lower bounds.

Lengths are token counts. Documents are spread over partitions by hash and packed there by best-fit
decreasing. Dual-feasible functions give each partition a lower bound on its bins; where the packing
meets the bound it is optimal and final. Partitions with a gap are paired, each pair pools its
documents and is packed again; a pair's new packing stands if it needs fewer bins than its two old
ones. Rounds go on, with other pairs, until one brings nothing.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import BROADCAST_IDS
from curatrix.llm.lengths import with_lengths
from curatrix.session import dropped, stored

CAPACITY = 2048
#: Pieces in a partition, about; a partition is packed in one worker's memory.
PARTITION = 40_000
#: Partitions that have pooled their documents up to so many times PARTITION pieces aren't paired any more.
POOLED = 16


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Best of several dual-feasible bounds on the bins of counts[i] pieces of sizes[i], in whole numbers.

    A dual-feasible function keeps the sum over any set that fits a bin at 1 or below, so the sum over
    all pieces, rounded up, bounds the bins from below.
    """
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 33):
        # x, if (k + 1) * x is whole, else floor((k + 1) * x) / k; times k * capacity.
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    for e in np.unique(np.concatenate([sizes[sizes * 2 <= capacity], capacity - sizes[sizes * 2 > capacity]])).tolist():
        # 1 above 1 - e, x between e and 1 - e, 0 below e.
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece, and the bins used; ties go to the piece that comes first.

    Bins with the same free space are a stack; bit i of `free` tells whether a bin with i free exists,
    so the tightest bin that fits is the lowest bit from the piece's size on.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, used = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        above = free >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                free &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            stacks[left].append(b)
            free |= 1 << left
    return bins, offsets, used


_SCHEMA = "row long, doc_id long, piece long, n_tokens long, part long, bin long, offset long, bins long, bound long, pieces long"


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf.n_tokens.to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(*np.unique(sizes, return_counts=True), capacity)
        return pdf[["row", "doc_id", "piece", "n_tokens", "part"]].assign(bin=bins, offset=offsets, bins=used, bound=bound, pieces=len(pdf))

    return run


def pieces_of(lengths: DataFrame, capacity: int) -> DataFrame:
    """A document longer than a bin is cut into full bins and a rest; tokens stay in order. row tells pieces apart, whatever repeats."""
    n = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("bigint")
    cut = lengths.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"))
    size = F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("bigint")
    return cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "piece", size.alias("n_tokens"))


def paired(gaps: list[int], met: list[int], seed: int) -> list[tuple[int, int]]:
    """Partitions with a gap two by two; one that is left over goes with a certified one, if there is any."""
    rng = random.Random(seed)
    gaps = sorted(gaps)
    rng.shuffle(gaps)
    if len(gaps) % 2:
        gaps += [rng.choice(sorted(met))] if met else []
    return list(zip(gaps[::2], gaps[1::2], strict=False))


def pack(docs: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION) -> DataFrame:
    """(bin_id, doc_id, piece, n_tokens, offset, partition_bins, partition_bound), one row for each piece.

    A piece's tokens are piece * capacity and on in its document, and offset and on in its bin.
    partition_bins - partition_bound is the most bins by which its partition can miss the optimum;
    full pieces are bins of their own and certified. Documents without tokens (null, empty) and
    rows without doc_id are left out. Rows that repeat a doc_id are packed once each. Pieces of equal
    size are packed by doc_id and piece. Empty tables give no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(with_lengths(docs).select("doc_id", "n_tokens"), capacity), "pieces")
    full, rest = pieces.where(F.col("n_tokens") == capacity), pieces.where(F.col("n_tokens") < capacity)
    parts = max(1, -(-rest.count() // partition))

    def packed(df: DataFrame) -> DataFrame:
        return stored(df.select("row", "doc_id", "piece", "n_tokens", "part").groupBy("part").applyInPandas(_pack(capacity), _SCHEMA), "packed")

    def summary(df: DataFrame) -> dict[int, tuple[int, int, int]]:
        """(bins, bound, pieces) of each partition: one entry for some PARTITION pieces."""
        return {r.part: (r.bins, r.bound, r.pieces) for r in df.select("part", "bins", "bound", "pieces").distinct().collect()}

    def chosen(df: DataFrame, ids: list[int], to: list[int] | None = None) -> DataFrame:
        table = spark.createDataFrame(list(zip(ids, to or ids, strict=True)), "part long, to long")
        return df.join(F.broadcast(table) if len(ids) <= BROADCAST_IDS else table, "part").drop("part").withColumnRenamed("to", "part")

    tables = [packed(rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(parts))))]
    # Where each partition's rows lie; a partition whose pair did better is superseded.
    where, state, base, turn = dict.fromkeys((s := summary(tables[0])), 0), s, parts, 0
    while True:
        turn += 1
        small = {p for p, (_, _, n) in state.items() if n <= POOLED // 2 * partition}
        pairs = paired([p for p in small if state[p][0] > state[p][1]], [p for p in small if state[p][0] == state[p][1]], turn)
        if not pairs:
            break
        to = {p: base + i for i, pair in enumerate(pairs) for p in pair}
        base += len(pairs)
        sources = sorted({where[p] for p in to})
        now = None
        for i in sources:
            ids = [p for p in to if where[p] == i]
            part = chosen(tables[i].select("row", "doc_id", "piece", "n_tokens", "part"), ids, [to[p] for p in ids])
            now = part if now is None else now.union(part)
        again = packed(now)
        better = {p: x for p, x in summary(again).items()}
        gained = [(a, b) for a, b in pairs if better[to[a]][0] < state[a][0] + state[b][0]]
        if not gained:
            dropped(again)
            break
        tables.append(again)
        for a, b in gained:
            state[to[a]], where[to[a]] = better[to[a]], len(tables) - 1
            for p in (a, b):
                del state[p], where[p]
    final = None
    for i, table in enumerate(tables):
        ids = sorted(p for p, at in where.items() if at == i)
        part = table if len(tables) == 1 else chosen(table, ids).select(*table.columns) if ids else table.limit(0)
        final = part if final is None else final.unionByName(part)
    # Bins of full pieces are numbered from below zero down, so neither side can meet the other.
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    whole = full.select((-1 - F.col("row")).alias("bin_id"), "doc_id", "piece", "n_tokens", zero.alias("offset"), one.alias("partition_bins"), one.alias("partition_bound"))
    mixed = final.select((F.col("part") * F.lit(2**31) + F.col("bin")).alias("bin_id"), "doc_id", "piece", "n_tokens", "offset", F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound"))
    return mixed.union(whole)
