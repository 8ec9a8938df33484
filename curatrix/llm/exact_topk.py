"""Exact top-k BM25 search: an inverted index for each shard, block-max WAND pruning, exact merge.

A shard is some thousands of documents; its index holds postings of the batch's query terms, sorted
by term and document, and is written to the shared folder. Global statistics (documents, words,
document frequencies) are summed over all shards. Then every shard runs every query. Documents lie in
blocks of 64 that are aligned over all terms, so the two tests of block-max WAND (do the whole-list
maxima of the terms present reach the threshold, and do their block maxima) are taken for all blocks
of a query in one numpy step; blocks that pass are scored whole, best first, and every score gained
raises the threshold. Shard results are merged by score and doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import WORD, id_text
from curatrix.session import dropped, stored

K1, B, TOP, BLOCK = 1.2, 0.75, 10, 64
#: Documents and words in a shard, at most; one document of more words is a shard of its own.
SHARD_DOCS, SHARD_WORDS = 16_384, 8_000_000
#: Distinct query terms that are looked up in one pass over the documents; more queries take more passes.
BATCH_TERMS = 200_000

_INDEX = "doc_ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def _indexer(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(terms.value)}
        ids, lengths, hits, owner, words = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            n = len(ids)
            sizes = np.fromiter(map(len, hits), np.int64, n)
            term = np.fromiter((t for h in hits for t in h), np.int64, sizes.sum())
            key, tf = np.unique(term * n + np.repeat(np.arange(n), sizes), return_counts=True)
            present, starts = np.unique(key // n, return_index=True)
            columns = (np.array(ids, np.int64), np.array(lengths, np.int64), present.astype(np.int32), np.append(starts, len(key)).astype(np.int64), (key % n).astype(np.int32), tf.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = WORD.findall(text.lower()) if text else []
                ids.append(i)
                lengths.append(len(w))
                hits.append([known[x] for x in w if x in known])
                words += len(w)
                if len(ids) >= SHARD_DOCS or words >= SHARD_WORDS:
                    yield shard()
                    ids, lengths, hits, words = [], [], [], 0
        if ids:
            yield shard()

    return run


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): document frequencies; under -1 the documents, under -2 their words."""
    for batch in batches:
        for lengths, terms, starts in zip(*(batch.column(c).to_pylist() for c in ("lengths", "terms", "starts")), strict=True):
            lengths, terms, starts = np.frombuffer(lengths, np.int64), np.frombuffer(terms, np.int32), np.frombuffer(starts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2]).astype(np.int32)), pa.array(np.append(np.diff(starts), [len(lengths), lengths.sum()]))], ["term", "n"])


class Shard:
    """One shard's index with impacts (idf times the saturated frequency) and block maxima."""

    def __init__(self, lengths, terms, starts, docs, tfs, idf: np.ndarray, average: float):
        self.row = {int(t): i for i, t in enumerate(terms)}
        self.starts, self.docs, self.n = starts, docs, len(lengths)
        norm = K1 * (1 - B + B * lengths / average)
        self.impact = np.repeat(idf[terms], np.diff(starts)) * tfs * (K1 + 1) / (tfs + norm[docs]) if len(docs) else np.empty(0)
        self.blocks = -(-self.n // BLOCK)
        self.top = np.zeros((len(terms), self.blocks))
        if len(docs):
            cell = np.repeat(np.arange(len(terms)), np.diff(starts)) * self.blocks + docs // BLOCK
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            self.top.ravel()[cell[first]] = np.maximum.reduceat(self.impact, first)
        self.list_max = self.top.max(1) if self.blocks else np.zeros(len(terms))

    def search(self, query: list[tuple[int, int]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc rows, scores rounded to 6 places) of the k best; query: (term, how often it occurs in the query)."""
        found = [(self.row[t], m) for t, m in query if t in self.row]
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        rows, weight = np.array([r for r, _ in found]), np.array([m for _, m in found], float)
        block_top = self.top[rows]
        bound = weight @ block_top
        pivot = (weight * self.list_max[rows]) @ (block_top > 0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score, threshold, at, step = np.empty(0, np.int64), np.empty(0), -np.inf, 0, 2
        while at < len(order):
            part = order[at : at + step]
            part = part[(pivot[part] >= threshold - 1e-6) & (bound[part] >= threshold - 1e-6)]
            if not len(part):
                break  # bounds only fall from here on
            at, step = at + step, step * 2
            slot = np.full(self.blocks, -1)
            slot[part] = np.arange(len(part))
            total = np.zeros(len(part) * BLOCK)
            for r, m in zip(rows.tolist(), weight.tolist(), strict=True):
                a, b = self.starts[r], self.starts[r + 1]
                d = self.docs[a:b]
                s = slot[d // BLOCK]
                ok = s >= 0
                total[s[ok] * BLOCK + d[ok] % BLOCK] += m * self.impact[a:b][ok]
            hit = np.flatnonzero(total > 0)
            best = np.concatenate([best, part[hit // BLOCK] * BLOCK + hit % BLOCK])
            score = np.concatenate([score, np.round(total[hit], 6)])
            if len(best) > k:
                keep = np.lexsort((best, ids[best], -score))[:k]
                best, score = best[keep], score[keep]
            if len(best) == k:
                threshold = score.min()
        return best, score


def _searcher(queries, idf, average: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, terms, starts, docs, tfs = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.int32, np.int64, np.int32, np.int32)))
                shard = Shard(lengths, terms, starts, docs, tfs, idf.value, average)
                out = [(q, *shard.search(query, ids, k)) for q, query in queries.value]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([q for q, _, _ in out], np.int64), [len(d) for _, d, _ in out])), pa.array(np.concatenate([ids[d] for _, d, _ in out] or [np.empty(0, np.int64)])), pa.array(np.concatenate([s for _, _, s in out] or [np.empty(0)]))],
                    ["query", "doc_id", "score"],
                )

    return run


def _batches(items: Iterator, most: int) -> Iterator[list[tuple[int, Counter]]]:
    batch, terms = [], set()
    for row in items:
        words = Counter(WORD.findall(row.text.lower())) if row.text else Counter()
        if words:
            if batch and len(terms | words.keys()) > most:
                yield batch
                batch, terms = [], set()
            terms |= words.keys()
            batch.append((row.item_id, words))
    if batch:
        yield batch


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, doc_id, score, rank): for every row of items the k documents of highest BM25 score.

    Score: sum over the query's words, repeats counted, of ln(1 + (N - n + 0.5) / (n + 0.5)) * tf * 2.2 /
    (tf + 1.2 * (0.25 + 0.75 * words / average words)), rounded to 6 places. Equal scores rank by
    doc_id. Only documents that share a word with the query are listed. Null and empty documents count
    in N and share nothing; null and empty queries list nothing. Rows that repeat a doc_id are
    documents of their own, rows that repeat an item_id are queries of their own under one id, ranked
    together. Rows without doc_id or item_id are left out. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = id_text(docs)
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    results = None
    for batch in _batches(asked.toLocalIterator(), BATCH_TERMS):
        terms = sorted(set().union(*(w for _, w in batch)))
        number = {w: i for i, w in enumerate(terms)}
        context = spark.sparkContext
        index = stored(texts.mapInArrow(_indexer(context.broadcast(terms)), _INDEX), "index")
        sums = {r.term: r.n for r in index.select("lengths", "terms", "starts").mapInArrow(_statistics, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, words = sums.get(-1, 0), sums.get(-2, 0)
        frequency = np.array([sums.get(i, 0) for i in range(len(terms))], float)
        idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        queries = [(i, [(number[w], m) for w, m in words.items()]) for i, words in batch]
        part = stored(index.mapInArrow(_searcher(context.broadcast(queries), context.broadcast(idf), max(words, 1) / max(n, 1), k), "item_id long, doc_id long, score double"), "hits")
        dropped(index)
        results = part if results is None else results.union(part)
    if results is None:
        results = spark.createDataFrame([], "item_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return results.withColumn("rank", rank).where(F.col("rank") <= k)


def oracle_sql(k: int = TOP) -> str:
    return f"""
WITH q AS (SELECT item_id, w, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark) GROUP BY ALL),
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS a FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, avg(coalesce(len(a), 0)) AS average FROM d),
p AS (SELECT r, doc_id, dl, w, count(*) AS tf FROM (SELECT r, doc_id, len(a) AS dl, unnest(a) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
f AS (SELECT w, ln(1 + (any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM p, s GROUP BY w),
t AS (SELECT item_id, r, doc_id, round(sum(m * idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / average))), 6) AS score FROM q JOIN p USING (w) JOIN f USING (w), s GROUP BY ALL)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM t) WHERE rank <= {k}"""
