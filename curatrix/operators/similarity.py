"""Exact similarity joins as a grid of matrix products.

Rows are hashed into blocks, a block is packed into one matrix, and each cell of the block grid is one
product, worked off in stripes, that hands on only what passes (a threshold, or a row's best k). A row
travels once for each block of the other side: there are some CUTS of them, and more only where a block
would outgrow ELEMENTS numbers. A task holds two blocks and a stripe of their product, whatever the size
of the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the smallest block worth a task of its own, blocks that a table is cut into, and most numbers in a block.
BLOCK, CUTS, ELEMENTS = 2_048, 16, 1 << 21
#: Numbers in a stripe of a product.
STRIPE = 1 << 19
_NONE = "\x00none"


def _packed(df: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """((part, block, cuts, ids, groups, ms): one row for each block, (part, cuts)); df has id, vec, part, grp and vecs, further vectors."""
    numbers = F.sum(F.size("vec") + F.aggregate("vecs", F.lit(0), lambda n, v: n + F.size(v)))
    cuts = df.groupBy("part").agg(F.greatest(F.ceil(numbers / F.lit(ELEMENTS)), F.least(F.lit(CUTS), F.ceil(F.count("*") / F.lit(rows)))).cast("int").alias("cuts"))
    kind = df.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        ids, n = table.column("id").combine_chunks(), table.num_rows
        more = table.column("vecs").combine_chunks()
        each = len(more.flatten()) // n
        ms = [_flat(table.column("vec").combine_chunks())]
        ms += [_flat(more.flatten().take(pa.array(np.arange(i, n * each, each)))) for i in range(each)]
        groups = table.column("grp").combine_chunks()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        first = [table.column(c).slice(0, 1) for c in ("part", "block", "cuts")]
        return pa.table([*first, one(ids), one(groups.drop_null()), one(pa.array([m.tobytes() for m in ms], pa.binary()))], ["part", "block", "cuts", "ids", "groups", "ms"])

    placed = df.join(cuts, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    return placed.groupBy("part", "block").applyInArrow(pack, f"part string, block int, cuts int, ids array<{kind}>, groups array<string>, ms array<binary>"), cuts


def _flat(lists: pa.ListArray) -> np.ndarray:
    m = lists.flatten().to_numpy(zero_copy_only=False)
    if len(m) % len(lists) or (np.diff(lists.offsets.to_numpy()) != len(m) // len(lists)).any():
        raise ValueError("vectors of different lengths")
    return m


def _prepared(df: DataFrame, id: str, group: str | None, within: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """float vectors stay as narrow as they are until a task multiplies them."""
    grp = F.coalesce(F.col(group).cast("string"), F.lit(_NONE)) if group else F.lit(None).cast("string")
    kind = "float" if df.schema["vec"].dataType.elementType.typeName() == "float" else "double"
    vecs = F.array(*[F.col(c).cast("array<double>") for c in carry]) if carry else F.expr("cast(array() as array<array<double>>)")
    return df.where(F.col("vec").isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col("vec").cast(f"array<{kind}>").alias("vec"), vecs.alias("vecs"), grp.alias("grp"), (grp if within else F.lit("")).alias("part"))


class Block:
    """One side of a cell: ids, groups, the vectors and the further ones, in double precision."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda c: batch.column(batch.schema.get_field_index(c))[row].values
        self.ids, self.groups = get("ids").to_numpy(zero_copy_only=False), get("groups")
        wide = batch.column(batch.schema.get_field_index("wide"))[row].as_py()
        self.m, *self.more = (np.frombuffer(x.as_buffer(), np.float64 if wide or i else np.float32).reshape(len(self.ids), -1).astype(np.float64) for i, x in enumerate(get("ms")))

    def order(self) -> np.ndarray:
        """Each row's place by id."""
        out = np.empty(len(self.ids), np.int64)
        out[np.argsort(self.ids, kind="stable")] = np.arange(len(out))
        return out


def stripes(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, product) of a @ b.T by rows of a."""
    step = max(1, STRIPE // max(1, len(b)))
    for i in range(0, len(a), step):
        yield i, a[i : i + step] @ b.T


def _grid(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame] | None, cell: Callable, schema: str, wide: tuple[bool, bool]) -> DataFrame:
    """cell(a, b, same), an iterator of columns, for every pair of blocks of one part; right=None joins left with itself, each pair of blocks once."""
    cols = ["part", "ids", "groups", "ms"]
    if right is None:
        other = left[0].select(*cols, "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        cells = other.select(*cols, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"))
    else:
        a = left[0].join(right[1].withColumnRenamed("cuts", "n"), "part").select(*cols, F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), F.lit(False).alias("second"))
        b = right[0].join(left[1].withColumnRenamed("cuts", "n"), "part").select(*cols, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.col("block").alias("j"), F.lit(True).alias("second"))
        cells = a.unionByName(b)
    cells = cells.withColumn("wide", F.when(F.col("second"), F.lit(wide[1])).otherwise(F.lit(wide[0])))
    fields, alone = [c.split() for c in schema.split(", ")], right is None
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, same = [], False
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[r].as_py()  # noqa: B023, E731
                same = alone and get("i") == get("j")
                rows.append((get("second"), Block(batch, r)))
        rows.sort(key=lambda x: x[0])
        if same or len(rows) == 2:  # else no row was hashed to the other block
            for columns in cell(rows[0][1], rows[-1][1], same):
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow.get(k)) for x, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return cells.groupBy("part", "i", "j").applyInArrow(run, schema)


def _wide(df: DataFrame) -> bool:
    return df.schema["vec"].dataType.elementType.typeName() != "float"


def _where(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, in less than half its time."""
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


def _hits(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, product, rows within the stripe, columns) of pairs of different ids, each pair once."""
    for i, s in stripes(a.m, b.m):
        r, c = _where(s >= threshold)
        keep = (c > r + i) & (a.ids[r + i] != b.ids[c]) if same else a.ids[r + i] != b.ids[c]
        yield i, s, r[keep], c[keep]


def similar_pairs(df: DataFrame, threshold: float, id: str = "id", group: str | None = None, groups: str | None = None, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(a, b, score), a < b, of rows whose dot product is at least threshold; give unit vectors for cosines.

    groups: "cross" keeps pairs of different groups only, "within" pairs of one group; null groups
    are one group. "mark" adds `same`: whether both have one group, which null groups never do.
    carry: further vector columns; the pairs get their dot products under the same names. Null vectors
    and ids are left out; all vectors must have one length.
    """
    kind = df.schema[id].dataType.simpleString()

    def cell(a: Block, b: Block, same: bool) -> Iterator[list]:
        if groups in ("cross", "mark"):
            _, codes = np.unique(np.array(a.groups.to_pylist() + b.groups.to_pylist(), object), return_inverse=True)
            ga, gb = codes[: len(a.ids)], codes[len(a.ids) :]
            known = np.array([g != _NONE for g in a.groups.to_pylist()])
        for i, s, r, c in _hits(a, b, same, threshold):
            if groups == "cross":
                keep = ga[r + i] != gb[c]
                r, c = r[keep], c[keep]
            if len(r):
                x, y = a.ids[r + i], b.ids[c]
                out = [np.where(x < y, x, y), np.where(x < y, y, x), s[r, c]]
                out += [(ga[r + i] == gb[c]) & known[r + i]] if groups == "mark" else []
                # Where few rows pass, their vectors are multiplied alone.
                out += [np.einsum("ij,ij->i", m[r + i], n[c]) if len(r) * 8 < s.size else (m[i : i + len(s)] @ n.T)[r, c] for m, n in zip(a.more, b.more, strict=True)]
                yield out

    more = ["same boolean"] * (groups == "mark") + [f"{c} double" for c in carry]
    ready = _prepared(df, id, group if groups else None, groups == "within", carry)
    return _grid(_packed(ready, block), None, cell, ", ".join([f"a {kind}", f"b {kind}", "score double", *more]), (_wide(ready),) * 2)


def degrees(df: DataFrame, threshold: float, id: str = "id", block: int = BLOCK) -> DataFrame:
    """(id, degree) of rows that have others at threshold: how many. No pair leaves its cell."""
    kind = df.schema[id].dataType.simpleString()

    def cell(a: Block, b: Block, same: bool) -> Iterator[list]:
        n, m = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        for i, s, r, c in _hits(a, b, same, threshold):
            n[i : i + len(s)] += np.bincount(r, minlength=len(s))
            m += np.bincount(c, minlength=len(m))
        for x, k in ((a.ids, n), (b.ids, m)):
            yield [x[k > 0], k[k > 0]]

    ready = _prepared(df, id, None, False)
    found = _grid(_packed(ready, block), None, cell, f"id {kind}, n bigint", (_wide(ready),) * 2)
    return found.groupBy("id").agg(F.sum("n").alias("degree"))


def spanning_pairs(df: DataFrame, threshold: float, id: str = "id", block: int = BLOCK) -> DataFrame:
    """(a, b) with the connected components of similar_pairs: of each cell a spanning forest, so fewer pairs than its rows."""
    kind = df.schema[id].dataType.simpleString()

    def cell(a: Block, b: Block, same: bool) -> Iterator[list]:
        shift = 0 if same else len(a.ids)
        root = np.arange(len(b.ids) + shift)
        x, y = [], []
        for i, _, r, c in _hits(a, b, same, threshold):
            while len(r):
                u, v = root[r + i], root[c + shift]
                apart = u != v
                r, c, u, v = r[apart], c[apart], u[apart], v[apart]
                # Each root takes at most one link to a smaller one in a turn, so no turn closes a circle.
                high, low = np.maximum(u, v), np.minimum(u, v)
                _, first = np.unique(high, return_index=True)
                root[high[first]] = low[first]
                x.append(a.ids[r[first] + i])
                y.append(b.ids[c[first]])
                while len(np.flatnonzero(root != root[root])):
                    root = root[root]
        if x:
            x, y = np.concatenate(x), np.concatenate(y)
            yield [np.where(x < y, x, y), np.where(x < y, y, x)]

    ready = _prepared(df, id, None, False)
    return _grid(_packed(ready, block), None, cell, f"a {kind}, b {kind}", (_wide(ready),) * 2)


def _best(s: np.ndarray, k: int, order: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, rounded scores) of each row's k best, ties by order; -inf is none."""
    # The k-th best of some columns bounds that of all from below: few others are sorted.
    head = s[:, : max(4 * k, s.shape[1] // 16)]
    least = np.partition(head, -k, axis=1)[:, -k] if head.shape[1] > k else np.full(len(s), -np.inf)
    r, c = _where((s >= (least - 2 * 10.0**-digits)[:, None]) & (s > -np.inf))
    score = np.round(s[r, c], digits)
    line = np.lexsort((order[c], -score, r))
    r, c, score = r[line], c[line], score[line]
    n = np.bincount(r, minlength=len(s))
    keep = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) < k
    return r[keep], c[keep], score[keep]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", id: str = "id", group: str | None = None, others: bool = False, digits: int = 6, least: float | None = None, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): each query's k best rows by dot product, ties by id.

    group: a column of both tables that must agree. others: a row with the query's own id is passed
    over. Scores are rounded before ranking, so equal ones rank by id wherever they were computed.
    least: rows of a smaller dot product are passed over. weight: a column of corpus that multiplies
    the score afterwards. Queries without a row to compare have none. An id allow-list is a semi join
    on corpus beforehand.
    """
    q_type, c_type = queries.schema[query_id].dataType.simpleString(), corpus.schema[id].dataType.simpleString()

    def cell(a: Block, b: Block, same: bool) -> Iterator[list]:
        order = b.order()
        place = {x: [] for x in a.ids.tolist()} if others else {}
        for j, x in enumerate(b.ids.tolist() if others else ()):
            if x in place:
                place[x].append(j)
        for i, s in stripes(a.m, b.m):
            for r, x in enumerate(a.ids[i : i + len(s)].tolist() if others else ()):
                s[r, place[x]] = -np.inf
            if least is not None:
                s[s < least] = -np.inf
            if weight:
                s *= b.more[0].T
            r, c, score = _best(s, k, order, digits)
            yield [a.ids[r + i], b.ids[c], score]

    left = _prepared(queries, query_id, group, bool(group))
    right = _prepared(corpus.withColumn("_w", F.array(F.col(weight).cast("double"))) if weight else corpus, id, group, bool(group), ("_w",) if weight else ())
    found = _grid(_packed(left, block), _packed(right, block), cell, f"{query_id} {q_type}, {id} {c_type}, score double", (_wide(left), _wide(right)))
    return top(found, k, query_id, id)


def top(results: DataFrame, k: int | None, query_id: str = "query_id", id: str = "id", score: str = "score") -> DataFrame:
    """results with rank by score, ties by id, cut at k."""
    line = Window.partitionBy(query_id).orderBy(F.desc(score), id)
    ranked = results.withColumn("rank", F.row_number().over(line))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def triage(pairs: DataFrame, accept: float = 0.75, reject: float = 0.3) -> DataFrame:
    """pairs with classification (true, false, null: uncertain), confidence and reason.

    At accept or above a pair holds, below reject it doesn't; between, confidence is the distance
    from the middle as a share of half the band. Null scores stay uncertain with null confidence.
    """
    s, middle, half = F.col("score"), (accept + reject) / 2, (accept - reject) / 2
    sure = F.when(s >= accept, True).when(s < reject, False)
    confidence = F.when(sure.isNotNull(), 1.0).otherwise(F.abs(s - middle) / (half if half else 1.0))
    reason = F.when(s >= accept, F.format_string(f"score %.3f >= {accept}", s)).when(s < reject, F.format_string(f"score %.3f < {reject}", s)).otherwise(F.format_string("score %.3f in the uncertain band", s))
    return pairs.withColumns({"classification": sure, "confidence": confidence, "reason": reason})


def harness_rows(uncertain: DataFrame, texts: DataFrame, label: Column | None = None) -> DataFrame:
    """(id, content, output, context, label) for a judging harness; texts(id, text); pairs without a text drop out."""
    one = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))
    joined = uncertain.join(one("a"), "a").join(one("b"), "b")
    return joined.select(F.format_string("pair_%s_%s", F.col("a").cast("string"), F.col("b").cast("string")).alias("id"), F.col("text_a").alias("content"), F.col("text_b").alias("output"), F.format_string("cosine=%.3f", "score").alias("context"), (F.lit(None).cast("string") if label is None else label).alias("label"))
