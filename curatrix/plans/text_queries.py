"""Queries over texts: full-text, hybrid and fused search, placeholders, contexts, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import genericized, query_tokens, sentences, slug
from curatrix.operators import batch, context, embedding, metrics, search, similarity
from curatrix.operators.graphs import top_per_group
from curatrix.plans.registry import Registry, table

R = Registry()
LIMIT = 10
DEEP = LIMIT * search.OVERFETCH

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_BM25 = f"""
q AS (SELECT item_id AS query_id, w, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS w FROM benchmark) WHERE length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') GROUP BY ALL),
d AS (SELECT doc_id, {_TOKENS} AS a FROM documents),
c AS (SELECT count(*) AS n, avg(len(a)) AS average FROM d),
t AS (SELECT doc_id AS id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(a) AS dl, unnest(a) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
i AS (SELECT w, ln((any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM t, c GROUP BY w),
b AS (SELECT query_id, id, round(sum(times * CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / average))), 6) AS score FROM q JOIN t USING (w) JOIN i USING (w), c GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::int AS rank FROM b)"""
_DENSE = """
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::int AS rank FROM (
SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) AS score
FROM embeddings a JOIN benchmark ON a.vec_id = item_id, embeddings b JOIN documents ON b.vec_id = doc_id))"""
_RRF = f"f AS (SELECT query_id, id, round(sum(1e0 / (60 + rank)), 12) AS score FROM (SELECT * FROM dense WHERE rank <= {DEEP} UNION ALL SELECT * FROM sparse WHERE rank <= {DEEP}) GROUP BY ALL)"
_TOP = f"SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::int AS rank FROM f) WHERE rank <= {LIMIT}"


def queries_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(v, "query_id", "left")


def queries_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def documents_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source").join(v, "id", "left")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, d = queries_with_vectors(spark, sf_dir), documents_with_vectors(spark, sf_dir)
    return similarity.nearest(q.select("query_id", "vec"), d.select("id", "vec"), DEEP), search.bm25(queries_alone(spark, sf_dir), documents_alone(spark, sf_dir), DEEP, digits=6)


@R.add(f"WITH {_BM25} SELECT * FROM sparse WHERE rank <= {LIMIT}")
def bm25_search(spark, sf_dir):
    return search.bm25(queries_alone(spark, sf_dir), documents_alone(spark, sf_dir), LIMIT, digits=6)


@R.add(f"WITH {_BM25}, {_DENSE}, {_RRF} {_TOP}")
def hybrid_search(spark, sf_dir):
    return search.hybrid(queries_with_vectors(spark, sf_dir), documents_with_vectors(spark, sf_dir), LIMIT, texts=documents_alone(spark, sf_dir))


@R.add(f"WITH {_BM25}, {_DENSE}, v AS (SELECT unnest([10, 60, 100]) AS k), f AS (SELECT k, query_id, id, round(sum(1e0 / (k + rank)), 12) AS score FROM (SELECT * FROM dense WHERE rank <= {DEEP} UNION ALL SELECT * FROM sparse WHERE rank <= {DEEP}), v GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, id)::int AS rank FROM f) WHERE rank <= {LIMIT}")
def rrf_fusion(spark, sf_dir):
    return search.rrf_sweep(*_sides(spark, sf_dir), [10, 60, 100], LIMIT)


def _scaled(side: str, weight: str) -> str:
    return f"SELECT query_id, id, {weight} * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part FROM {side} WHERE rank <= {DEEP} WINDOW w AS (PARTITION BY query_id)"


@R.add(f"WITH {_BM25}, {_DENSE}, f AS (SELECT query_id, id, round(sum(part), 9) AS score FROM ({_scaled('dense', '0.5e0')} UNION ALL {_scaled('sparse', '0.5e0')}) GROUP BY ALL) {_TOP}")
def convex_fusion(spark, sf_dir):
    fused = search.convex(*_sides(spark, sf_dir), alpha=0.5, limit=None)
    return similarity.top(fused.drop("rank").withColumn("score", F.round("score", 9)), LIMIT)


@R.add(f"WITH {_BM25}, k AS (SELECT query_id, id, score, source FROM sparse JOIN documents ON doc_id = id), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS n FROM k) WHERE n = 1) SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::int AS rank FROM f")
def dedup_best_per_source(spark, sf_dir):
    hits = search.bm25(queries_alone(spark, sf_dir), documents_alone(spark, sf_dir), None, digits=6, by="source")
    return hits.select("query_id", "id", "score", "source", "rank")


@R.add()
def bm25_stemmed(spark, sf_dir):
    return search.bm25(queries_alone(spark, sf_dir), documents_alone(spark, sf_dir), LIMIT, stem=True, digits=6)


@R.add("SELECT doc_id AS id, 1.0e0 AS score FROM documents WHERE text ILIKE '%licens%'")
def grep_contains(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return search.grep(docs, "licens", None).select("id", "score")


@R.add()
def genericize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", genericized(F.col("text")).alias("generic"))


@R.add(f"SELECT item_id, list_filter({_TOKENS}, lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+')) AS words FROM benchmark")
def sanitized_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", query_tokens(F.col("text")).alias("words"))


@R.add("SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\. '), lambda s: trim(s) <> ''))::int AS sentences FROM benchmark")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(sentences(F.col("text"))).alias("sentences"))


@R.add("SELECT p_partkey, p_partkey::varchar || '_' || regexp_replace(left(replace(lower(p_name), ' ', '_'), 40), '[^\\p{L}\\p{N}_-]', '', 'g') AS name FROM part")
def part_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_partkey").cast("string"), F.col("p_name")).alias("name"))


@R.add("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@R.add("WITH c AS (SELECT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT count(*) FILTER (sha256(text) IN (SELECT h FROM c)) AS hits, count(*) FILTER (sha256(text) NOT IN (SELECT h FROM c)) AS misses FROM documents")
def cache_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    cache = known.select(F.sha2("text", 256).alias("text_hash"), F.lit("hashing").alias("model"), F.array().cast("array<float>").alias("vec")).distinct()
    hits, misses = embedding.cache_split(docs, cache, "hashing")
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))


@R.add()
def embedded_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = embedding.embedded(docs, embedding.hashing_embedder(64))
    return out.select("doc_id", "vec")


@R.add("SELECT conv_id, string_agg('## Turn ' || turn || chr(10) || '- role: ' || role || chr(10) || '- text: ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def context_markdown(spark, sf_dir):
    one = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.array_join(context.fields(["role", "text"]), "\n"))
    return context.batch_markdown(table(spark, sf_dir, "conversations"), one, "turn", ["conv_id"])


@R.add("SELECT conv_id, round(sum(CASE WHEN role = 'user' THEN length(text) * 3e0 / 1e6 ELSE length(text) * 15e0 / 1e6 END), 9) AS cost FROM conversations GROUP BY conv_id")
def conversation_costs(spark, sf_dir):
    prices = spark.createDataFrame([("large", 3.0, 15.0)], "model string, input double, output double")
    n = F.length("text")
    calls = table(spark, sf_dir, "conversations").select("conv_id", F.lit("large").alias("model"), F.when(F.col("role") == "user", n).otherwise(0).alias("input_tokens"), F.when(F.col("role") == "user", 0).otherwise(n).alias("output_tokens"))
    return batch.model_cost(calls, prices).groupBy("conv_id").agg(F.round(F.sum("cost"), 9).alias("cost"))


@R.add()
def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return top_per_group(docs, "lang", 50, F.xxhash64("doc_id"), "doc_id")


@R.add("""
WITH n AS (SELECT source AS c, lang AS l, count(*)::double AS n FROM documents GROUP BY ALL),
j AS (SELECT n, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER (PARTITION BY l) AS nl, sum(n) OVER () AS t FROM n),
h AS (SELECT -sum(n / t * ln(nl / t)) AS hl, -sum(n / t * ln(nc / t)) AS hc, -sum(n / t * ln(n / nc)) AS hlc, -sum(n / t * ln(n / nl)) AS hcl FROM j),
s AS (SELECT 1 - hlc / hl AS homogeneity, 1 - hcl / hc AS completeness FROM h)
SELECT round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v_measure FROM s""")
def v_measure(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("cluster"), F.col("lang").alias("label"))
    return metrics.v_measure(d).select(*[F.round(c, 6).alias(c) for c in ("homogeneity", "completeness", "v_measure")])


@R.add("SELECT count(*) AS clusters, avg(n) AS mean, quantile_cont(n, 0.5)::double AS median, max(n) AS largest, min(n) AS smallest, round(quantile_cont(n, 0.9)::double, 6) AS p90 FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def cluster_size_stats(spark, sf_dir):
    from curatrix.operators.clusters import cluster_sizes

    sizes = cluster_sizes(table(spark, sf_dir, "documents").select(F.col("source").alias("cluster_id")))
    return sizes.withColumn("p90", F.round("p90", 6))


_LABELS = "g AS (SELECT doc_id, quality::varchar AS gold, (1 - toxic)::varchar AS pred FROM labels)"


def _raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against the absence of toxicity, as two raters of one question."""
    rows = table(spark, sf_dir, "labels")
    gold = rows.select(F.col("doc_id").alias("item_id"), F.col("quality").cast("string").alias("gold"))
    pred = rows.select(F.col("doc_id").alias("item_id"), (1 - F.col("toxic")).cast("string").alias("pred"))
    return metrics.paired(gold, pred)


_KAPPA = f"{_LABELS}, x AS (SELECT count(*) AS n, avg((gold = pred)::int) AS agreement FROM g), y AS (SELECT sum(a.c * b.c)::double AS gp FROM (SELECT gold AS l, count(*) AS c FROM g GROUP BY 1) a JOIN (SELECT pred AS l, count(*) AS c FROM g GROUP BY 1) b USING (l)), z AS (SELECT n, agreement, gp / n / n AS expected, (agreement - gp / n / n) / (1 - gp / n / n) AS kappa FROM x, y)"


@R.add(f"WITH {_KAPPA} SELECT n, round(agreement, 6) AS agreement, round(expected, 6) AS expected, round(kappa, 6) AS kappa FROM z")
def kappa(spark, sf_dir):
    return metrics.kappa(_raters(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "expected", "kappa")])


@R.add(f"WITH {_LABELS} SELECT gold, pred, count(*) AS n FROM g GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(_raters(spark, sf_dir))


_PRF = "m AS (SELECT l AS label, count(*) FILTER (gold = l AND pred = l)::double AS tp, count(*) FILTER (pred = l) AS claimed, count(*) FILTER (gold = l) AS support FROM g, (SELECT gold AS l FROM g UNION SELECT pred FROM g) GROUP BY l), f AS (SELECT label, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN claimed + support > 0 THEN 2 * tp / (claimed + support) ELSE 0 END AS f1, support FROM m)"


@R.add(f"WITH {_LABELS}, {_PRF} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def per_label_prf(spark, sf_dir):
    return metrics.label_metrics(_raters(spark, sf_dir)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@R.add(f"WITH {_KAPPA}, {_PRF} SELECT n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, CASE WHEN kappa > 0.7 THEN 'trustworthy' WHEN kappa >= 0.5 THEN 'moderate' ELSE 'unreliable' END AS verdict FROM z")
def judge_validation(spark, sf_dir):
    return metrics.judge_validation(_raters(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "macro_f1")], "verdict")


@R.add(f"WITH {_KAPPA} SELECT n, round(kappa, 6) AS kappa, CASE WHEN kappa > 0.8 THEN 'consistent' WHEN kappa >= 0.6 THEN 'acceptable' ELSE 'inconsistent' END AS verdict, (SELECT list(doc_id ORDER BY doc_id) FROM g WHERE gold <> pred) AS disagreements FROM z")
def intra_rater(spark, sf_dir):
    return metrics.intra_rater(_raters(spark, sf_dir)).select("n", F.round("kappa", 6).alias("kappa"), "verdict", "disagreements")


_SCORED = "s AS (SELECT n_chars::double AS score, quality AS label FROM labels JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


@R.add(f"WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s) SELECT round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r")
def auc_roc(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@R.add(f"WITH {_SCORED}, b AS (SELECT min(score) AS low, max(score) AS high FROM s), g AS (SELECT i, low + (high - low) * i / 200 AS t FROM b, range(201) x(i)), f AS (SELECT i, t, sum((score >= t AND label = 1)::int) AS tp, sum((score >= t)::int) AS claimed, sum(label) AS p, count(*) AS n FROM g, s GROUP BY i, t), h AS (SELECT i, t, 2e0 * tp / (claimed + p) AS f1, (n - p - claimed + 2 * tp) / n AS accuracy FROM f) SELECT round(t, 6) AS threshold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (ORDER BY f1 DESC, i) AS k FROM h) WHERE k = 1")
def best_f1_threshold(spark, sf_dir):
    return metrics.best_threshold(_scored(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("threshold", "f1", "accuracy")])


@R.add("WITH s AS (SELECT o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON c_custkey = o_custkey), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM s) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 4) AS mae FROM r")
def spearman_pearson(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return metrics.correlations(rows, "o_totalprice", "c_acctbal").select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), F.round("mae", 4).alias("mae"))
