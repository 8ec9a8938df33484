"""Queries over records: references, validation, vetoes, batches, audit logs, knowledge maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import batch, entities, knowledge, metrics, proposals
from curatrix.operators.entities import Reference
from curatrix.plans.registry import Registry, table
from curatrix.sources import audit, stores

R = Registry()

SPECS = [Reference("order", "customer", "customer"), Reference("customer", "nation", "nation"), Reference("supplier", "nation", "nation"), Reference("lineitem", "part", "part")]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    return {
        "order": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")),
        "customer": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")),
        "supplier": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
        "nation": t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")),
        "part": t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "lineitem": t("lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_partkey").alias("part")),
    }


_REFS = "r AS (SELECT c_nationkey::varchar AS target_id, 'customer' AS source, 'nation' AS field, c_custkey::varchar AS source_id FROM customer UNION ALL SELECT s_nationkey::varchar, 'supplier', 'nation', s_suppkey::varchar FROM supplier)"


@R.add(f"WITH {_REFS} SELECT * FROM r")
def find_references(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return entities.find_references(SPECS, t, "nation", t["nation"].select("id"))


def _merges(nation: DataFrame) -> DataFrame:
    """Every nation into the first one of its region."""
    first = nation.groupBy("region").agg(F.min("id").alias("target_id"))
    return nation.join(first, "region").where(F.col("id") != F.col("target_id")).select(F.col("id").alias("source_id"), "target_id")


@R.add("SELECT c_custkey AS id, (SELECT min(n2.n_nationkey) FROM nation n1 JOIN nation n2 USING (n_regionkey) WHERE n1.n_nationkey = c_nationkey)::int AS nation FROM customer")
def merge_relink(spark, sf_dir):
    t = _tables(spark, sf_dir)
    out, _ = entities.merge(SPECS, t, "nation", _merges(t["nation"]))
    return out["customer"].select("id", "nation")


@R.add("WITH m AS (SELECT n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey)) SELECT 'customer' AS source, c_custkey::varchar AS id, 'relinked' AS action FROM customer WHERE c_nationkey IN (SELECT n FROM m) UNION ALL SELECT 'supplier', s_suppkey::varchar, 'relinked' FROM supplier WHERE s_nationkey IN (SELECT n FROM m) UNION ALL SELECT 'nation', n::varchar, 'merged' FROM m")
def merge_log(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return entities.merge(SPECS, t, "nation", _merges(t["nation"]))[1]


@R.add(f"WITH {_REFS} SELECT target_id, count(*) AS n FROM r GROUP BY target_id")
def delete_blocked(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return entities.find_references(SPECS, t, "nation", t["nation"].select("id")).groupBy("target_id").agg(F.count("*").alias("n"))


@R.add("SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def delete_forced(spark, sf_dir):
    t = _tables(spark, sf_dir)
    used = t["supplier"].select(F.col("nation").alias("id")).distinct()
    return entities.delete(SPECS, t, "nation", used, force=True).select("id")


@R.add("SELECT 'customer' AS kind, c_custkey::varchar AS id, 'required_field' AS rule, 'error' AS severity, 'segment is missing' AS message FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment = ''")
def validate_required(spark, sf_dir):
    return entities.required_field(_tables(spark, sf_dir)["customer"], "customer", "segment")


@R.add("SELECT 'order' AS kind, o_orderkey::varchar AS id, 'valid_values' AS rule, 'error' AS severity, 'status is ' || o_orderstatus || ', not one of F, O' AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def validate_values(spark, sf_dir):
    return entities.valid_values(_tables(spark, sf_dir)["order"], "order", "status", ["O", "F"])


@R.add("SELECT 'customer' AS kind, c_custkey::varchar AS id, 'conditional_required' AS rule, 'warning' AS severity, 'note is missing though the balance is negative' AS message FROM customer WHERE c_acctbal < 0")
def conditional_required(spark, sf_dir):
    rows = _tables(spark, sf_dir)["customer"].withColumn("note", F.lit(None).cast("string"))
    return entities.conditional_required(rows, "customer", F.col("balance") < 0, "note", "the balance is negative", "warning")


_LOST = "SELECT 'lineitem' AS kind, l_orderkey || '-' || l_linenumber AS id, 'reference_exists' AS rule, 'error' AS severity, 'part refers to part/' || l_partkey AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"


@R.add(_LOST)
def reference_exists(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return entities.reference_exists(t["lineitem"], SPECS[3], t["part"])


_ORPHANS = "SELECT 'customer' AS kind, c_custkey::varchar AS id, 'no_orphans' AS rule, 'warning' AS severity, 'nothing refers to it' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


@R.add(_ORPHANS)
def no_orphans(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return entities.no_orphans(t["customer"], "customer", SPECS, t)


@R.add(f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM ({_LOST} UNION ALL {_ORPHANS})")
def validation_summary(spark, sf_dir):
    return entities.validation_summary(reference_exists(spark, sf_dir).unionByName(no_orphans(spark, sf_dir)))


_PAIRED = "p AS (SELECT a.c_custkey AS id_a, b.c_custkey AS id_b, a.c_acctbal AS x, b.c_acctbal AS y, coalesce(ra.n, 0) AS ra, coalesce(rb.n, 0) AS rb FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey LEFT JOIN o ra ON ra.o_custkey = a.c_custkey LEFT JOIN o rb ON rb.o_custkey = b.c_custkey)"
_COUNTS = "o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"
_INITIAL = "left(x::bigint::varchar, 1) <> left(y::bigint::varchar, 1)"
_RATIO = "NOT ((greatest(ra, rb) >= 3 AND least(ra, rb) <= 2) OR (least(ra, rb) > 0 AND greatest(ra, rb) / least(ra, rb) >= 5))"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers of one nation and segment, with the balance's first character as a code, the orders as references, and debt."""
    t = _tables(spark, sf_dir)
    n = t["order"].groupBy(F.col("customer").alias("id")).agg(F.count("*").alias("references"))
    c = t["customer"].join(n, "id", "left").select("id", "nation", "segment", F.struct(F.left(F.round("balance").cast("bigint").cast("string"), F.lit(1)).alias("code"), F.coalesce("references", F.lit(0)).alias("references"), F.coalesce(F.col("balance") < 0, F.lit(False)).alias("debt")).alias("s"))
    left, right = c.select("nation", "segment", F.col("id").alias("id_a"), F.col("s").alias("a")), c.select("nation", "segment", F.col("id").alias("id_b"), F.col("s").alias("b"))
    return left.join(right, ["nation", "segment"]).where("id_a < id_b").select("id_a", "id_b", "a", "b")


@R.add(f"WITH {_COUNTS}, {_PAIRED} SELECT id_a, id_b, CASE WHEN {_INITIAL} THEN 'initial_match: code starts differently' WHEN {_RATIO} THEN 'reference_ratio: neither is clearly the minor one' END AS reason, NOT ({_INITIAL} OR {_RATIO}) AS accepted FROM p")
def veto_gates(spark, sf_dir):
    gates = [entities.initial_match("code"), entities.reference_ratio(number=True)]
    return entities.vetoed(_candidates(spark, sf_dir), gates).select("id_a", "id_b", "reason", "accepted")


@R.add(f"WITH {_COUNTS}, {_PAIRED}, x AS (SELECT id_a, id_b FROM p WHERE x < 0 AND y < 0) SELECT p.id_a, p.id_b, CASE WHEN x.id_a IS NOT NULL THEN 'excluded: listed as distinct' END AS reason, x.id_a IS NULL AS accepted FROM p LEFT JOIN x USING (id_a, id_b)")
def exclusion_pairs(spark, sf_dir):
    return entities.vetoed(_candidates(spark, sf_dir), [entities.both_listed("debt")]).select("id_a", "id_b", "reason", "accepted")


@R.add("SELECT 'Modify customer ' || c_custkey AS title, 'pending' AS status, 1::int AS n FROM customer WHERE c_acctbal < 0")
def proposed_changes(spark, sf_dir):
    before = _tables(spark, sf_dir)["customer"]
    after = before.withColumn("balance", F.greatest("balance", F.lit(0.0)))
    return proposals.create_modify(before, after, "customer", ["name", "balance"]).select("title", "status", F.size("changes").alias("n"))


@R.add("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return batch.status_counts(_tables(spark, sf_dir)["order"])


@R.add("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def pending_items(spark, sf_dir):
    orders = _tables(spark, sf_dir)["order"]
    current = orders.select(F.col("id").cast("string").alias("item_id"), F.when(F.col("status") == "F", "done").otherwise("open").alias("status"))
    return batch.pending(orders.select("id"), current)


@R.add("SELECT o_orderkey AS id, round(running, 2) AS running FROM (SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) WHERE running <= 1e8")
def budget_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.col("o_totalprice").alias("cost"))
    cut = batch.budget_cut(rows, 1e8, [F.col("o_orderdate"), F.col("id")])
    return cut.where("committed").select("id", F.round("running", 2).alias("running"))


@R.add("SELECT o_orderkey AS id, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 20)::bigint AS batch FROM orders")
def numbered_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return batch.numbered_batches(rows, [F.col("o_orderdate"), F.col("id")], 20).select("id", "batch")


def _glance(pdf: pd.DataFrame) -> pd.DataFrame:
    big = pdf.price > 300_000
    return pd.DataFrame({"item_id": pdf.id.astype(str), "status": big.map({True: "flagged", False: "verified"}), "cost": 0.5, "confidence": big.map({True: 0.4, False: 0.9})})


def _study(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"item_id": pdf.id.astype(str), "status": "verified", "cost": 2.0, "confidence": 0.99})


@R.add("SELECT o_orderkey::varchar AS item_id, CASE WHEN o_totalprice > 300000 THEN 'needs_review' ELSE 'done' END AS status, 0.5e0 AS cost, 'glance' AS tier FROM orders UNION ALL SELECT o_orderkey::varchar, 'done', 2e0, 'study' FROM orders WHERE o_totalprice > 300000")
def tier_escalation(spark, sf_dir):
    items = _tables(spark, sf_dir)["order"].select("id", "price")
    return batch.run_tiers(items, [("glance", _glance), ("study", _study)]).select("item_id", "status", "cost", "tier")


@R.add("SELECT tier, string_agg(status || '=' || n, ', ' ORDER BY status) AS summary FROM (SELECT tier, status, count(*) AS n FROM (SELECT 'glance' AS tier, CASE WHEN o_totalprice > 300000 THEN 'needs_review' ELSE 'done' END AS status FROM orders UNION ALL SELECT 'study', 'done' FROM orders WHERE o_totalprice > 300000) GROUP BY ALL) GROUP BY tier")
def tier_summary(spark, sf_dir):
    orders = _tables(spark, sf_dir)["order"]
    counts, _ = batch.tier_status(tier_escalation(spark, sf_dir), orders.select("id"))
    return batch.status_line(counts)


@R.add("SELECT user_id::varchar AS item_id, arg_max(event_type, event_id) AS status, round(sum(value), 6) AS cost FROM events GROUP BY 1")
def folded_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("value").alias("cost"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"))
    return batch.state(rows).select("item_id", "status", F.round("cost", 6).alias("cost"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit entries: a user is an item, the event's type its action and tier, the value its cost."""
    e = table(spark, sf_dir, "events")
    none = f"struct<status:string,type:string,operations:array<{audit.OPERATION}>>"
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("user_id").cast("string").alias("item_id"), F.col("event_type").alias("action"), F.lit(None).cast(none).alias("details"), F.col("value").alias("cost"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("tier"))


_ENTRIES = "x AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id::varchar AS item_id, event_type AS action, value AS cost, CASE event_type WHEN 'view' THEN 'unknown' ELSE event_type END AS tier FROM events)"
_TOTALS = "count(*) AS entries, count(DISTINCT item_id) AS items, count(*) FILTER (action = 'error') AS errors, round(sum(cost), 4) AS cost"


@R.add(f"WITH {_ENTRIES} SELECT 'all' AS scope, '' AS value, {_TOTALS} FROM x UNION ALL SELECT 'action', action, {_TOTALS} FROM x GROUP BY action UNION ALL SELECT 'tier', tier, {_TOTALS} FROM x GROUP BY tier")
def audit_summary(spark, sf_dir):
    return audit.summary(_entries(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


@R.add(f"WITH {_ENTRIES} SELECT item_id, action AS type, max(ts) AS ts FROM x WHERE action IN ('view', 'purchase') GROUP BY ALL")
def audit_latest_ops(spark, sf_dir):
    key = F.concat_ws("/", "item_id", "type")
    return audit.operations(_entries(spark, sf_dir), ["view", "purchase"], key).select("item_id", "type", "ts")


@R.add(f"WITH {_ENTRIES} SELECT ts, item_id, action FROM x WHERE ts >= '2024-01-15'")
def audit_since(spark, sf_dir):
    return _entries(spark, sf_dir).where(F.col("ts") >= "2024-01-15").select("ts", "item_id", "action")


@R.add("SELECT date_trunc('day', ts)::timestamp AS day, event_type AS tier, count(*) AS entries, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def events_daily_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("tier")).agg(F.count("*").alias("entries"), F.round(F.sum("value"), 4).alias("cost"))


@R.add("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version(spark, sf_dir):
    return stores.latest(table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("v"), "event_id", "event_type"), "user_id", "v").select("user_id", "event_id", "event_type")


@R.add("SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 2e0 ELSE 1e0 END AS mtime FROM orders WHERE o_orderstatus = 'P'")
def stale_documents(spark, sf_dir):
    orders = _tables(spark, sf_dir)["order"]
    known = orders.select(F.col("id").alias("path"), F.lit(1.0).alias("mtime"))
    return stores.stale(orders.select(F.col("id").alias("path"), F.when(F.col("status") == "P", 2.0).otherwise(1.0).alias("mtime")), known)


@R.add("SELECT d.doc_id AS path, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS collection FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def upserted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("collection"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.lit("labelled").alias("collection"))
    return stores.upsert(docs, new.join(docs.select("path"), "path", "left_semi"), "path")


@R.add("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, list(DISTINCT source ORDER BY source) AS collections, count(vec_id) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def index_stats(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = table(spark, sf_dir, "documents").join(vec, "doc_id", "left").select(F.col("doc_id").alias("doc_path"), F.col("source").alias("collection"), "embedding")
    return stores.index_stats(chunks)


# A learner's map: an event type is a topic, its share of large values the belief that the user knows it.

NODES = [
    {"id": "view", "title": "View", "level": 1, "obscurity": 1, "prerequisites": []},
    {"id": "click", "title": "Click", "level": 1, "obscurity": 2, "prerequisites": ["view"]},
    {"id": "signup", "title": "Sign up", "level": 2, "obscurity": 3, "prerequisites": ["click"]},
    {"id": "purchase", "title": "Purchase", "level": 2, "obscurity": 4, "prerequisites": ["signup", "click"]},
    {"id": "error", "title": "Error", "level": 3, "obscurity": 5, "prerequisites": []},
]
_NODES = "n(node, level) AS (VALUES ('view', 1), ('click', 1), ('signup', 2), ('purchase', 2), ('error', 3))"
_LINKS = "l(before, after) AS (VALUES ('view', 'click'), ('click', 'signup'), ('signup', 'purchase'), ('click', 'purchase'))"
_BELIEFS = "b AS (SELECT user_id AS session_id, event_type AS node, round(avg((value > 35)::int), 6) AS p FROM events GROUP BY ALL)"
_ENTROPY = "CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END"


def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(F.avg((F.col("value") > 35).cast("int")), 6)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("node")).agg(p.alias("p"))


def _nodes(spark: SparkSession) -> DataFrame:
    return knowledge.node_table(spark, knowledge.Graph(NODES))


@R.add(f"WITH {_BELIEFS}, {_NODES} SELECT session_id, level, count(*) FILTER (p >= 0.7) AS known, count(*) FILTER (p <= 0.2) AS unknown, count(*) FILTER (p > 0.2 AND p < 0.7) AS uncertain, count(*) AS total, round(100e0 * count(*) FILTER (p >= 0.7) / count(*), 1) AS percent_known FROM b JOIN n USING (node) GROUP BY ALL")
def coverage_report(spark, sf_dir):
    return knowledge.coverage(_beliefs(spark, sf_dir), _nodes(spark))


@R.add(f"WITH {_BELIEFS}, {_LINKS}, i AS (SELECT DISTINCT b.session_id, b.node, 'inner' AS fringe FROM b JOIN l ON l.before = b.node JOIN b c ON c.session_id = b.session_id AND c.node = l.after WHERE b.p >= 0.7 AND c.p < 0.7), o AS (SELECT b.session_id, b.node, 'outer' AS fringe FROM b WHERE b.p < 0.7 AND NOT EXISTS (SELECT 1 FROM l LEFT JOIN b c ON c.session_id = b.session_id AND c.node = l.before WHERE l.after = b.node AND NOT coalesce(c.p >= 0.7, false))) SELECT * FROM i UNION ALL SELECT * FROM o")
def fringes(spark, sf_dir):
    return knowledge.fringes(_beliefs(spark, sf_dir), knowledge.links(_nodes(spark)))


@R.add(f"WITH {_BELIEFS} SELECT session_id, round(sum({_ENTROPY}), 6) AS entropy, count(*) FILTER (p > 0.2 AND p < 0.8) AS open, count(*) FILTER (p > 0.2 AND p < 0.8) <= 3 AS converged FROM b GROUP BY session_id")
def entropy_rank(spark, sf_dir):
    return knowledge.converged(_beliefs(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@R.add(f"WITH {_BELIEFS} SELECT session_id, coalesce(list(node ORDER BY -p, node) FILTER (p >= 0.7), []) AS known, coalesce(list(node ORDER BY p, node) FILTER (p <= 0.2), []) AS unknown FROM b GROUP BY session_id")
def coverage_lists(spark, sf_dir):
    return knowledge.coverage_lists(_beliefs(spark, sf_dir)).select("session_id", "known", "unknown")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    level = F.when(v < 10, "none").when(v < 30, "heard_of").when(v < 60, "basic").when(v < 120, "solid").otherwise("deep")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("node"), level.alias("familiarity"))


@R.add()
def bayes_beliefs(spark, sf_dir):
    return knowledge.simulated(knowledge.Graph(NODES), _answers(spark, sf_dir), bayesian=True).withColumn("p", F.round("p", 9))


@R.add()
def heuristic_beliefs(spark, sf_dir):
    return knowledge.simulated(knowledge.Graph(NODES), _answers(spark, sf_dir)).withColumn("p", F.round("p", 9))


@R.add()
def probing_trials(spark, sf_dir):
    trials = spark.createDataFrame([(i, s) for i in range(20) for s in ("eig", "entropy", "random", "level", "degree")], "trial bigint, strategy string")
    runs = knowledge.probing_trials(knowledge.Graph(knowledge.tree(12)), trials, 6, overclaim=0.15)
    return runs.groupBy("strategy", "asked").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.avg("entropy"), 6).alias("entropy"))


@R.add("SELECT round(avg(o_totalprice), 4) AS price_mean, round(avg(b), 4) AS balance_mean, count(*) FILTER (o_totalprice > b) AS wins, count(*) FILTER (o_totalprice < b) AS losses, count(*) FILTER (o_totalprice = b) AS ties FROM (SELECT o_totalprice, c_acctbal * 30 AS b FROM orders JOIN customer ON c_custkey = o_custkey)")
def means_and_wins(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rows = t["order"].join(t["customer"].select(F.col("id").alias("customer"), (F.col("balance") * 30).alias("balance")), "customer")
    return metrics.means_and_wins(rows, "price", "balance").withColumns({c: F.round(c, 4) for c in ("price_mean", "balance_mean")})
