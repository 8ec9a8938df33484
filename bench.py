"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from curatrix.plans import catalog
from curatrix.session import make_session

HEADLINE = (
    "pairwise_cosine_pairs", "knn_topk", "novelty_global", "novelty_centroid", "bm25_search", "hybrid_search", "convex_fusion", "greedy_clusters",
    "graph_degree_stats", "connected_components", "near_dup_documents", "whitening_cosines", "genericize_text", "auc_roc", "best_f1_threshold",
    "audit_summary", "budget_cut", "merge_relink", "veto_gates", "reference_exists", "bayes_beliefs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = make_session(f"local[{cpus}]", cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.log.level": "ERROR"})
    found = catalog.queries()
    # Starts the session's Python workers, which are no query's cost.
    spark.range(cpus).repartition(cpus).mapInPandas(lambda batches: batches, "id long").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
