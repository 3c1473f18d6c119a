"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names or ``all``), BENCH_RUNS (default 2; best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewell import catalog  # noqa: E402
from tidewell.session import local_session  # noqa: E402

HEADLINE = [
    "i01_bm25", "i01_postings", "i02_cosine_knn", "i04_hybrid_search", "i06_feature_hash_embedding", "f01_rerank_topk",
    "a03_html_main_text", "j01_chunk_texts", "j02_sources_after_ingest", "j03_exact_duplicates", "j05_gazetteer_extraction",
    "a05_log_text_scan", "e02_snapshot_changes", "e03_encounter_segments", "d07_encounter_ability_metrics", "d08_aura_uptime",
    "b06_fight_inclusion", "c10_expected_vs_observed", "d09_per_boss_report", "d21_trial_statistics", "d04_effective_trust",
    "c04_outgoing_neighbours", "c12_endpoint_resolution", "d20_relationship_merge", "f03_graph_search_card", "f04_memory_recall",
    "d13_trajectory_precision", "d18_strategy_reinforcement", "j04_freshness_outcomes", "j08_damage", "k01_streaming_encounters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "")
    wanted = list(catalog.QUERIES) if names == "all" else [n for n in names.split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in wanted:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
