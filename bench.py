"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the cores. Every query is run once to the end of its plan without keeping its rows.
"""

from __future__ import annotations

import json
import os
import time

from sievelake.plans import QUERIES
from sievelake.session import local_session

HEADLINE = [
    "screening_funnel", "dedup_greedy", "dedup_merged_fields", "concept_filter", "keyword_exclusion_standard",
    "keyword_report", "venue_resolution", "rank_notes", "key_collisions", "issn_lookup", "gold_matches",
    "gold_fuzzy_titles", "titles_in_documents", "quote_spans", "span_agreement", "citation_hop", "citation_fallback",
    "source_overlap", "export_completeness", "kappa_by_pair", "assignment", "pairs_assigned", "consensus_list",
    "fulltext_final", "year_histogram", "global_ranks", "unmatched_nearest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, "sievelake-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
