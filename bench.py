"""Times the headline queries over whole tables and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores.
Every query runs in full into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "new_country_spread",
    "geo_spread_alerts",
    "same_ip_reuploads",
    "rapid_spread",
    "create_alerts",
    "location_summary",
    "near_duplicate_join",
    "lsh_candidates",
    "tiered_lookup",
    "assign_parents",
    "generations",
    "find_origin",
    "family_tree",
    "forensic_report",
    "acknowledge",
    "listener_messages",
    "upsert_registry",
    "registry_stats",
    "fuse_scores",
    "parse_verdict_reply",
    "pair_correlation",
    "dct_lowfreq",
    "frame_quality",
    "exact_duplicate_groups",
    "node_stats",
    "stream_spread_counts",
    "stream_velocity",
]


def main() -> None:
    from trailmark.plans.catalog import QUERIES
    from trailmark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # one throw-away query, so that starting the JVM is not charged to the first
    QUERIES["country_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
