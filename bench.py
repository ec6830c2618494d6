"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query is run to its last row into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from weighbridge.plans.catalog import QUERIES
from weighbridge.session import local_session

HEADLINE = (
    "d13_contamination_report", "d01_take_k", "d04_multi_quota", "d05_staged_splits", "d06_balanced_binary", "d14_overlap_matrix", "d16_state_overlap",
    "e04_report_lines", "e21_four_way_lines", "e23_consistency_lines", "k02_trials_lines", "e07_latency_overall", "e07_latency_stats",
    "e04_report", "e22_flip_confidence", "e31_release_gates", "k02_fit_grid", "r02_readout_chunked", "r05_replay_audit",
    "c06_convert_scenarios", "c10_skip_report", "c12_validate_requests", "c14_context_probes", "t01_build_prompts", "g01_telemetry_stream", "v02_block_drift",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, cores)
    spark.range(1).write.format("noop").mode("overwrite").save()  # start the executor threads
    QUERIES["e02_summarize"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up and code generation are not measured
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
