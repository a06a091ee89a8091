"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Names on the command line time those queries instead; ``all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from exonloom import catalog
from exonloom.session import build_session

HEADLINE = [
    "motif_counts",
    "motif_positions",
    "contained_hits_removed",
    "high_density_hits",
    "hit_locations",
    "location_densities",
    "deletion_metadata",
    "kmer_frequencies",
    "window_extraction",
    "interval_cluster_plus5",
    "interval_overlap_join",
    "interval_exists",
    "interval_subtract",
    "k_nearest_wide",
    "neighbours_level2",
    "inverse_coordinates",
    "annotate_known",
    "insert_novel_exons",
    "effect_summary",
    "variable_positions",
    "quantile_bins",
    "spearman_per_group",
    "mann_whitney_u",
    "greedy_match",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.load()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(known)
    # one small run so that the first query does not pay for the start of JVM and workers
    known["motif_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        if len(sys.argv) > 1:
            print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
