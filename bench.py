"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion with the ``noop`` sink (every row computed,
nothing collected); the value per query is the median of 3 warm runs after
one warm-up.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire import catalog  # noqa: E402
from quire.session import get_spark  # noqa: E402

HEADLINE = ["blocks", "html_marks", "event_sequences", "fragments_substring", "typed_blocks", "prose_blocks",
            "event_patterns", "fragments_exact", "tree_walk", "line_index", "weave", "defined_in", "symbols",
            "mention_rows", "html_depth", "read_fragments", "references", "docstrings", "nest_tree"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(f"local[{cpus}]", partitions=cpus * 2, app="quire-bench")
    catalog.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]

        def once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
