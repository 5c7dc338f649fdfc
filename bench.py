"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``, forcing the full result with a ``noop`` write, and
prints ONE JSON line: ``{"metric", "value", "unit", "queries", "sf", ...}``.
``value`` is the sum of the per-query medians. A warm-up run of the flagship
query comes first; ``$BENCH_REPEAT`` (default 1) runs per query, median kept.
Every run starts from the raw tables (the registry of written stages is
cleared), so each number includes the stages the query depends on.

``queries_stages_written`` times each query once more with the stages it
reads (basket tables, merged lines, Pareto lines, feature table) already
written in this session — the hand-off the reference itself uses between
its scripts — so it shows the cost of the operator alone.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "basket_lines",
    "sticky",
    "pareto_lines",
    "feature_table",
    "sticky_matrix",
    "segment_extremes_products",
    "soft_assignment",
    "silhouette_sq_basket",
    "kmeans_segments",
    "profile_describe",
    "dec_refine",
    "dec_train_encoder",
    "autoencoder_gradient",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from basketry.session import local_session
    from basketry.plans.catalog import QUERIES
    from basketry.sources.storage import forget

    spark = local_session(cpus, shuffle_partitions=max(2 * cpus, 8), app="basketry-bench")

    def run(name: str, cold: bool = True) -> float:
        if cold:
            forget()  # start from the raw tables: no stage written by an earlier run is reused
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("sticky")  # warm-up: JVM, code generation, file listing
    timings: dict[str, float] = {}
    for name in names:
        runs = [run(name) for _ in range(repeat)]
        timings[name] = round(statistics.median(runs), 3)
    forget()
    run("feature_table")  # writes the shared stages once
    staged = {name: round(run(name, cold=False), 3) for name in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "queries_stages_written": staged,
        "stages_written_total": round(sum(staged.values()), 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
        "protocol": "cold per run: raw parquet -> fixture tables -> stages -> query, forced by a noop write",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
