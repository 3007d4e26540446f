"""Seconds per headline query; one JSON line on standard output.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Results go to the no-op sink, so that
every row and column is computed and nothing is collected. With `--all` every registered query runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from gleanline.plans import catalog
from gleanline.session import local_session

HEADLINE = [
    "n02_collapse", "n03_comparison_key", "n14_salary_from_text", "n19_normalise",
    "s08_feed_jsearch", "s14_feed_workable",
    "d01_simhash", "d04_same_content", "d05_groups", "d06_merge", "d09_match_stored",
    "f02_first_reason", "f13_experience_months",
    "r05_ngram_counts", "r06_bm25", "r08_cosine", "r10_hybrid_rank", "r13_finalists",
    "g04_weighted_total", "g06_upsert_results", "c04_best_weights",
    "t04_correlate", "t07_fold_statuses", "t12_daily_cap",
    "v02_numbers", "v07_verdicts", "q05_pick_best",
    "w01_match_list", "w13_response_rates", "w15_usage_summary",
]


def spread(spark, folder: str, cpus: str) -> str:
    """A copy of the tables whose text tables lie in a file per core: the given files hold one row group each."""
    copy = tempfile.mkdtemp(prefix="spark-")
    for name in sorted(os.listdir(folder)):
        if name in ("documents.parquet", "pages.parquet"):
            spark.read.parquet(f"{folder}/{name}").repartition(int(cpus)).write.parquet(f"{copy}/{name}")
        elif name.endswith(".parquet"):
            os.symlink(f"{folder}/{name}", f"{copy}/{name}")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(catalog.QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    # The first query pays for the JVM and the Python workers; run one that is not timed.
    data = spread(spark, folder, cpus)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if "--all" in sys.argv:
            print(f"T {name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
