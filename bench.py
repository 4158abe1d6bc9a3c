"""Time the headline queries: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one JSON line out.

Each query is run once to warm up on the same data, then timed twice, plan
building and stored intermediates included; the better time is reported.
Results go to the no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

from askframe import catalog
from askframe.cluster import session

HEADLINE = [
    "tfidf_topk",
    "sparse_context",
    "vector_topk",
    "vector_topk_stored",
    "vector_topk_in_cells",
    "dense_context",
    "two_stage_context",
    "sentencize",
    "tokenize",
    "context_word_budget",
    "render_prompt",
    "softmax_over_options",
    "hits_report",
    "model_correlation",
    "grid_scores_percent",
    "refine_weights",
    "line_scores",
    "nearest_centroid",
    "kmeans",
    "seeded_split",
    "completed_transitions",
    "learning_curve",
    "stream_completed",
]


def run(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(
        "askframe-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, sf, name)
        seconds[name] = round(min(run(spark, sf, name) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(pathlib.Path(sf).name.removeprefix("sf")) if pathlib.Path(sf).name.startswith("sf") else sf,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
