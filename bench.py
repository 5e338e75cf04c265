"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the local parallelism. Every query runs to its last row; lazy results are written
to Spark's no-op sink, and each query is timed once after one shared warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.queries import all_queries  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = """
table_profile profile_lineitem profile_unique column_profile top_values_by_column infer_types merged_profile
drop_duplicates fill_median fill_mode fill_forward fill_forward_by_user cap_outliers drop_outliers
cleaning_plan clean_orders compare_before_after
target_regression class_weights feature_correlations feature_suggestions feat_target_mean
histogram kde correlation_matrix nullity_matrix box_stats
text_chunks vector_topk hashed_embeddings
q_structured c_rank c_cumsum c_rolling c_asof c_cube
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            # Small files: split them over the cores.
            "spark.sql.files.maxPartitionBytes": "2m",
            "spark.sql.files.openCostInBytes": "512k",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    queries["q_row_count"](spark, sf_dir).collect()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
