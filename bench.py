"""Headline timings. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from feedloom.plans import catalog  # noqa: E402
from feedloom.session import build_session  # noqa: E402

HEADLINE = (
    "recommended",
    "nearest_unseen",
    "profile_vectors",
    "creator_affinity",
    "popularity",
    "recent_items",
    "tag_source",
    "trending_source",
    "fresh_source",
    "explore_source",
    "similar_source",
    "encoded_vectors",
    "frame_plan",
    "frame_dedup",
    "ingest_outcomes",
    "label_summary",
    "cost_inputs",
    "run_statistics",
    "feed_active",
    "feed_pages",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("recommended", "nearest_unseen"):  # start the workers and fill the code cache on the smallest scale
        catalog.QUERIES[name](spark, str(Path(sf_dir).parent / "sf0.001")).count()
    times: dict[str, float] = {}
    users = 0
    for name in HEADLINE:
        start = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        if name == "recommended":
            users = df.select("user_id").distinct().count()
        else:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
                "users_ranked": users, "users_per_second": round(users / times["recommended"], 1), "ms_per_user": round(1000 * times["recommended"] / max(1, users), 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
