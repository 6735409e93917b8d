"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricemesh.plans.queries import registered  # noqa: E402
from pricemesh.session import local_session  # noqa: E402

HEADLINE = [
    "offer_rollup", "offers_sorted_price_asc", "group_sort_delivery_fastest", "attributes_inferred", "document_tokens",
    "corpus_idf", "search_coverage", "pair_scores", "product_components", "canonical_products", "title_identity",
    "feed_shopping", "rule_groups", "upsert", "enrich_notes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pricemesh-bench")
    every = registered()
    # Warm the session on one small read, then time each query once.
    spark.read.parquet(f"{folder}/part.parquet").count()
    took = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {took[name]} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
