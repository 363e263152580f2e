"""Headline queries on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]`; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from paperloom.plans.catalog import QUERIES
from paperloom.plans.fixtures import INPUT_PARTITIONS
from paperloom.session import local_session

HEADLINE = (
    "txt_clean",
    "ext_fields",
    "ext_fields_documents",
    "ext_fields_entities",
    "box_words",
    "box_span",
    "sc_classify_extract",
    "sc_meta_features",
    "sc_primary",
    "ev_report",
    "ev_confusion",
    "smp_head_per_class",
    "cache_merge",
    "agg_pixel_hist",
    "img_hog",
    "img_resize",
    "img_otsu",
    "img_augment",
    "img_gray",
    "ml_hog_svm",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.conf.set(INPUT_PARTITIONS, cpus)  # every given table is one row group
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    for name in ("ext_fields", "img_hog"):
        QUERIES[name](spark, sf).limit(1).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
