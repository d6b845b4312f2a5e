"""Times the registered queries and prints one JSON line.

``BENCH_SF_DIR`` names the input (default sf0.1), ``BENCH_CPUS`` the local cores (default 8), ``BENCH_RUNS`` the timed
runs of a headline query after one warm-up (default 3); the others run once after theirs. A time covers planning and running
to the last row. The value is the sum of the headline queries' medians; a query that fails is named in ``failed`` instead.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagework.plans.catalog import QUERIES
from pagework.session import build_session

HEADLINE = [
    "c3_split_every_n", "c4_extract_all", "c1_split_by_ranges", "c2_split_at_pages", "c5_remove_pages", "c6_organize_pages",
    "c8_duplicate_pages", "c9_delete_pages", "c10_move_page", "c11_merge_docs", "c12_number_pages", "c13_crop_pages",
    "c14_place_watermark", "c16_watermark_summary", "c17_render_plan", "b1_spec_split", "b4_spec_watermark",
    "b6_spec_form", "b9_invert_selection", "b11_compact_selection", "b12_selection_summary", "d2_extract_tag", "d3_resolve_metadata",
    "e1_extractable_images", "e3_remove_images", "e4_recompress_plan", "e5_dedupe_images", "f2_cap_index",
    "f3_search_index", "f6_effective_opens", "g1_validate_requests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    taken, failed = {}, {}
    for key in [*HEADLINE, *sorted(set(QUERIES) - set(HEADLINE))]:
        try:
            seconds(key)
            taken[key] = round(statistics.median(seconds(key) for _ in range(runs if key in HEADLINE else 1)), 3)
        except Exception as error:  # one query's failure must not cost the others' figures
            failed[key] = str(error).splitlines()[0][:200]
    found = re.search(r"sf([0-9.]+)", sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median seconds, headline queries",
                "value": round(sum(taken[key] for key in HEADLINE if key in taken), 3),
                "unit": "sec",
                "queries": taken,
                "failed": failed,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
