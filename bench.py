"""Headline queries on one machine; prints one JSON line.

Every query is written to a sink that discards rows, so all columns are computed. Times are the best of two
runs; the first one also pays for starting Python workers and compiling code.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pageloom.session import local_session, tune  # noqa: E402
from registry.queries import QUERIES  # noqa: E402

HEADLINE = [
    "tok1_token_kinds", "tok7_plaintext", "ext1_heuristic", "mta10_jsonld_override_x", "mta13_null_drop_x", "lnk1_extract_links",
    "lnk1_extract_links_x", "crl3_prefix_x", "img4_image_set_x", "mth2_mathjax_script_x", "tbl4_table_cells_x", "cod3_code_blocks_x",
    "md14_convert", "md14_convert_x", "txt1_word_count", "rpt3_token_savings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = tune(local_session(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        best = None
        for _run in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "pages": pages,
        "pages_per_second": {n: round(pages / seconds[n], 1) for n in names if not n.startswith("txt")}}))


if __name__ == "__main__":
    main()
