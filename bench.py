"""Benchmark: headline catalogue queries, noop sink, wall time.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 5), BENCH_QUERIES (comma list, or "all").
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each timing covers building the plan (including its small eager steps such as
bucket bounds or width discovery) and running it to the noop sink.
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
    "job_clip", "job_barcode", "job_clean", "job_scrub", "job_latlong",
    "cut_all_literal", "cut_range_all", "cut_regex_first", "cut_list_order",
    "split_all", "split_regex", "extract_range", "delete_any", "merge_cols",
    "fill_down", "fill_down_part", "row_id", "row_id_text_key", "delete_rows",
    "wrap_n", "wrap_regex", "fold", "unfold", "translate_column", "union_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    from sheaf.plans import catalogue
    from sheaf.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus)), app="sheaf-bench")
    names = os.environ.get("BENCH_QUERIES")
    qs = catalogue.queries()
    if names == "all":
        chosen = [n for n in qs if n != "job_force"]
    elif names:
        chosen = [n for n in names.split(",") if n in qs]
    else:
        chosen = [n for n in HEADLINE if n in qs]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    results: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in chosen:
        try:
            run(name)  # warm-up
            times = [run(name) for _ in range(repeats)]
        except Exception as e:  # noqa: BLE001 - report, keep the JSON line
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        results[name] = round(statistics.median(times), 4)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum of per-query median wall time (noop sink)",
        "value": round(sum(results.values()), 4),
        "unit": "sec",
        "queries": results,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "repeats": repeats,
        "spark": spark.version,
    }
    if failed:
        out["failed"] = failed
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
