"""Benchmark the headline queries.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is timed end to end (plan + full execution into a no-op sink,
so nothing is collected to the driver).  Queries share the parsed corpus,
which is built and checkpointed once; its cost is reported separately as
``parse_corpus`` and is part of the total.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "py_metadata",
    "all_functions",
    "dependency_edges",
    "file_dependents",
    "module_rollup",
    "min_path_cover",
    "describe_paths",
    "attempt_loop",
    "extract_python",
    "fill_template",
    "render_context",
    "apply_changes",
    "retry_loop",
    "stream_attempts",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    os.environ["BENCH_CPUS"] = cpus
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from codeloom.plans import context as C
    from codeloom.plans.queries import REGISTRY
    from codeloom.session import get_spark

    spark = get_spark(master=f"local[{cpus}]")
    times: dict[str, float] = {}

    t0 = time.time()
    C.meta(spark, sf_dir)
    times["parse_corpus"] = round(time.time() - t0, 3)
    t0 = time.time()
    C.function_paths(spark, sf_dir)
    times["parse_paths"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        t0 = time.time()
        _run(REGISTRY[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
