"""Time the headline queries, each from a cold workspace, and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from depweave.plans.catalog import CATALOG  # noqa: E402
from depweave.plans.workspace import TableWorkspace  # noqa: E402
from depweave.session import local_session  # noqa: E402

HEADLINE = (
    "hubs",
    "hotspots",
    "cycles",
    "rule_violations",
    "health_score",
    "impact_report",
    "node_metrics",
    "blast_radius",
    "churn",
    "evolution_insights",
    "dependency_changes",
    "branch_report",
    "import_resolution",
    "code_graph_edges",
    "external_packages",
    "keyword_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "depweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["hubs"](TableWorkspace(spark, sf_dir)).collect()  # starts the JVM and its compiler
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CATALOG[name](TableWorkspace(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
