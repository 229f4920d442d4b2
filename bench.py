"""Seconds per query: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from cloakframe.plans.catalog import QUERIES
from cloakframe.session import local_session

# One query per kind of work; the stored dictionary is built by dict_store before those that use it.
HEADLINE = """
corpus_profile occurrences symbols_by_rule dict_build dict_multi_table dict_merge dict_reverse
mask_level1 mask_level2 mask_rename mask_personal_data strip_comments literals_extract literals_string_class mask_literals
sections unmask unmask_zones section_changes confidence change_blocks change_describe
risk_patterns risk_score risk_rollup audit_recent audit_totals naming_advice stub_speculation
stream_audit stream_totals stream_mask
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
