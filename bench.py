"""Time the headline queries and print one JSON line.

Shared inputs (write log, contexts, registers, history) are computed before the clock
starts, because they stand in for stored tables. Every query first runs once untimed, so
that code generation and JIT warm-up are left out, then once timed to its full result.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark import session
from tidemark.catalog import queries
from tidemark.fixtures import Inputs

HEADLINE = {
    "conflicts_now": ["c1_register_join", "c8_conflict_list"],
    "arrival_order_join": ["c4_assign_seq", "c3_dedupe_writes", "c2_register_join_arrival"],
    "retention_and_orphans": ["h4_retention_plan", "h5_retention_summary", "h6_orphan_blobs"],
    "snapshot_diff": ["j10_snapshot_diff"],
    "chunk_dedup": ["d4_dedup_stats_cdc", "d2_build_manifest"],
    "discount_preview": ["p17_preview_discounts", "p18_apply_discount"],
    "debounce_batch": ["e1_debounce_batch"],
    "history_base": ["j7_history_base"],
    "resolve_conflicts": ["m4_resolve"],
    "settings_merge": ["s4_field_map_merge", "s6_orset_merge"],
}


def run(spark, registered, folder: str, parts: list[str]) -> float:
    start = time.perf_counter()
    for part in parts:
        registered[part](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", int(cpus) if cpus.isdigit() else None, "tidemark-bench",
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs(spark, folder)
    for name in ("w", "c", "arr", "registers", "checkouts"):
        getattr(inputs, name)().count()
    registered = queries()
    spent: dict[str, float] = {}
    for label, parts in HEADLINE.items():
        cold = run(spark, registered, folder, parts)
        spent[label] = run(spark, registered, folder, parts)
        print(label, "cold", cold, "warm", spent[label], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
