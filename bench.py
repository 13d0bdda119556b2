"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from telemill import session  # noqa: E402
from telemill.plans import catalog  # noqa: E402

HEADLINE = [
    # raw records to events
    "decode_envelope", "transform", "src_fanin", "failure_rows", "custom_domain", "malformed",
    # key check
    "dedupe_batch", "store_events", "store_conflicts",
    # reads on the stored table
    "latest_20", "list_after_cursor", "get_event", "events_by_domain", "events_by_source", "page_numbers",
    "typed_readback", "scan_events",
    # measures
    "table_stats", "failed_by_stage", "metric_transform", "latency_histogram", "throughput_by_window",
    "backlog_series", "backlog_stats", "regression_vs_previous", "freshness", "error_lines",
    # streaming
    "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "telemill-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        started = time.perf_counter()
        action()
        return round(time.perf_counter() - started, 3)

    def run(name: str) -> None:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    queries = {"ingest": timed(lambda: catalog.stored_tables(spark, sf_dir))}
    for name in HEADLINE:
        queries[name] = timed(lambda: run(name))
    messages = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "messages": messages,
                "ingest_messages_per_second": round(messages / queries["ingest"], 1),
                "transform_messages_per_second": round(messages / queries["transform"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
