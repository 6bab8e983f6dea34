"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from crossweave.plans.workload import QUERIES, corpus, load_corpus
from crossweave.session import build_session
from crossweave.workspace import Workspace

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "parse_pages parse_langlinks resolve_language_links anomaly_report universe edge_weights "
    "ego_net_2 ego_net_3 translated_net candidates_everywhere recommendation_report pagerank_ego hits_hub "
    "rank_everywhere_hits rank_by_title_rpr rank_top_k rank_stats relatedness_hits relatedness_rpr"
).split()


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    # Loading is timed on its own, from the order tables; the analyses read its tables.
    start = time.time()
    consume(load_corpus(spark, SF_DIR))
    times["load_corpus"] = round(time.time() - start, 3)
    loaded = corpus(spark, SF_DIR)
    for table in ("pages", "links", "dump", "language_links"):
        getattr(loaded, table)

    for name in sys.argv[1:] or HEADLINES:
        with Workspace(spark) as ws:
            start = time.time()
            consume(QUERIES[name](loaded, ws))
            times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
