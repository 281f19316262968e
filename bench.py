"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


APPROXIMATE = {"nprobe": 8, "rows_per_anchor": 100}


def recall(spark, sf):
    """Share of the exact top 15 that the approximate search finds."""
    from checks import fixtures as fx
    from passbook.operators.search import similarity_topk

    vectors = fx.vectors(spark, sf)
    asked = vectors.select(F.col("id").alias("query_id"), "embedding")
    exact = similarity_topk(asked, vectors, 15).select("query_id", "id")
    near = similarity_topk(asked, vectors, 15, **APPROXIMATE).select("query_id", "id")
    return exact.join(near, ["query_id", "id"], "left_semi").count() / exact.count()


def rows_read(spark, sf):
    from checks import fixtures as fx

    return {"bronze": fx.bronze(spark, sf).count(), "gold": fx.gold(spark, sf).count()}


def session():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("passbook-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def jobs(spark, sf):
    """name -> job. Layers below the one measured are stored beforehand."""
    from checks import fixtures as fx
    from checks import q_gold, q_search  # noqa: F401
    from checks.landing import landing_folder
    from checks.registry import QUERIES
    from passbook.operators import reports
    from passbook.operators.responses import first_valid_attempt, validate_responses
    from passbook.operators.search import similarity_topk
    from passbook.plans.ask import ask
    from passbook.plans.dashboard import dashboard_report
    from passbook.plans.gold import build_gold
    from passbook.plans.indexing import sync_index
    from passbook.plans.ingest import ingest
    from passbook.plans.refine import refine
    from passbook.plans.workspace import Workspace
    from passbook.scratch import scratch_folder

    folder = landing_folder(spark, sf)
    ws = Workspace(spark, scratch_folder(spark, "bench"))
    ws.bronze.append(fx.bronze(spark, sf))
    ws.manual.append(fx.manual(spark, sf))
    vectors = fx.vectors(spark, sf)
    asked = vectors.select(F.col("id").alias("query_id"), "embedding")
    payloads, responses = fx.payloads(spark, sf), fx.responses(spark, sf)

    def dashboard():
        for panel in dashboard_report(ws.gold.read()).values():
            drain(panel)

    return {
        "k1_ingest": lambda: ingest(Workspace(spark, scratch_folder(spark, "bench")), folder),
        "k2_refine": lambda: refine(ws),
        "k3_gold_cold": lambda: build_gold(ws).first(),
        "k3_gold_cached": lambda: build_gold(ws).first(),
        "k6_dashboard": dashboard,
        "e3_spend_by_category": lambda: drain(reports.spend_by_category(ws.gold.read())),
        "i3_validate_responses": lambda: drain(first_valid_attempt(validate_responses(payloads, responses))),
        "i7_sync_cold": lambda: sync_index(ws),
        "i7_sync_no_change": lambda: sync_index(ws),
        "i8_exact_top15": lambda: drain(similarity_topk(asked, vectors, 15)),
        "i8_grouped_exact_top15": lambda: drain(similarity_topk(asked, vectors, 15, travelling=0, rows_per_anchor=100)),
        "i8_approx_top15": lambda: drain(similarity_topk(asked, vectors, 15, **APPROXIMATE)),
        "k7_ask": lambda: drain(ask(fx.questions(spark, sf), ws.index.read())),
        "f5_running_balance": lambda: drain(QUERIES["F5_running_balance"](spark, sf)),
    }


def main():
    spark = session()
    start = time.time()
    todo = jobs(spark, SF_DIR)
    setup = time.time() - start
    seconds = {}
    for name, job in todo.items():
        start = time.time()
        job()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    counts = rows_read(spark, SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "setup_sec": round(setup, 3),
                "cpus": CPUS,
                "rows": counts,
                "i8_recall": round(recall(spark, SF_DIR), 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
