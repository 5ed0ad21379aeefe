"""Command line: analyze files, export training samples, and report on tables.

    python -m reviewloom analyze reviews.csv --column text --out results
    python -m reviewloom export openai turns/ --out samples [--session s1 ...]
    python -m reviewloom stats turns/
    python -m reviewloom history results/
    python -m reviewloom reviewer r7 tables/          (analyses and keywords as Parquet tables below it)
    python -m reviewloom product p3 tables/

Run it under spark-submit on a cluster; by itself it starts a local session.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import profiles, sessions, training
from .plans.pipeline import run_fast, run_offline
from .session import local_session
from .sources import readers, writers

FORMATS = {
    "openai": lambda spark, root: training.agent_sft(training.agent_turns(readers.read_agent_sessions(spark, root))),
    "tool-sft": lambda spark, root: training.tool_sft(readers.read_sessions(spark, root)),
    "tool-supervision": lambda spark, root: training.tool_supervision(training.tool_executions(readers.read_agent_sessions(spark, root)), readers.read_sessions(spark, root).withColumn("ts", F.col("timestamp"))),
}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="reviewloom")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("path")
    analyze.add_argument("--column")
    analyze.add_argument("--field")
    analyze.add_argument("--mode", choices=("fast", "offline"), default="offline")
    analyze.add_argument("--out", required=True)
    export = commands.add_parser("export")
    export.add_argument("format", choices=sorted(FORMATS))
    export.add_argument("path")
    export.add_argument("--out", required=True)
    export.add_argument("--session", action="append")
    commands.add_parser("stats").add_argument("path")
    commands.add_parser("history").add_argument("path")
    for name in ("reviewer", "product"):
        report = commands.add_parser(name)
        report.add_argument("key")
        report.add_argument("path")
    given = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or local_session()
    if given.command == "analyze":
        texts = readers.read_reviews(spark, given.path, given.column, given.field).withColumn("id", F.monotonically_increasing_id())
        run = run_fast if given.mode == "fast" else run_offline
        writers.write_jsonl(run(texts, "id", "text"), given.out)
    elif given.command == "export":
        print(writers.export(FORMATS[given.format](spark, given.path), given.out, given.session))
    elif given.command == "history":
        results = spark.read.json(given.path)
        sessions.history(results if "index" in results.columns else results.withColumn("index", F.monotonically_increasing_id())).orderBy("index").show(50, truncate=False)
    elif given.command in ("reviewer", "product"):
        analyses, keywords = (spark.read.parquet(f"{given.path}/{name}.parquet") for name in ("analyses", "keywords"))
        make = profiles.reviewer_report if given.command == "reviewer" else profiles.product_report
        report = make(analyses, keywords, given.key)
        if report.isEmpty():
            print(f"no profile of {given.key}")
            return 1
        report.orderBy("section", "place").show(200, truncate=False)
    else:
        turns = readers.read_sessions(spark, given.path)
        training.trajectory_stats(turns).show()
        training.skill_distribution(turns).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
