"""Command line: ``python -m codeloom.cli COMMAND ...``.

Commands: context (slices), guard (violations of a workspace), stats (summary
and shares), search (symbols), status (sync counts), sync (mark a batch), watch
(index what changed), branch (fork, show, drop), run (verify rows in a branch),
init (rules), login and logout, mcp (serve, or install in a client), query (any
by name).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import api, config, schemas
from .operators import guard, render, search, slicer, symbols, telemetry
from .plans.queries import QUERIES
from .sources import scans
from .streaming.reindex import Indexer
from .streaming.tables import VersionedTable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("context", help="slice file:symbol targets, separated by commas")
    c.add_argument("target")
    c.add_argument("--root", default=".")
    c.add_argument("--tier", default="standard")
    c.add_argument("--format", default="pretty", choices=["json", "plain", "markdown", "pretty"])
    g = sub.add_parser("guard", help="check a workspace's imports")
    g.add_argument("--root", default=".")
    g.add_argument("--rules")
    g.add_argument("--warn-only", action="store_true")
    for name in ("stats", "status", "sync"):
        sub.add_parser(name).add_argument("--events", required=True)
    sub.choices["sync"].add_argument("--credentials", default=os.path.expanduser("~/.codeloom/credentials.json"))
    w = sub.add_parser("watch", help="index what a change log holds")
    w.add_argument("--log", required=True)
    w.add_argument("--index", required=True)
    for name, help_text in (("branch", "fork a table, show the branches, drop them"), ("run", "stage rows, verify them, commit or roll back")):
        b = sub.add_parser(name, help=help_text)
        b.add_argument("--table", required=True)
        b.add_argument("--schema", required=True)
    sub.choices["branch"].add_argument("--count", type=int, default=3)
    sub.choices["run"].add_argument("--rows", required=True, help="a Parquet folder")
    sub.choices["run"].add_argument("--check", required=True, help="a condition that every row meets")
    sub.choices["run"].add_argument("--commit-on-success", action="store_true")
    i = sub.add_parser("init", help="write the rules of a preset where there are none")
    i.add_argument("--root", default=".")
    i.add_argument("--preset")
    for name in ("login", "logout"):
        sub.add_parser(name).add_argument("--credentials", default=os.path.expanduser("~/.codeloom/credentials.json"))
    sub.choices["login"].add_argument("--org", required=True)
    sub.choices["login"].add_argument("--token", required=True)
    m = sub.add_parser("mcp", help="answer requests on standard input, or install in a client")
    m.add_argument("--root", default=".")
    m.add_argument("--events")
    m.add_argument("--install", metavar="SETTINGS")
    s = sub.add_parser("search", help="rank a workspace's symbols")
    s.add_argument("text")
    s.add_argument("--root", default=".")
    s.add_argument("--limit", type=int, default=5)
    q = sub.add_parser("query", help="run a query over a folder of tables")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("tables")
    return p


def targets(text: str) -> list[tuple[str, str]]:
    """(file, symbol) of each target that has exactly one colon."""
    parts = [t.strip().split(":") for t in text.split(",")]
    bad = [":".join(t) for t in parts if len(t) != 2 or not all(t)]
    if bad:
        raise ValueError(f"not file:symbol: {', '.join(bad)}")
    return [(a, b) for a, b in parts]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from pyspark.sql import functions as F

    a = parser().parse_args(arguments)
    if a.command == "init":
        print("written" if config.write_rules(os.path.join(a.root, ".codeloom", "rules.yaml"), a.preset) else "there already")
        return 0
    if a.command == "login":
        config.save_credentials(a.credentials, a.org, a.token)
        return 0
    if a.command == "logout":
        return int(not config.clear_credentials(a.credentials))
    if a.command == "mcp" and a.install:
        print("added" if config.add_server(a.install, "codeloom", [sys.executable, "-m", "codeloom.cli", "mcp"]) else "there already")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()

    def files():
        rows = scans.workspace(spark, a.root)
        return rows.withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "/"))

    if a.command == "context":
        wanted = spark.createDataFrame(targets(a.target), "suffix string, symbol string")
        found = files()
        named = found.select("file_path").join(wanted, F.endswith("file_path", F.concat(F.lit("/"), "suffix"))).select("file_path", "symbol")
        for r in render.slices(slicer.slices(found, named, slicer.tier(a.tier)), a.format).toLocalIterator():
            print(r.document)
    elif a.command == "guard":
        text = open(a.rules, encoding="utf-8").read() if a.rules else None
        rows = files().withColumn("file_path", F.expr(f"substring(file_path, {len(a.root.rstrip('/')) + 2})"))
        found = guard.scan(rows, guard.load_rules(text))
        n = 0
        for r in guard.annotations(found).toLocalIterator():
            print(r.annotation)
            n += 1
        return int(n > 0 and not a.warn_only)
    elif a.command == "stats":
        events = scans.events(spark, a.events)
        telemetry.summary(events).show(truncate=False)
        telemetry.client_breakdown(events).show(truncate=False)
    elif a.command == "status":
        telemetry.sync_counts(scans.events(spark, a.events)).show()
    elif a.command == "sync":
        org = (config.load_credentials(a.credentials) or {}).get("org_id")
        if org is None:
            print("not logged in")
            return 1
        events = scans.events(spark, a.events)
        telemetry.sync_report(events, org).show(truncate=False)
    elif a.command == "watch":
        log = spark.readStream.schema("file_path STRING, content STRING, changed_at BIGINT").parquet(a.log)
        Indexer(spark, a.index).start(log, f"{a.index}/checkpoint").awaitTermination()
    elif a.command == "branch":
        table = VersionedTable(spark, a.table, a.schema)
        for name in table.fork(a.count, lambda rows, k: rows):
            print(name, table.staged(name).count())
            table.rollback(name)
    elif a.command == "run":
        found = VersionedTable(spark, a.table, a.schema).run(spark.read.schema(a.schema).parquet(a.rows), a.check, a.commit_on_success)
        print(found)
        return int(not found["success"])
    elif a.command == "mcp":
        events = scans.events(spark, a.events) if a.events else spark.createDataFrame([], schemas.TELEMETRY)
        root = os.path.abspath(a.root)
        named = files().withColumn("file_path", F.expr(f"substring(file_path, {len(root) + 2})"))
        tools = api.Tools(spark, named, events, record=(lambda rows: scans.append_events(rows, a.events)) if a.events else None)
        for line in sys.stdin:
            answer = tools.answer(line)
            if answer is not None:
                print(answer, flush=True)
    elif a.command == "search":
        rows = symbols.line_symbols(files()).select(F.xxhash64("file_path", "name").alias("id"), F.col("name").alias("symbol_name"), "file_path", F.col("signature").alias("docstring"))
        search.top_k(search.scored(rows, [a.text]), a.limit).show(truncate=False)
    else:
        QUERIES[a.name](spark, a.tables).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
