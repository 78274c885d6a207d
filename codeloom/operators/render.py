"""Result documents: slices as JSON, text or Markdown; guard and dashboard
documents; capped logs; grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import progress_bar
from . import guard, search, telemetry
from .ordered import numbered, write_parts

# Code fences by language.
FENCES = {"TypeScript": "typescript", "JavaScript": "javascript", "Python": "python", "Go": "go", "Rust": "rust"}


def _body() -> Column:
    return F.array_join(F.transform("sparse_code_lines", lambda x: x["line"]), "\n")


def _contracts() -> Column:
    return F.array_join("type_contracts", "\n\n")


def slices(made: DataFrame, form: str = "json") -> DataFrame:
    """(file_path, target_symbol, document) in one of the forms."""
    both = F.concat(F.when(F.size("type_contracts") > 0, F.concat(_contracts(), F.lit("\n\n"))).otherwise(""), _body())
    saved = F.format_string("%.1f%%", F.col("compression_ratio").cast("double") * 100)
    facts = F.concat(F.col("original_file_tokens").cast("string"), F.lit(" -> "), F.col("estimated_tokens").cast("string"), F.lit(" tokens ("), saved, F.lit(" saved)"))
    if form == "json":
        document = F.to_json(F.struct(*made.columns))
    elif form == "plain":
        document = both
    elif form == "markdown":
        document = F.concat(F.lit("### `"), "target_symbol", F.lit("` in `"), "file_path", F.lit("`\n\n"), facts, F.lit("\n\n```\n"), both, F.lit("\n```\n"))
    elif form == "pretty":
        document = F.concat("target_symbol", F.lit("  ["), progress_bar(F.col("compression_ratio").cast("double")), F.lit("] "), facts, F.lit("\n"), both)
    else:
        raise ValueError(f"unknown form {form}")
    return made.select("file_path", "target_symbol", document.alias("document"))


def guard_document(violations: DataFrame, workspace: str, active_rules: int) -> DataFrame:
    """One JSON document about a workspace's violations.  It lists them all:
    for reports of a change, not of a whole corpus."""
    listed = violations.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("source_file", "imported_module", "rule_name", "message"))).alias("v"))
    status = F.when(F.col("n") == 0, "clean").otherwise("violations")
    return listed.select(F.to_json(F.struct(status.alias("status"), F.lit(workspace).alias("workspace"), F.lit(active_rules).alias("active_rules"), F.col("n").alias("violations_count"), F.col("v").alias("violations"))).alias("document"))


_REPORTED = ["source_file", "imported_module", "rule_name", "message"]


def guard_document_rows(violations: DataFrame, workspace: str, active_rules: int) -> DataFrame:
    """(row_no, text): the document about any number of violations, whose rows
    put together in order are one JSON text.  Row 0 opens it and the last row
    closes it; each violation is a row, and no task has more than its share."""
    rows = numbered(violations.select(*_REPORTED), [F.col(c).asc_nulls_first() for c in _REPORTED])
    status = F.when(F.col("n") == 0, "clean").otherwise("violations")
    facts = F.to_json(F.struct(status.alias("status"), F.lit(workspace).alias("workspace"), F.lit(active_rules).alias("active_rules"), F.col("n").alias("violations_count")))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("row_no"), F.concat(F.regexp_replace(facts, r"\}$", ""), F.lit(',"violations":[')).alias("text")), F.struct((F.col("n") + 1).alias("row_no"), F.lit("]}").alias("text")))).alias("e")).select("e.*")
    each = F.concat(F.when(F.col("row_no") > 0, ",").otherwise(""), F.to_json(F.struct(*_REPORTED)))
    return ends.unionByName(rows.select((F.col("row_no") + 1).alias("row_no"), each.alias("text")))


def write_guard_report(violations: DataFrame, path: str, total_files: int) -> dict:
    """A Markdown report about any number of violations as numbered files."""
    n = violations.count()
    head = f"## Import check: {f'{n} import(s) cross a layer' if n else 'no import crosses a layer'}\n\n{total_files} file(s).\n"
    table = "\n| Rule | File | Import | Why not |\n|---|---|---|---|\n" if n else ""
    return write_parts(guard.markdown_rows(violations), [F.col(c).asc_nulls_first() for c in _REPORTED], F.col("row"), path, head + table)


def dashboard(events: DataFrame, symbols: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """What a dashboard shows, by the name of its document."""
    hits = symbols.orderBy("id").limit(60)
    return {
        "summary": telemetry.summary(events),
        "clients": telemetry.client_breakdown(events),
        "velocity": telemetry.daily_velocity(events, 30, now_ms),
        "events": telemetry.recent(events, 50),
        "graph": search.spiral(hits, ["id"]),
        "export": telemetry.csv_lines(events),
    }


def capped_log(rows: DataFrame, cap: int = 100) -> DataFrame:
    """The newest rows (ts, id) that a capped log holds."""
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(cap)


def grid(clients: DataFrame, text: str) -> DataFrame:
    """Clients whose name, id or category holds the text, in any case."""
    q = text.strip().lower()
    return clients.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)) | F.contains(F.lower("category"), F.lit(q)))


def import_counters(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """How many files and symbols an import brought, as one row."""
    a = files.agg(F.countDistinct("file_path").alias("total_files")).withColumn("_k", F.lit(1))
    return a.join(symbols.agg(F.count(F.lit(1)).alias("total_symbols")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def star(slices: DataFrame, width: float = 800.0, height: float = 520.0, contracts: int = 3, pruned: int = 6) -> DataFrame:
    """Nodes of a star graph for each slice (target_symbol, contracts, pruned:
    arrays of names): the target in the middle, the first contracts on an arc
    above it, the first pruned names on two rings around it."""
    arc = lambda i, n: i / n * 1.2 * math.pi - 0.6 * math.pi
    x, y = F.lit(width / 2), F.lit(height / 2)
    node = lambda kind, place, label, dx, dy: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), label.alias("label"), (x + dx).alias("x"), (y + dy).alias("y"))
    of = lambda column, most: F.slice(F.coalesce(column, F.array().cast("array<string>")), 1, most)
    zero = F.lit(0.0)

    def ring(names: Column) -> Column:
        far = lambda i: F.lit(190.0) + i % 2 * 35
        turn = lambda i: i / F.size(names) * 2 * math.pi
        return F.transform(names, lambda c, i: node("pruned", i, c, F.cos(turn(i)) * far(i), F.sin(turn(i)) * far(i)))

    def above(names: Column) -> Column:
        return F.transform(names, lambda c, i: node("contract", i, c, F.cos(arc(i, F.size(names))) * 115, -F.abs(F.sin(arc(i, F.size(names)))) * 115 - 25))

    nodes = F.concat(F.array(node("target", F.lit(0), F.col("target_symbol"), zero, zero)), above(of(F.col("contracts"), contracts)), ring(of(F.col("pruned"), pruned)))
    return slices.select("target_symbol", F.explode(nodes).alias("n")).select("target_symbol", "n.*")
