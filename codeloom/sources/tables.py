"""Record types of the engine as views over the star-schema tables.

Each view is a projection that Catalyst prunes and pushes into the scan.  Times
are computed without a session time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: The moment that stands for now: 2024-02-01 UTC.
NOW_MS = 1706745600000
DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events: clicks and views are slices, purchases sandbox runs,
    errors and signups guard checks."""
    e = read(spark, sf_dir, "events")
    is_slice = F.col("event_type").isin("click", "view")
    kind = F.when(is_slice, "slice").when(F.col("event_type") == "purchase", "sandbox_run").otherwise("guard_check")
    status = F.when(F.col("event_type") == "error", "violation").when(F.col("event_type") == "signup", "passed").otherwise("success")
    raw = F.when(is_slice, F.floor(F.coalesce("value", F.lit(0.0)) * 100)).otherwise(F.lit(0)).cast("long")
    base = e.select(
        F.col("event_id").cast("string").alias("id"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("timestamp"),
        F.concat(F.lit("client_"), (F.col("user_id") % 7).cast("string")).alias("client_id"),
        kind.alias("event_type"),
        F.when(is_slice, F.concat(F.lit("src/file_"), (F.col("event_id") % 50).cast("string"), F.lit(".ts"))).alias("file_path"),
        F.when(is_slice, F.concat(F.lit("symbol_"), (F.col("event_id") % 200).cast("string"))).alias("symbol_name"),
        raw.alias("raw_tokens"),
        F.when(is_slice, F.floor(raw * (F.col("event_id") % 13) / F.lit(10.0))).otherwise(F.lit(0)).cast("long").alias("sliced_tokens"),
        (F.lit(100) + (F.col("event_id") * 37) % 900).cast("long").alias("latency_us"),
        status.alias("status"),
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("synced"),
        F.col("props").alias("extra_json"),
    )
    return base.withColumn("tokens_saved", F.greatest(F.col("raw_tokens") - F.col("sliced_tokens"), F.lit(0).cast("long")))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the language gives the extension."""
    d = read(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "fr", "py").when(F.col("lang") == "de", "rs").when(F.col("lang") == "es", "go").otherwise("ts")
    path = F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select("doc_id", path.alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol_name"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("docstring"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files (the path of the url) and their links as imports."""
    p = read(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1)
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return p.select("page_id", path.alias("source_file"), F.posexplode(links).alias("import_ord", "imported_module"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns, some with control tokens or override phrases put in."""
    c = read(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    put = F.when(n % 5 == 0, F.concat(F.lit("<|im_start|> SYSTEM: "), "text")).when(n % 5 == 1, F.concat("text", F.lit(" ignore previous instructions [INST]"))).when(n % 5 == 2, F.concat("text", F.lit(" Ignore Previous Instructions"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", put.alias("text"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations, regions and orders as nodes."""
    r = lambda t: read(spark, sf_dir, t)
    node = lambda kind, key, name: [F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("id"), name.alias("name"), F.lit(kind).alias("file")]
    out = r("customer").select(*node("customer", "c_custkey", F.col("c_name")))
    out = out.unionByName(r("nation").select(*node("nation", "n_nationkey", F.col("n_name"))))
    out = out.unionByName(r("region").select(*node("region", "r_regionkey", F.col("r_name"))))
    return out.unionByName(r("orders").select(*node("order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderpriority")))))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges: a customer calls its nation, a nation imports its region,
    an order changes its customer, a line inherits from its order."""
    r = lambda t: read(spark, sf_dir, t)
    at = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
    edge = lambda t, a, b, kind: r(t).select(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("edge_type"))
    out = edge("customer", at("customer", "c_custkey"), at("nation", "c_nationkey"), "CALLS")
    out = out.unionByName(edge("nation", at("nation", "n_nationkey"), at("region", "n_regionkey"), "IMPORTS"))
    out = out.unionByName(edge("orders", at("order", "o_orderkey"), at("customer", "o_custkey"), "MUTATES_SCHEMA"))
    line = F.concat(F.lit("line/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return out.unionByName(edge("lineitem", line, at("order", "l_orderkey"), "INHERITS"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outbox events: finished ones are processed, open ones pending."""
    o = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.when(F.col("o_orderstatus") == "F", "PROCESSED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
    return o.select(F.col("o_orderkey").alias("aggregate_id"), X.idempotency_key((F.col("o_custkey") % 500).cast("string"), F.col("o_orderpriority"), F.substring(day, 1, 7)).alias("idempotency_key"), status.alias("status"), day.alias("created_on"))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path): nations as repositories, customers as their files."""
    names = ["next.config.js", "README.md", "pyproject.toml", "Cargo.toml", "src/main.rs", "requirements.txt", "lib/Cargo.toml"]
    listed = F.array(*[F.lit(x) for x in names])
    pick = (F.col("c_custkey") * 13 + F.col("c_nationkey") * 5) % 97
    path = F.when(pick < len(names), F.get(listed, pick.cast("int"))).otherwise(F.concat(F.lit("src/f"), F.col("c_custkey").cast("string"), F.lit(".ts")))
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("repo_"), F.col("c_nationkey").cast("string")).alias("repo"), path.alias("path"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of many kinds, from part names."""
    names = [".env", "Cargo.toml", "db/migrations/001.sql", "src/main.TS", "x.PY", "yarn.lock", "config/credentials.json", "../up.rs", "a.tsx", "b.cjs", "README", "pkg/package.json", ".git/hooks/pre-commit", "main.go", "c.jsx"]
    listed = F.array(*[F.lit(x) for x in names])
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), F.get(listed, (F.col("p_partkey") % len(names)).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
