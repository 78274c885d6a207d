"""Sources: workspaces, pushes, ledgers, and stores of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.guard import outside_ignored, supported


def workspace(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content) of the supported files below ``root``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{ts,tsx,js,jsx,py,rs,go}")
    path = F.col("_metadata.file_path")
    return files.select(path.alias("file_path"), F.col("value").alias("content")).filter(supported(F.col("file_path")) & outside_ignored(F.col("file_path")))


def first_files(files: DataFrame, limit: int = 40) -> DataFrame:
    """So many supported files as an importer takes at most."""
    return files.filter(supported(F.col("file_path")) & outside_ignored(F.col("file_path"), ["node_modules", ".git", "target"])).orderBy("file_path").limit(limit)


def pushes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PUSH).json(path)


def cached_ast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CACHED_AST).json(path)


def events(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """The events of a store; from a moment on, only those days are read."""
    from ..operators.telemetry import utc_date

    rows = spark.read.schema(f"{schemas.TELEMETRY}, day STRING").parquet(path)
    if since_ms is not None:
        rows = rows.filter(F.col("day") >= utc_date(F.lit(since_ms))).filter(F.col("timestamp") >= since_ms)
    return rows.drop("day")


def append_events(rows: DataFrame, path: str) -> None:
    """Append, in folders by UTC day that a window's filter can skip."""
    from ..operators.telemetry import utc_date

    rows.withColumn("day", utc_date(F.col("timestamp"))).write.mode("append").partitionBy("day").parquet(path)


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Push payloads from a Kafka topic (needs Spark's Kafka package)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.PUSH).alias("p")).select("p.*")


def changed_paths(*sources: DataFrame) -> DataFrame:
    """The first of several lists of changed files that has any row."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]


#: Small code bases to try things on: name -> (path, content).
SAMPLES = {
    "shop": [("src/cart.ts", "export interface Item { id: string; price: number }\nexport function total(items: Item[]): number {\n  return items.length;\n}\n"), ("src/db/client.ts", "export class Client {\n  query(sql: string): void {\n  }\n}\n")],
    "ledger": [("app/ledger.py", "class Entry:\n    pass\n\n\ndef post(entry: Entry) -> bool:\n    return True\n"), ("app/report.py", "from app.ledger import post\n")],
}


def sample(spark: SparkSession, name: str) -> DataFrame:
    """(file_path, content) of a sample; no rows for an unknown name."""
    return spark.createDataFrame(SAMPLES.get(name, []), "file_path string, content string")


def samples_of(repos: DataFrame) -> DataFrame:
    """The files of the sample that each repository (repo, sample) starts with:
    (repo, file_path, content); none for an unknown sample."""
    rows = [(name, path, content) for name, files in SAMPLES.items() for path, content in files]
    files = repos.sparkSession.createDataFrame(rows, "sample string, file_path string, content string")
    return repos.join(F.broadcast(files), "sample").select("repo", "file_path", "content")  # the samples are a few files
