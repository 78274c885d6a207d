"""Fault delays, proofs of correctness, review actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import signature

# Fixed values.
DEFAULT_FAULTS = [("NetworkLatency", 10, 0, 0), ("CpuThrottle", 5, 0, 0), ("LockContention", 0, 2, 5)]
LEAST_RESILIENCE, LEAST_AST = 0.95, 0.90


def injected_delay(faults: Column, cap_ms: Column) -> Column:
    """Sum of delays, and of retries times jitter for lock contention, capped.
    ``faults``: array of (type, delay_ms, retry_count, jitter_ms)."""
    total = F.aggregate(faults, F.lit(0).cast("long"), lambda n, f: n + F.when(f["type"] == "LockContention", f["retry_count"] * f["jitter_ms"]).otherwise(f["delay_ms"]).cast("long"))
    return F.least(total, cap_ms.cast("long"))


def resilience(success: Column) -> Column:
    return F.when(success, 1.0).otherwise(0.0)


def status(violations: Column, resilient: Column) -> Column:
    return F.when((violations == 0) & (resilient >= LEAST_RESILIENCE), "VERIFIED_GREEN").otherwise("QUARANTINED")


def _payload() -> Column:
    number = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    return F.concat_ws(":", "commit_sha", F.col("timestamp").cast("string"), "status", F.col("violations").cast("string"), number("ratio"), number("resilience"))


def signed(runs: DataFrame, secret: str) -> DataFrame:
    """``runs`` (commit_sha, timestamp, violations, ratio, resilience) with
    status, signature and proof_id."""
    made = runs.withColumn("status", status(F.col("violations"), F.col("resilience")))
    made = made.withColumn("signature", signature(_payload(), secret))
    return made.withColumn("proof_id", F.concat(F.lit("proof_"), F.substring("signature", 1, 16)))


def verified(proofs: DataFrame, secret: str) -> DataFrame:
    return proofs.withColumn("is_valid", F.col("signature") == signature(_payload(), secret))


def quarantine_action(action: Column) -> Column:
    """The new state; null for an unknown action."""
    return F.when(action == "OVERRIDE_APPROVE", "APPROVED").when(action == "TRIGGER_AGENT_REPAIR", "DISPATCHED_TO_AGENT")


def swarm_verdict(runs: DataFrame) -> DataFrame:
    """One verdict for each commit from its real figures: violations found,
    whole-table compression, worst resilience."""
    return runs.groupBy("commit_sha").agg(F.sum("violations").alias("violations"), F.min("resilience").alias("resilience"), (F.lit(1.0) - F.try_divide(F.sum("sliced_tokens").cast("double"), F.sum("raw_tokens").cast("double"))).alias("ratio")).withColumn("status", status(F.col("violations"), F.col("resilience")))


def fault_report(runs: DataFrame, cap_ms: int) -> DataFrame:
    """What running under faults gives for each run (run_id, faults, success):
    the delay put in, resilience, and that its changes were rolled back."""
    return runs.select("run_id", injected_delay(F.col("faults"), F.lit(cap_ms)).alias("delay_ms"), "success", resilience(F.col("success")).alias("resilience"), (resilience(F.col("success")) >= LEAST_RESILIENCE).alias("passed"), F.lit(True).alias("rolled_back"))
