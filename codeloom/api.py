"""Tools by name, as an agent calls them, and the JSON-RPC requests around them.

``Tools.call`` gives DataFrames or small dictionaries; ``Tools.answer`` takes a
line of JSON-RPC 2.0 and gives the answering line; ``answers`` is the part of
it that needs no tool, for whole logs of requests.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import guard, outbox, slicer, telemetry
from .streaming.tables import VersionedTable

# Fixed values of the protocol.
PROTOCOL_VERSION = "2024-11-05"
PARSE_ERROR, NO_METHOD = -32700, -32601
METHODS = ["initialize", "notifications/initialized", "ping", "tools/list", "tools/call"]

#: The tools and what they need.
# The tools and the arguments that each must have.
TOOLS = {
    "get_context_slice": ["file_path", "symbol_name"],
    "verify_architecture": ["source_file", "proposed_imports"],
    "execute_sandboxed": ["branch", "check"],
    "get_lifetime_stats": [],
    "a2a_handshake": ["agent_id", "role"],
    "a2a_transfer_context": ["from_agent", "to_agent", "file_path", "symbol_name"],
    "a2a_verify_peer_patch": ["reviewer_agent", "target_tx_id", "check"],
}


def _strings(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def _string(arguments: dict, name: str, default: str) -> str:
    value = arguments.get(name)
    return value if isinstance(value, str) else default


class Tools:
    """``files``: file_path and content; ``events``: the telemetry table;
    ``table``: a table whose branches are verified and committed; ``record``:
    takes the telemetry events of slices and checks."""

    def __init__(self, spark: SparkSession, files: DataFrame, events: DataFrame, rules: list[guard.Rule] | None = None, table: VersionedTable | None = None, record: Callable[[DataFrame], None] | None = None):
        self.spark, self.files, self.events, self.table, self.record = spark, files, events, table, record
        self.rules = guard.preset(None) if rules is None else rules
        self.held: dict[str, list[str]] = {}
        self.registry: dict[str, Callable] = {name: getattr(self, name) for name in TOOLS}

    def call(self, name: str, **arguments):
        if name not in self.registry:
            raise KeyError(f"unknown tool {name}")
        return self.registry[name](**arguments)

    def _log(self, events: DataFrame) -> None:
        if self.record is not None:
            self.record(events)

    def get_context_slice(self, targets: list[tuple[str, str]], tier: str = "standard") -> DataFrame:
        wanted = self.spark.createDataFrame(targets, "file_path string, symbol string")
        made = slicer.slices(self.files, wanted, slicer.tier(tier))
        self._log(telemetry.new_slice(made, "mcp", int(time.time() * 1000)))
        return made.withColumn("token_reduction_pct", F.format_string("%.1f%%", F.col("compression_ratio").cast("double") * 100))

    def verify_architecture(self, source_file: str, imports: list[str]) -> dict:
        rows = self.spark.createDataFrame([(source_file, m) for m in imports], "source_file string, imported_module string")
        found = [r.asDict() for r in guard.check_imports(rows, self.rules).collect()]
        self._log(telemetry.new_guard_checks(self.spark.createDataFrame([(len(found),)], "violations int"), "mcp", int(time.time() * 1000)))
        return {"valid": not found, "violations_count": len(found), "violations": found}

    def execute_sandboxed(self, branch: str, check: str, commit_on_success: bool = True) -> dict:
        """Verify a staged branch by a condition on its rows; commit it if they
        all meet it, else roll it back."""
        found = self.table.verified(branch, check)
        keep = found["success"] and commit_on_success
        (self.table.commit if keep else self.table.rollback)(branch)
        return {**found, "rolled_back": not keep}

    def get_lifetime_stats(self) -> dict[str, DataFrame]:
        return {"lifetime_summary": telemetry.summary(self.events), "client_breakdown": telemetry.client_breakdown(self.events)}

    def a2a_handshake(self, handshakes: DataFrame, order: str = "at") -> tuple[DataFrame, DataFrame]:
        held = outbox.locks(handshakes, order)
        return held, outbox.swarm_size(held)

    def a2a_transfer_context(self, to_agent: str, targets: list[tuple[str, str]]) -> DataFrame:
        return self.get_context_slice(targets).withColumn("transferred_to", F.lit(to_agent))

    def a2a_verify_peer_patch(self, reviewer_agent: str, branch: str, check: str) -> dict:
        found = self.table.verified(branch, check)
        return {"reviewer_agent": reviewer_agent, "tx_id": branch, "verified": found["success"], "failed_rows": found["failed_rows"]}

    def dispatch(self, name: str, arguments) -> dict:
        """A tool's answer to JSON arguments.  Text that is missing or isn't
        text has a default; items of lists that aren't text are left out."""
        a = arguments if isinstance(arguments, dict) else {}
        if name in ("get_context_slice", "a2a_transfer_context"):
            if name == "get_context_slice" and not (isinstance(a.get("file_path"), str) and isinstance(a.get("symbol_name"), str)):
                raise ValueError("file_path and symbol_name are required")
            rows = self.get_context_slice([(_string(a, "file_path", ""), _string(a, "symbol_name", ""))]).collect()
            if not rows:
                raise LookupError(f"no symbol {a.get('symbol_name')}")
            made = json.loads(json.dumps(rows[0].asDict(recursive=True)))
            return made if name == "get_context_slice" else {"transferred_to": _string(a, "to_agent", ""), "context_envelope": made}
        if name == "verify_architecture":
            return self.verify_architecture(_string(a, "source_file", ""), _strings(a.get("proposed_imports")))
        if name == "execute_sandboxed":
            return self.execute_sandboxed(_string(a, "branch", ""), _string(a, "check", "true"))
        if name == "get_lifetime_stats":
            return {k: [r.asDict() for r in v.collect()] for k, v in self.get_lifetime_stats().items()}
        if name == "a2a_handshake":
            agent, files = _string(a, "agent_id", "unknown_agent"), _strings(a.get("files_to_lock"))
            self.held[agent] = files
            return {"status": "registered", "agent_id": agent, "role": _string(a, "role", "worker"), "locked_files": files, "swarm_peers_count": len(self.held)}
        if name == "a2a_verify_peer_patch":
            return self.a2a_verify_peer_patch(_string(a, "reviewer_agent", ""), _string(a, "target_tx_id", ""), _string(a, "check", "true"))
        raise KeyError(f"unknown tool {name}")

    def answer(self, line: str) -> str | None:
        """The answering line; none to an empty line or a notification."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
            method, number = request["method"], request.get("id")
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": f"Parse error: {e}"}})
        if method == "notifications/initialized":
            return None
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL_VERSION, "serverInfo": {"name": "codeloom", "version": "0.1.0"}, "capabilities": {"tools": {"listChanged": False}}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "inputSchema": {"type": "object", "required": need}} for n, need in TOOLS.items()]}
        elif method == "tools/call":
            params = request.get("params") if isinstance(request.get("params"), dict) else {}
            try:
                result = {"content": [{"type": "text", "text": json.dumps(self.dispatch(_string(params, "name", ""), params.get("arguments")), indent=2)}]}
            except Exception as e:  # a failed tool is an answer too
                result = {"isError": True, "content": [{"type": "text", "text": f"Tool execution failed: {e}"}]}
        else:
            return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": NO_METHOD, "message": f"Method not found: {method}"}})
        return json.dumps({"jsonrpc": "2.0", "id": number, "result": result})


def answers(requests: DataFrame, line: str = "line") -> DataFrame:
    """What each request line of a log gets: method, tool (of a call), code (of
    an error, else null) and answered (false for empty lines, notifications)."""
    v = F.try_parse_json(F.col(line))
    method = X.argument(v, "method", None)
    empty = F.trim(F.coalesce(F.col(line), F.lit(""))) == ""
    code = F.when(empty, F.lit(None).cast("int")).when(method.isNull(), PARSE_ERROR).when(~method.isin(METHODS), NO_METHOD)
    tool = F.when(method == "tools/call", X.argument(F.try_variant_get(v, "$.params", "variant"), "name"))
    answered = ~empty & ~(F.coalesce(method, F.lit("")) == "notifications/initialized")
    return requests.select(*requests.columns, method.alias("method"), tool.alias("tool"), code.alias("code"), answered.alias("answered"))


def handshakes(requests: DataFrame, arguments: str = "arguments") -> DataFrame:
    """The arguments of handshakes with their defaults: agent_id, role and the
    files to lock."""
    v = F.try_parse_json(F.col(arguments))
    return requests.select(*requests.columns, X.argument(v, "agent_id", "unknown_agent").alias("agent_id"), X.argument(v, "role", "worker").alias("role"), X.argument_list(v, "files_to_lock").alias("files"))
