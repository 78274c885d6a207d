"""Queries of stores, branches, streams, tools and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import api
from ..functions import text as X
from ..functions.bpe import count_tokens_bpe
from ..operators import fuzzy, graph, guard, index, outbox, proof, render, search, slicer, symbols, telemetry
from ..session import scratch_folder
from ..sources import scans
from ..sources import tables as V
from ..sources.tables import NOW_MS
from ..streaming.feed import GraphFeed
from ..streaming.outbox import OutboxStore
from ..streaming.rollup import DaySums
from ..streaming.tables import VersionedTable
from .queries import RULES, SQL, _violations, _VIOLATIONS, query
from .views_sql import sql

# ---------------------------------------------------------------- telemetry stores and events


@query("events_store", sql("telemetry", "select * from telemetry union all select * from telemetry where event_type = 'guard_check'"))
def _(s, d):
    """Events appended twice to a store, and read back."""
    rows, path = V.telemetry(s, d), scratch_folder(s, "events")
    scans.append_events(rows, path)
    scans.append_events(rows.filter("event_type = 'guard_check'"), path)
    return scans.events(s, path)


@query("events_in_memory", sql("telemetry", "select * from telemetry where event_type = 'sandbox_run'"))
def _(s, d):
    V.telemetry(s, d).filter("event_type = 'sandbox_run'").createOrReplaceTempView("codeloom_events")
    return s.table("codeloom_events")


_SLICES = "made as (select 'src/file_' || (event_id % 50) || '.ts' file_path, 'symbol_' || (event_id % 200) target_symbol, event_id % 900 original_file_tokens, event_id % 700 estimated_tokens from events)"


def _made(s, d):
    k = F.col("event_id")
    return V.read(s, d, "events").select(F.concat(F.lit("src/file_"), (k % 50).cast("string"), F.lit(".ts")).alias("file_path"), F.concat(F.lit("symbol_"), (k % 200).cast("string")).alias("target_symbol"), (k % 900).alias("original_file_tokens"), (k % 700).alias("estimated_tokens"))


@query("slice_events", f"""with {_SLICES} select {NOW_MS} as "timestamp", 'cli' client_id, 'slice' event_type, file_path, target_symbol symbol_name, original_file_tokens raw_tokens, estimated_tokens sliced_tokens,
  greatest(original_file_tokens - estimated_tokens, 0) tokens_saved, cast(0 as bigint) latency_us, 'success' status, 0 as synced, cast(null as varchar) extra_json from made""")
def _(s, d):
    return telemetry.new_slice(_made(s, d), "cli", NOW_MS).drop("id")


@query("guard_events", """select c_custkey % 4 n, case when c_custkey % 4 = 0 then 'passed' else 'violation' end status, '{"violations_count":' || (c_custkey % 4) || '}' extra_json, 'ci' client_id, 'guard_check' event_type from customer""")
def _(s, d):
    rows = V.read(s, d, "customer").select((F.col("c_custkey") % 4).alias("violations"))
    return telemetry.new_guard_checks(rows, "ci", NOW_MS).select(F.get_json_object("extra_json", "$.violations_count").cast("long").alias("n"), "status", "extra_json", "client_id", "event_type")


@query("sync_report", sql("telemetry", """select least(n, 500) total_synced, n - least(n, 500) pending_remaining, 'org_a' org_id, case when n = 0 then 'nothing to sync' else least(n, 500) || ' events synced' end message
from (select count(*) n from telemetry where synced = 0)"""))
def _(s, d):
    return telemetry.sync_report(V.telemetry(s, d), "org_a")


@query("status_report", sql("telemetry", "select count(*) total, cast(sum(case when synced = 0 then 1 else 0 end) as bigint) unsynced, cast(null as varchar) org_id from telemetry"))
def _(s, d):
    return telemetry.status(V.telemetry(s, d), None)


@query("status_of_no_store", sql("telemetry", "select count(*) total, count(*) filter (where synced = 0) unsynced, 'org_a' org_id from telemetry where client_id = 'nobody'"))
def _(s, d):
    """What a client without any event sees."""
    return telemetry.status(V.telemetry(s, d).filter("client_id = 'nobody'"), "org_a")


@query("stats_scoreboard", sql("telemetry", """select client_id, n events_count, saved tokens_saved, total total_tokens_saved from (
  select client_id, count(*) n, cast(sum(tokens_saved) as bigint) saved, (select cast(sum(tokens_saved) as bigint) from telemetry) total from telemetry group by 1)"""))
def _(s, d):
    """Each client's share beside the total, as the scoreboard shows them."""
    events = V.telemetry(s, d)
    total = telemetry.summary(events).select("total_tokens_saved", F.lit(1).alias("k"))
    by = telemetry.client_breakdown(events).select("client_id", "events_count", "tokens_saved", F.lit(1).alias("k"))
    return by.join(F.broadcast(total), "k").drop("k")  # one row


@query("event_log", sql("telemetry", 'select id, "timestamp" ts from telemetry order by ts desc, id desc limit 100'))
def _(s, d):
    return render.capped_log(V.telemetry(s, d).select("id", F.col("timestamp").alias("ts")))


@query("export_all_csv_ids", sql("telemetry", "select id from telemetry"))
def _(s, d):
    return telemetry.csv_lines(V.telemetry(s, d), limit=None).select("id")


@query("export_numbered", sql("telemetry", """select row_number() over (order by "timestamp" desc, id desc) - 1 row_no, id from telemetry"""))
def _(s, d):
    """All events in the order of an export, as its files have them."""
    path = scratch_folder(s, "export")
    written = telemetry.export_parts(V.telemetry(s, d), path)
    lines = s.read.text(f"{path}/parts").select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    begins = s.createDataFrame([(f["file"], f["first_row"]) for f in written["files"]], "file string, first_row long")
    in_file = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return lines.withColumn("n", in_file).join(F.broadcast(begins), "file").select((F.col("first_row") + F.col("n")).alias("row_no"), F.substring_index("value", ",", 1).alias("id"))


_SUMMARY = """select count(*) total_events, count(*) filter (where event_type = 'slice') total_slices, cast(coalesce(sum(raw_tokens), 0) as bigint) total_raw_tokens, cast(coalesce(sum(sliced_tokens), 0) as bigint) total_sliced_tokens,
  cast(coalesce(sum(tokens_saved), 0) as bigint) total_tokens_saved, round(coalesce(avg(latency_us), 0), 6) avg_latency_us from telemetry where "timestamp" >= {start}"""


def _kept_sums(s, d) -> DaySums:
    """Day sums after five appends, one of them run twice."""
    sums, events = DaySums(s, scratch_folder(s, "day-sums")), V.telemetry(s, d)
    for batch in (0, 1, 1, 2, 3, 4):
        sums.add(events.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == batch), batch)
    return sums


_WINDOWS = " union all ".join(f"select {k} as window_days, * from ({_SUMMARY.format(start=max(NOW_MS - k * 86_400_000, 0) if k else 0)})" for k in (0, 1, 7, 30))


@query("rollup_summary", sql("telemetry", _WINDOWS))
def _(s, d):
    """Totals of all windows from the day sums."""
    sums, events = _kept_sums(s, d), V.telemetry(s, d)
    shown = ["total_events", "total_slices", "total_raw_tokens", "total_sliced_tokens", "total_tokens_saved", F.round("avg_latency_us", 6).alias("avg_latency_us")]
    parts = [sums.summary(events, w, NOW_MS).select(F.lit(w.value).alias("window_days"), *shown) for w in (telemetry.TimeWindow.LIFETIME, telemetry.TimeWindow.LAST_24H, telemetry.TimeWindow.LAST_7D, telemetry.TimeWindow.LAST_30D)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("rollup_clients", sql("telemetry", """select client_id, count(*) events_count, cast(sum(tokens_saved) as bigint) tokens_saved from telemetry group by 1"""))
def _(s, d):
    return _kept_sums(s, d).client_breakdown(V.telemetry(s, d)).select("client_id", "events_count", "tokens_saved")


@query("update_checks", "select o_orderkey, (o_orderkey * 977) % 90000 < 43200 is_fresh from orders")
def _(s, d):
    now = F.lit(1_700_000_000)
    return V.read(s, d, "orders").select("o_orderkey", X.is_fresh(now - (F.col("o_orderkey") * 977) % 90000, now).alias("is_fresh"))


# ---------------------------------------------------------------- sources


@query("token_counts_bpe")
def _(s, d):
    """Tokens by a byte-level vocabulary."""
    import public_tokenizers

    return V.read(s, d, "documents").select("doc_id", count_tokens_bpe(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("tokens"))


@query("import_first_files", sql("paths", r"""select path file_path from paths where regexp_extract(path, '\.([^./]*)$', 1) in ('ts', 'tsx', 'js', 'jsx', 'py', 'rs', 'go') and not regexp_matches(path, '(^|/)(node_modules|\.git|target)/') order by path limit 40"""))
def _(s, d):
    return scans.first_files(V.paths(s, d).select(F.col("path").alias("file_path")))


@query("import_counters", "select count(distinct p_brand) total_files, count(*) total_symbols from part")
def _(s, d):
    p = V.symbols(s, d)
    return render.import_counters(p.select("file_path"), p)


def _value(x) -> str:
    """SQL of a value; a line break is a character of its own."""
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _values(rows) -> str:
    return ", ".join("({})".format(", ".join(map(_value, row))) for row in rows)


@query("sample_files", f"""select 'repo_' || c_custkey repo, file_path, content from customer
join (values {_values((n, p, c) for n, files in scans.SAMPLES.items() for p, c in files)}) as t(sample, file_path, content) on sample = ['shop', 'ledger', 'unknown'][c_custkey % 3 + 1]""")
def _(s, d):
    """The sample that each repository starts with."""
    pick = F.get(F.array(F.lit("shop"), F.lit("ledger"), F.lit("unknown")), (F.col("c_custkey") % 3).cast("int"))
    return scans.samples_of(V.read(s, d, "customer").select(F.concat(F.lit("repo_"), F.col("c_custkey").cast("string")).alias("repo"), pick.alias("sample")))


_PUSHED = """pushed as (select 'repo_' || (o_custkey % 40) repository, o_orderstatus branch, cast(o_orderkey as varchar) commit_sha, 'src/m' || (o_orderkey % 90) || '.ts' m, 'src/a' || (o_orderkey % 70) || '.ts' a from orders)"""


def _pushes(s, d):
    k, f = F.col("o_orderkey"), lambda c, n: F.concat(F.lit(f"src/{c}"), (F.col("o_orderkey") % n).cast("string"), F.lit(".ts"))
    return V.read(s, d, "orders").select(F.concat(F.lit("repo_"), (F.col("o_custkey") % 40).cast("string")).alias("repository"), F.col("o_orderstatus").alias("branch"), k.cast("string").alias("commit_sha"), F.array(f("m", 90)).alias("modified"), F.array(f("a", 70)).alias("added"), F.array().cast("array<string>").alias("removed"))


@query("push_changes", f"with {_PUSHED} select repository, commit_sha, m file_path, 'modified' change from pushed union all select repository, commit_sha, a, 'added' from pushed")
def _(s, d):
    return outbox.changed_files(_pushes(s, d))


@query("push_outbox", f"with {_PUSHED} select repository aggregate_id, sha256(concat_ws(':', repository, branch, commit_sha)) idempotency_key, 'PENDING' status, 0 as retry_count, 'git_push' event_type from pushed")
def _(s, d):
    return outbox.from_pushes(_pushes(s, d)).select("aggregate_id", "idempotency_key", "status", "retry_count", "event_type")


@query("org_relations", """select n.n_name as org, count(distinct c.c_custkey) repositories, count(o.o_orderkey) commits, cast(sum(case when o.o_orderstatus = 'O' then 1 else 0 end) as bigint) pending
from nation n left join customer c on c.c_nationkey = n.n_nationkey left join orders o on o.o_custkey = c.c_custkey group by 1""")
def _(s, d):
    """Nations, customers and orders as organisations, repositories, commits."""
    r = lambda t: V.read(s, d, t)
    per = outbox.relations(r("nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("org")), r("customer").select(F.col("c_custkey").alias("repository_id"), F.col("c_nationkey").alias("org_id")), r("orders").select(F.col("o_custkey").alias("repository_id"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PROCESSED").alias("status")))
    return per.select("org", "repositories", "commits", "pending")


@query("org_seed", "select c_custkey id, min(name) as name from (select c_custkey, c_name as name from customer where c_custkey % 2 = 0 union all select c_custkey, 'seed ' || c_custkey from customer where c_custkey % 2 = 1 or c_custkey % 10 = 0) group by 1")
def _(s, d):
    """Seed rows that don't overwrite those that are there."""
    c = V.read(s, d, "customer")
    there = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    seed = c.filter("c_custkey % 2 = 1 or c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("seed "), F.col("c_custkey").cast("string")).alias("name"))
    return outbox.seeded(there, seed, "id")


# ---------------------------------------------------------------- rules, guard documents, grids


_PRESETS = ["nextjs-app", "fastapi", "rust", "clean-architecture"]
_PRESET_VALUES = f"(values {_values((k, *row) for k in _PRESETS for row in guard.boundaries(guard.preset(k)))}) as r(preset, rule_ord, \"name\", from_glob, forbid_ord, forbid, message)"


@query("preset_rules", f"select repo, rule_ord, \"name\", from_glob, forbid_ord, forbid, message from ({SQL['preset_infer']}) p join {_PRESET_VALUES} on r.preset = p.preset")
def _(s, d):
    """The rules that each repository gets by its marker files."""
    texts = guard.inferred_preset(V.repo_files(s, d)).select("repo", F.concat(F.lit("preset: "), "preset").alias("text"))
    return guard.rules_of(texts)


@query("rules_from_yaml", f"""select 'repo_' || c_custkey repo, rule_ord, "name", from_glob, forbid_ord, replace(forbid, '@', cast(c_custkey as varchar)) forbid, message from customer
join (select * from {_PRESET_VALUES} where preset in ('fastapi', 'clean-architecture') union all select * from (values ('own', 0, 'A', 'a/**', 0, 'b@/**', 'no'), ('own', 0, 'A', 'a/**', 1, 'c', 'no'), ('own', 1, 'B', '*', 0, 'd', 'Architectural layer boundary violation detected'))) as r(preset, rule_ord, "name", from_glob, forbid_ord, forbid, message)
on r.preset = ['own', 'fastapi', 'clean-architecture'][c_custkey % 3 + 1]""")
def _(s, d):
    """Rules from each repository's own text, its preset, or without any."""
    k = F.col("c_custkey")
    own = F.concat(F.lit("boundaries:\n  - {name: A, from: 'a/**', cannot_import: ['b"), k.cast("string"), F.lit("/**', c], message: 'no'}\n  - {name: B, from: '*', cannot_import: [d]}\n"))
    text = F.when(k % 3 == 0, own).when(k % 3 == 1, "preset: python")
    return guard.rules_of(V.read(s, d, "customer").select(F.concat(F.lit("repo_"), k.cast("string")).alias("repo"), text.alias("text")))


@query("guard_json", sql("imports", f"""+{_VIOLATIONS}, o as (select *, row_number() over (order by source_file, imported_module, rule_name, message) i from v), n as (select count(*) n from v)
select 0::bigint row_no, '{{"status":"' || case when n = 0 then 'clean' else 'violations' end || '","workspace":"/w","active_rules":3,"violations_count":' || n || ',"violations":[' as "text" from n
union all select i, case when i > 1 then ',' else '' end || to_json(struct_pack(source_file := source_file, imported_module := imported_module, rule_name := rule_name, message := message)) from o
union all select n + 1, ']}}' from n"""))
def _(s, d):
    """The document about all violations, row by row."""
    return render.guard_document_rows(_violations(s, d), "/w", len(RULES))


@query("client_grid", "select c_custkey id, c_name as name, c_mktsegment category from customer where contains(lower(c_name), '11') or contains(lower(cast(c_custkey as varchar)), '11') or contains(lower(c_mktsegment), '11')")
def _(s, d):
    c = V.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    return render.grid(c, " 11 ")


# ---------------------------------------------------------------- index, graph, stored nodes


@query("cache_delete_count", "select count(*) records from (select distinct sha256(coalesce(text, '')) h from documents) where h >= '4'")
def _(s, d):
    rows = V.read(s, d, "documents").select(X.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("cached_at"))
    stored = index.cache_put(rows.limit(0), rows)
    return index.cache_count(index.cache_delete(stored, stored.filter("content_hash < '4'")))


@query("stored_nodes", "select cast(p_partkey as varchar) id, p_name symbol_name, p_brand file_path, cast(p_size as integer) start_line from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0")
def _(s, d):
    """Nodes written as JSON and read back; broken documents, and those without
    a name, are passed over."""
    p = V.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("symbol_name"), F.col("p_brand").alias("file_path"), F.col("p_size").cast("int").alias("start_line"))
    stored = index.payloads(p)
    n = F.get_json_object("payload", "$.id").cast("long")
    broken = F.when(n % 5 == 0, F.lit('{"id": ')).when(n % 7 == 0, F.concat(F.lit('{"id":"'), n.cast("string"), F.lit('"}'))).otherwise(F.col("payload"))
    return index.from_payloads(stored.withColumn("payload", broken)).select("id", "symbol_name", "file_path", "start_line")


@query("node_statements", sql("graph_nodes", """select 'MERGE (n:Symbol {id: $id}) SET n.name = $name, n.file = $file, n.language = $language, n.hash = $hash' statement, json_extract_string(p, '$.id') id, json_extract_string(p, '$.name') as name, json_extract_string(p, '$.hash') hash
from (select json_object('id', id, 'name', name, 'file', file, 'language', 'Go', 'hash', sha256(id)) p from graph_nodes)"""))
def _(s, d):
    n = V.graph_nodes(s, d).select("id", "name", "file", F.lit("Go").alias("language"), F.sha2("id", 256).alias("hash"))
    p = lambda k: F.get_json_object("parameters", f"$.{k}").alias(k)
    return graph.node_statement(n).select("statement", p("id"), p("name"), p("hash"))


@query("edge_statements", sql("graph_edges", """select 'MATCH (a:Symbol {id: $source_id}) MATCH (b:Symbol {id: $target_id}) MERGE (a)-[r:' || edge_type || ']->(b) SET r.weight = $weight' statement, count(*) n from graph_edges group by 1"""))
def _(s, d):
    return graph.edge_statement(V.graph_edges(s, d).withColumn("weight", F.lit(0.5))).groupBy("statement").agg(F.count(F.lit(1)).alias("n"))


# By extension: two definitions alike in name around another one, the mark of a
# comment, the place and kind of the second one; and a function with its lines.
_TWICE = {
    "ts": ("function go() {\n  return 1;\n}\nfunction other() {\n}\n\nexport function go() {\n  return '}';\n}\n", "// ", (7, 9, "export_statement"), ("import os\n\n", "function @() {\n  return 1;\n}")),
    "py": ("def go():\n    return 1\n\n\ndef other():\n    pass\n\n\ndef go():\n    return '}'\n", "# ", (9, 10, "function_definition"), ("import os\n\n\n", "def @():\n    return 1")),
    "rs": ("fn go() -> u32 {\n  1\n}\nfn other() {\n}\n\npub fn go() -> u32 {\n  2\n}\n", "// ", (7, 9, "function_item"), ("use os;\n\n", "fn @() -> u32 {\n  1\n}")),
    "go": ("func go() {\n}\n\nfunc other() {\n}\n\nfunc go() {\n  x()\n}\n", "// ", (7, 9, "function_declaration"), ("package os\n\n", "func @() {\n}")),
}
_EXTENSION_SQL = "regexp_extract(file_path, '[^.]*$')"


def _by_extension(of):
    """A column by the file's extension."""
    ext, out = F.substring_index("file_path", ".", -1), F.lit(None)
    for name, made in _TWICE.items():
        out = F.when(ext == name, of(made)).otherwise(out)
    return out


@query("last_definition", sql("source_files", f"""select file_path, 'go' as name, start_line, end_line, kind from source_files
join (values {_values((k, *v[2]) for k, v in _TWICE.items())}) as t(ext, start_line, end_line, kind) on ext = {_EXTENSION_SQL}"""))
def _(s, d):
    """Of definitions alike in name the last in the file is found first, and an
    export before what it exports."""
    text = F.concat(_by_extension(lambda t: F.lit(t[0])), _by_extension(lambda t: F.lit(t[1])), F.regexp_replace("content", r"[\r\n]", " "))
    nodes = slicer.syntax_nodes(V.source_files(s, d).select("file_path", text.alias("content"))).filter("is_definition and name = 'go'")
    return index.latest(nodes.select("file_path", "name", (-F.col("visit_ord")).alias("o"), "start_line", "end_line", "kind"), ["file_path", "name"], ["o"]).drop("o")


@query("failure_slices", sql("source_files", f"""select file_path, 'check_' || doc_id target_symbol, replace(body, '@', 'check_' || doc_id) body from source_files
join (values {_values((k, v[3][1]) for k, v in _TWICE.items())}) as t(ext, body) on ext = {_EXTENSION_SQL}"""))
def _(s, d):
    """Slices of the functions that failure traces name, in every file."""
    f = V.source_files(s, d).withColumn("name", F.concat(F.lit("check_"), F.col("doc_id").cast("string")))
    function = F.replace(_by_extension(lambda t: F.lit(t[3][1])), F.lit("@"), F.col("name"))
    files = f.select("file_path", F.concat(_by_extension(lambda t: F.lit(t[3][0])), function, F.lit("\n")).alias("content"))
    failures = f.select("file_path", F.concat(F.lit("FAILED\ntests::unit::"), "name", F.lit(" (x)")).alias("trace"))
    return slicer.slices_of_failures(files, failures).select("file_path", "target_symbol", F.array_join("sparse_code_lines.line", "\n").alias("body"))


@query("star_graph", """with t as (select o_orderkey, list(l_linenumber order by l_linenumber) ls from orders join lineitem on l_orderkey = o_orderkey group by 1),
n as (select o_orderkey, least(len(ls), 3) c, least(len(ls), 6) p, ls from t)
select 't' || o_orderkey target_symbol, 'target' kind, 0 as place, 't' || o_orderkey as label, 400.0::double x, 260.0::double y from n
union all select 't' || o_orderkey, 'contract', cast(i as integer), 'c' || ls[i + 1], round(400 + cos(i / c::double * 1.2 * pi() - 0.6 * pi()) * 115, 6), round(260 - abs(sin(i / c::double * 1.2 * pi() - 0.6 * pi())) * 115 - 25, 6) from (select *, unnest(range(c)) i from n)
union all select 't' || o_orderkey, 'pruned', cast(i as integer), 'p' || ls[i + 1], round(400 + cos(i / p::double * 2 * pi()) * (190 + i % 2 * 35), 6), round(260 + sin(i / p::double * 2 * pi()) * (190 + i % 2 * 35), 6) from (select *, unnest(range(p)) i from n)""")
def _(s, d):
    lines = V.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("ls"))
    named = lambda c: F.transform("ls", lambda x: F.concat(F.lit(c), x.cast("string")))
    made = render.star(lines.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("target_symbol"), named("c").alias("contracts"), named("p").alias("pruned")))
    return made.select("target_symbol", "kind", "place", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("editor_lines", sql("source_files", """select file_path, cast(k as integer) as line_no, lpad(cast(k as varchar), 4, ' ') || ' | ' || replace(replace(replace(l, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as shown from (
  select file_path, unnest(range(1, len(ls) + 1)) k, unnest(ls) l from (select file_path, case when ls[len(ls)] = '' then ls[1:len(ls) - 1] else ls end ls from (select file_path, string_split_regex(content, '\\r?\\n') ls from source_files)))"""))
def _(s, d):
    each = V.source_files(s, d).select("file_path", F.posexplode(X.lines(F.col("content"))).alias("at", "line"))
    return each.select("file_path", (F.col("at") + 1).alias("line_no"), X.gutter(F.col("at") + 1, F.col("line")).alias("shown"))


@query("file_store", "select p_brand path, arg_max(p_name, p_partkey) as content from part group by 1 union all select 'missing', ''")
def _(s, d):
    """Files by path, the last write counts; a missing one is empty."""
    files = index.latest(V.read(s, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("at"), F.col("p_name").alias("content")), ["path"], ["at"]).select("path", "content")
    asked = files.select("path").unionByName(s.range(1).select(F.lit("missing").alias("path")))
    return asked.join(files, "path", "left").select("path", F.coalesce("content", F.lit("")).alias("content"))


# ---------------------------------------------------------------- forms of slices

_FORMS = "made as (select l_orderkey, l_linenumber, 'f' || l_linenumber target_symbol, 'src/' || l_orderkey || '.ts' file_path, 'x' || l_suppkey a, 'type T' || l_partkey c, cast(l_quantity as bigint) e, 200 o from lineitem)"


def _sliced(s, d):
    t = lambda c: F.col(c).cast("string")
    line = F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("x"), t("l_suppkey")).alias("line"))
    contracts = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.concat(F.lit("type T"), t("l_partkey")))).otherwise(F.array().cast("array<string>"))
    ratio = X.compression_ratio(F.lit(200).cast("long"), F.col("l_quantity").cast("long"))
    return V.read(s, d, "lineitem").select(F.concat(F.lit("src/"), t("l_orderkey"), F.lit(".ts")).alias("file_path"), F.concat(F.lit("f"), t("l_linenumber")).alias("target_symbol"), F.array(line).alias("sparse_code_lines"), contracts.alias("type_contracts"), F.col("l_quantity").cast("long").alias("estimated_tokens"), F.lit(200).cast("long").alias("original_file_tokens"), ratio.alias("compression_ratio"), F.lit(False).alias("syntax_degraded"))


_BOTH = "case when l_linenumber % 2 = 0 then c || chr(10) || chr(10) else '' end || a"


@query("slices_as_text", f"with {_FORMS} select file_path, target_symbol, {_BOTH} as document from made")
def _(s, d):
    return render.slices(_sliced(s, d), "plain")


@query("slices_as_markdown", f"with {_FORMS} select file_path, target_symbol, '### `' || target_symbol || '` in `' || file_path || '`' || chr(10) || chr(10) || o || ' -> ' || e || ' tokens (' || printf('%.1f', (1::float - e::float / o::float)::double * 100) || '% saved)' || chr(10) || chr(10) || '```' || chr(10) || {_BOTH} || chr(10) || '```' || chr(10) as document from made")
def _(s, d):
    return render.slices(_sliced(s, d), "markdown")


@query("slices_as_json", f"with {_FORMS} select file_path, target_symbol, 'x' || substr(a, 2) as line, o original_file_tokens, case when l_linenumber % 2 = 0 then 1 else 0 end contracts from made")
def _(s, d):
    """The JSON documents, read back."""
    g = lambda path: F.get_json_object("document", path)
    return render.slices(_sliced(s, d), "json").select("file_path", "target_symbol", g("$.sparse_code_lines[0].line").alias("line"), g("$.original_file_tokens").cast("int").alias("original_file_tokens"), F.when(g("$.type_contracts[0]").isNull(), 0).otherwise(1).alias("contracts"))


# ---------------------------------------------------------------- branches


def _table(s, name: str, rows) -> VersionedTable:
    t = VersionedTable(s, scratch_folder(s, name), ", ".join(f"{c} {t}" for c, t in rows.dtypes))
    t.write(rows, 0)
    return t


def _orders(s, d):
    return V.read(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("content"))


@query("branches_winner", "select o_orderkey id, o_orderstatus || 2 as content from orders")
def _(s, d):
    """Three branches, of which the second is committed."""
    t = _table(s, "branches", _orders(s, d))
    names = t.fork(3, lambda rows, k: rows.withColumn("content", F.concat("content", F.lit(str(k)))))
    t.commit_winner(2, names)
    return t.read()


@query("branch_outcomes", """select * from (values ('all rows pass', true, cast(0 as bigint), false), ('some fail', false, (select count(*) from orders where o_orderstatus = 'F'), true), ('dry run', true, cast(0 as bigint), true)) as t(run, success, failed_rows, rolled_back)""")
def _(s, d):
    """Verified branches: committed, or rolled back."""
    rows = _orders(s, d)
    t = _table(s, "runs", rows.limit(0))
    made = [("all rows pass", t.run(rows, "id >= 0")), ("some fail", t.run(rows, "content <> 'F'")), ("dry run", t.run(rows, "id >= 0", commit_on_success=False))]
    return s.createDataFrame([(n, r["success"], r["failed_rows"], r["rolled_back"]) for n, r in made], "run string, success boolean, failed_rows bigint, rolled_back boolean")


@query("branch_copies", "select o_orderkey id, o_orderstatus as content from orders where o_orderkey = (select min(o_orderkey) from orders) union all select -1, 'new'")
def _(s, d):
    """A row of the table put into a branch that lacks it, once."""
    t = _table(s, "copies", _orders(s, d))
    least = t.read().agg(F.min("id")).first()[0]
    name = t.stage(s.createDataFrame([(-1, "new")], t.schema))
    for _ in range(2):
        name = t.copied_into(name, "id", least)
    return t.staged(name)


@query("branches_purged", "select cast(2 as bigint) purged, cast(0 as bigint) again, count(*) n from orders")
def _(s, d):
    """Branches that were left behind are dropped; the table stays."""
    t = _table(s, "purged", _orders(s, d))
    t.fork(2, lambda rows, k: rows)
    return t.read().agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.purge()).cast("long").alias("purged"), F.lit(t.purge()).cast("long").alias("again"), "n")


@query("fault_runs", "select l_orderkey * 10 + l_linenumber run_id, least(cast(l_quantity as bigint) + 5, 40) delay_ms, l_linenumber <> 3 success, case when l_linenumber <> 3 then 1.0::double else 0.0::double end resilience, l_linenumber <> 3 passed, true rolled_back from lineitem")
def _(s, d):
    zero = F.lit(0).cast("long")
    fault = lambda kind, ms: F.struct(F.lit(kind).alias("type"), ms.cast("long").alias("delay_ms"), zero.alias("retry_count"), zero.alias("jitter_ms"))
    runs = V.read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.array(fault("NetworkLatency", F.col("l_quantity").cast("long")), fault("CpuThrottle", F.lit(5))).alias("faults"), (F.col("l_linenumber") != 3).alias("success"))
    return proof.fault_report(runs, 40)


# ---------------------------------------------------------------- streams


_FEED = """feed as (
  select 'node' op, 'order/' || o_orderkey id, 'order ' || o_orderpriority as name, null source_id, null edge_type, null target_id, 1 + o_orderkey % 3 as version from orders
  union all select 'node', 'customer/' || c_custkey, c_mktsegment, null, null, null, 1 from customer
  union all select 'delete', 'order/' || o_orderkey, null, null, null, null, 2 + o_orderkey % 4 from orders where o_orderkey % 5 = 0
  union all select 'node', 'order/' || o_orderkey, 'again', null, null, null, 9 from orders where o_orderkey % 10 = 0
  union all select 'delete', 'customer/' || c_custkey, null, null, null, null, 3 from customer where c_custkey % 4 = 0
  union all select 'edge', null, null, 'customer/' || o_custkey, 'CALLS', 'order/' || o_orderkey, 1 + o_orderkey % 8 from orders
  union all select 'edge', null, null, 'customer/' || o_custkey, 'IMPORTS', 'order/' || o_orderkey, 5 from orders where o_orderkey % 3 = 0
  union all select 'unlink', null, null, 'customer/' || o_custkey, 'IMPORTS', 'order/' || o_orderkey, 4 + o_orderkey % 3 from orders where o_orderkey % 2 = 0
), n as (
  select id, max(struct_pack(v := version, name := name)) filter (where op = 'node') best, max(version) filter (where op = 'delete') gone from feed where id is not null group by id
), alive as (select id, best.name as name, best.v as version, gone from n where best.v > coalesce(gone, best.v - 1)),
e as (
  select source_id, edge_type, target_id, max(version) filter (where op = 'edge') as version, max(version) filter (where op = 'unlink') gone from feed where source_id is not null group by 1, 2, 3
), linked as (
  select e.* from e join alive a on a.id = e.source_id join alive b on b.id = e.target_id
  where e.version > coalesce(e.gone, e.version - 1) and e.version > coalesce(a.gone, e.version - 1) and e.version > coalesce(b.gone, e.version - 1)
)"""


def _feed(s, d):
    """Changes of a graph of customers and orders: nodes made, renamed, deleted
    and made again, edges set and unlinked, at versions of many kinds."""
    o, c = V.read(s, d, "orders"), V.read(s, d, "customer")
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    order, customer, of = F.concat(F.lit("order/"), k.cast("string")), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"))

    def node(rows, op, id, name, version):
        return rows.select(F.lit(op).alias("op"), id.alias("id"), name.alias("name"), none.alias("source_id"), none.alias("edge_type"), none.alias("target_id"), version.cast("long").alias("version"))

    def edge(rows, op, kind, version):
        return rows.select(F.lit(op).alias("op"), none.alias("id"), none.alias("name"), customer.alias("source_id"), F.lit(kind).alias("edge_type"), order.alias("target_id"), version.cast("long").alias("version"))

    parts = [
        node(o, "node", order, F.concat(F.lit("order "), "o_orderpriority"), 1 + k % 3),
        node(c, "node", of, F.col("c_mktsegment"), F.lit(1)),
        node(o.filter("o_orderkey % 5 = 0"), "delete", order, none, 2 + k % 4),
        node(o.filter("o_orderkey % 10 = 0"), "node", order, F.lit("again"), F.lit(9)),
        node(c.filter("c_custkey % 4 = 0"), "delete", of, none, F.lit(3)),
        edge(o, "edge", "CALLS", 1 + k % 8),
        edge(o.filter("o_orderkey % 3 = 0"), "edge", "IMPORTS", F.lit(5)),
        edge(o.filter("o_orderkey % 2 = 0"), "unlink", "IMPORTS", 4 + k % 3),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def _streamed(s, rows, folder: str, batches: int):
    """``rows`` as a stream of so many batches, shuffled among them."""
    at = F.pmod(F.xxhash64(*rows.columns), F.lit(batches)).cast("int")
    rows.withColumn("_at", at).repartitionByRange(batches, "_at").drop("_at").write.parquet(folder)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _fed(s, d, batches: int) -> GraphFeed:
    folder = scratch_folder(s, "feed")
    graph = GraphFeed(s, f"{folder}/graph", "name STRING")
    graph.start(_streamed(s, _feed(s, d), f"{folder}/log", batches), f"{folder}/checkpoint").awaitTermination()
    return graph


@query("graph_feed", f"with {_FEED} select id, name, version from alive")
def _(s, d):
    """Nodes from a shuffled feed in three batches."""
    return _fed(s, d, 3).nodes()


@query("graph_feed_edges", f"with {_FEED} select source_id, edge_type, target_id, version from linked")
def _(s, d):
    return _fed(s, d, 2).edges()


@query("outbox_stream", sql("outbox", "select idempotency_key from outbox group by 1"))
def _(s, d):
    """Each key of a stream of pushes once, however late it comes: a batch has
    times of all years."""
    folder = scratch_folder(s, "outbox")
    store = OutboxStore(s, folder)
    rows = V.outbox(s, d).select("idempotency_key", F.col("aggregate_id").cast("string").alias("aggregate_id"), F.lit("{}").alias("payload"), F.pmod(F.xxhash64("idempotency_key", "aggregate_id"), F.lit(10**12)).alias("created_at"))
    store.start_adding(_streamed(s, rows, f"{folder}/in", 3), f"{folder}/checkpoint").awaitTermination()
    return store.table.read().select("idempotency_key")


@query("outbox_states", """with a as (
  select l_orderkey k, l_linenumber i, l_shipdate < date '1996-01-01' ok, row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate < date '1996-01-01') p from lineitem
), r as (
  select 'push/' || o_orderkey idempotency_key, count(p) n, min(p) filter (where ok) done, list(i order by p) times from orders left join a on k = o_orderkey group by 1
)
select idempotency_key, case when done <= 3 then 'PROCESSED' when n >= 3 then 'FAILED' else 'PENDING' end status,
  cast(case when done <= 3 then done - 1 else least(n, 3) end as integer) retry_count,
  cast(case when done <= 3 or n >= 3 then null when n = 0 then 1 else times[n] * 1000 + 60000 * pow(2, n - 1) end as bigint) next_try_at,
  case when done <= 3 then times[done] * 1000 end processed_at from r""")
def _(s, d):
    """Orders as events and their items as tries, three at most: processed,
    failed, or waiting for the next one."""
    folder = scratch_folder(s, "outbox-states")
    store = OutboxStore(s, folder, tries=3)
    key = lambda c: F.concat(F.lit("push/"), F.col(c).cast("string")).alias("idempotency_key")
    store.add(V.read(s, d, "orders").select(key("o_orderkey"), F.col("o_orderstatus").alias("aggregate_id"), F.lit("{}").alias("payload"), F.lit(1).cast("long").alias("created_at")), 0, "orders")
    tried = V.read(s, d, "lineitem").select(key("l_orderkey"), "l_linenumber", (F.col("l_linenumber") * 1000).cast("long").alias("at"), (F.col("l_shipdate") < F.lit("1996-01-01").cast("date")).alias("ok"))
    for batch, some in enumerate(("l_linenumber <= 2", "l_linenumber = 3", "l_linenumber > 3")):
        store.settle(tried.filter(some), batch, "tries")
    return store.table.read().select("idempotency_key", "status", "retry_count", "next_try_at", "processed_at")


@query("chat_symbols_by_table", """with q as (select doc_id, lower(coalesce(text, '')) t from documents), n as (select c_custkey k, substr(text, 1 + c_custkey % 40, 6 + c_custkey % 9) name from customer join documents on doc_id = c_custkey % (select count(*) from documents)),
m as (select doc_id, min(k) k from q join n on contains(t, lower(name)) group by 1), f as (select min(k) k from n where name is not null)
select q.doc_id, n.name symbol from q left join m on m.doc_id = q.doc_id cross join f join n on n.k = coalesce(m.k, f.k)""")
def _(s, d):
    """The first of many names, taken out of the documents, that each holds."""
    docs, c = V.read(s, d, "documents"), V.read(s, d, "customer")
    n, k = docs.count(), F.col("c_custkey")
    names = c.join(docs.select("doc_id", "text"), F.col("doc_id") == k % n).select(k.alias("ord"), F.substring(F.col("text"), (1 + k % 40).cast("int"), (6 + k % 9).cast("int")).alias("name"))
    return search.first_named(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("question")), names).select("doc_id", "symbol")


def _asked(s, d):
    k, name = F.col("s_suppkey") % 7, F.col("p_name")
    half = lambda n: F.split_part(name, F.lit(" "), F.lit(n))
    text = F.when(k == 0, F.upper(name)).when(k == 1, F.substring(name, 2, 100)).when(k == 2, F.concat(half(2), F.lit(" "), half(1))).when(k == 3, F.replace(name, F.lit("e"), F.lit("a"))).when(k == 4, half(1)).when(k == 5, F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string"))).otherwise(F.lower(F.substring("p_type", 1, 4)))
    return V.read(s, d, "supplier").join(V.read(s, d, "part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.lower(text).alias("query")).distinct()


@query("symbol_search_join")
def _(s, d):
    """Names of parts, changed in seven ways, against all parts."""
    return fuzzy.search_join(_asked(s, d), V.symbols(s, d)).select("query", "id", "score")


# ---------------------------------------------------------------- rule tables, reach, blocks

_FORBIDDEN = ["/the**", "/ein", "/d?e*", "/ci[oó]*", "/men/**", "/in*", "/[!a-m]*", "/que"]
_FORBIDDEN_SQL = ["null", "'^/ein$'", "'^/d.e.*$'", "'^/ci[oó].*$'", "'^/men/.*$'", "'^/in.*$'", "'^/[^a-m].*$'", "'^/que$'"]


@query("guard_by_rule_table", sql("imports", f"""+r as (
  select c_custkey k, [{", ".join(_FORBIDDEN_SQL)}][c_custkey % 8 + 1] to_rx, [{", ".join("'" + x.removesuffix("/**") + "'" for x in _FORBIDDEN)}][c_custkey % 8 + 1] pre,
    case c_custkey % 4 when 0 then '^en/' || (c_custkey % 10) || '.*$' when 1 then '^fr/.*$' when 2 then '^.*/' || (c_custkey % 300) || '$' else '^de/.' || (c_custkey % 10) || '$' end from_rx
  from customer
), fits as (select source_file, from_rx from (select distinct source_file from imports), (select distinct from_rx from r) where regexp_matches(source_file, from_rx)),
bad as (select imported_module, to_rx from (select distinct imported_module from imports), (select distinct to_rx, pre from r) where to_rx is not null and (regexp_matches(imported_module, to_rx) or starts_with(imported_module, pre))),
v as (select page_id, import_ord, min(k) k from imports join fits using (source_file) join bad using (imported_module) join r on r.from_rx = fits.from_rx and r.to_rx = bad.to_rx group by 1, 2)
select page_id, import_ord, 'rule ' || k rule_name, 'message ' || (k % 7) message from v"""))
def _(s, d):
    """Imports against a rule for each customer."""
    k = F.col("c_custkey")
    of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    origin = F.when(k % 4 == 0, of("en/", k % 10, "*")).when(k % 4 == 1, "fr/**").when(k % 4 == 2, of("*/", k % 300)).otherwise(of("de/?", k % 10))
    rules = V.read(s, d, "customer").select(k.cast("int").alias("rule_ord"), of("rule ", k).alias("name"), origin.alias("from_glob"), F.lit(0).alias("forbid_ord"), F.get(F.array(*[F.lit(x) for x in _FORBIDDEN]), (k % 8).cast("int")).alias("forbid"), of("message ", k % 7).alias("message"))
    return guard.check_imports_by(V.imports(s, d), rules).select("page_id", "import_ord", "rule_name", "message")


@query("blast_radius_4hop", sql("graph_edges", """+step as (select target_id a, source_id b from graph_edges where edge_type in ('CALLS', 'MUTATES_SCHEMA', 'IMPORTS')),
walk(seed, id, depth) as (select a, b, 1 from step where starts_with(a, 'nation/') or starts_with(a, 'region/') union all select w.seed, s.b, w.depth + 1 from walk w join step s on s.a = w.id where w.depth < 4)
select seed, id, cast(min(depth) as integer) depth from walk group by 1, 2"""))
def _(s, d):
    """All that depends on a nation or region, by way of hubs."""
    edges = V.graph_edges(s, d).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type")
    seeds = V.graph_nodes(s, d).select("id").filter("id like 'nation/%' or id like 'region/%'")
    return graph.blast_radius(edges, seeds, 4, hub_edges=1000)


_HEAD, _BLOCK, _OPEN = "interface Item {\n  id: string;\n}\n", "\nfunction go() {\n  if (x) {\n    return 1;\n  }\n}\n", "\nfunction go() {\n  never(\n"
_SQL_TEXT = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"


@query("block_slices", sql("source_files", f"""+f as (
  select file_path, ends_with(file_path, '.py') py, string_split({_SQL_TEXT(_HEAD)} || content || case doc_id % 4 when 0 then '' when 1 then {_SQL_TEXT(_OPEN)} else {_SQL_TEXT(_BLOCK)} end || content, chr(10)) ls from source_files
), l as (select file_path, py, len(ls) n, unnest(range(1, len(ls) + 1)) k, unnest(ls) as line from f),
c as (select *, length(line) - length(replace(line, '{{', '')) o, length(line) - length(replace(line, '}}', '')) z, length(line) - length(replace(line, ':', '')) dots, min(k) filter (where contains(line, 'function go(')) over (partition by file_path) hit from l),
w as (select *, sum(o + case when py then dots else 0 end - z) over w depth, max(case when o > 0 or (py and dots > 0) then 1 else 0 end) over w opened from c where k >= hit window w as (partition by file_path order by k rows unbounded preceding)),
e as (select file_path, min(k) close from w where k > hit and opened = 1 and depth <= 0 group by 1),
b as (select distinct c.file_path, n, coalesce(hit, n // 3 + 1) first_line, case when hit is null then least(n, n // 3 + 25) when close is not null then close else least(n, hit - 1 + 35) end last_line from c left join e on e.file_path = c.file_path),
h as (select c.file_path, k, py, row_number() over (partition by c.file_path order by k) i from c join b on b.file_path = c.file_path where (k < first_line or k > last_line) and regexp_matches(ltrim(line), '^(export interface |interface |export type |type |@dataclass|pub struct |struct |pub enum |enum )')),
x as (select h.file_path, h.k begin_line, c.k, line, coalesce(sum(o - z) over (partition by h.file_path, h.k order by c.k rows between unbounded preceding and 1 preceding), 0) before, c.py from h join c on c.file_path = h.file_path and c.k >= h.k where i <= 3),
y as (select file_path, begin_line, coalesce(min(k) filter (where k > begin_line and before <= 0 and not (py and starts_with(line, '    '))), 1000000000) stop from x group by 1, 2),
t as (select x.file_path, x.begin_line, string_agg(line, chr(10) order by k) contract from x join y on y.file_path = x.file_path and y.begin_line = x.begin_line where k < stop group by 1, 2),
a as (select file_path, string_agg(contract, '|' order by begin_line) contracts from t group by 1)
select b.file_path, cast(first_line as integer) first_line, cast(last_line as integer) last_line, cast(greatest(n - (last_line - first_line + 1), 0) as integer) pruned,
  cast((select count(*) from h where h.file_path = b.file_path) as integer) hoisted, sha256((select string_agg(line, chr(10) order by k) from l where l.file_path = b.file_path and k between first_line and last_line)) body, sha256(coalesce(a.contracts, '')) contracts
from b left join a on a.file_path = b.file_path"""))
def _(s, d):
    """Blocks of a function put between two copies of each document: closed,
    open, or not there."""
    k, body = F.col("doc_id") % 4, F.col("content")
    text = F.concat(F.lit(_HEAD), body, F.when(k == 0, "").when(k == 1, _OPEN).otherwise(_BLOCK), body)
    files = V.source_files(s, d).select("file_path", text.alias("content"))
    got = symbols.block_slices(files, F.lit("function go("))
    return got.select("file_path", "first_line", "last_line", "pruned", "hoisted", F.sha2(F.array_join("lines", "\n"), 256).alias("body"), F.sha2(F.array_join("contracts", "|"), 256).alias("contracts"))


# ---------------------------------------------------------------- tools

_LINES = [
    '{"jsonrpc":"2.0","id":1,"method":"initialize"}',
    '{"jsonrpc":"2.0","method":"notifications/initialized"}',
    '{"jsonrpc":"2.0","id":2,"method":"tools/call","params":{"name":"verify_architecture","arguments":{}}}',
    '{"jsonrpc":"2.0","id":3,"method":"nope"}',
    '{"jsonrpc":',
    "  ",
    '{"id":4,"method":7}',
]
_LINES_SQL = "[" + ", ".join(f"'{x}'" for x in _LINES) + "]"


@query("request_log", f"""select o_orderkey, case when i < 4 then json_extract_string(l, '$.method') end as "method", case when i = 2 then 'verify_architecture' end tool,
  cast(case i when 3 then -32601 when 4 then -32700 when 6 then -32700 end as integer) code, i not in (1, 5) answered
from (select o_orderkey, o_orderkey % 7 i, case when o_orderkey % 7 < 4 then {_LINES_SQL}[o_orderkey % 7 + 1] end l from orders)""")
def _(s, d):
    """What the requests of a log get."""
    lines = F.array(*[F.lit(x) for x in _LINES])
    rows = V.read(s, d, "orders").select("o_orderkey", F.get(lines, (F.col("o_orderkey") % 7).cast("int")).alias("line"))
    return api.answers(rows).drop("line")


@query("tool_list", "select unnest(['get_context_slice', 'verify_architecture', 'execute_sandboxed', 'get_lifetime_stats', 'a2a_handshake', 'a2a_transfer_context', 'a2a_verify_peer_patch']) as name")
def _(s, d):
    """The tools, as the answer to a request names them."""
    answer = api.Tools(s, scans.sample(s, "shop"), V.telemetry(s, d)).answer('{"id":1,"method":"tools/list"}')
    return s.createDataFrame([(answer,)], "j string").select(F.explode(F.from_json("j", "result struct<tools:array<struct<name:string>>>")["result"]["tools"]).alias("t")).select("t.name")


@query("tool_arguments", """select o_orderkey, case when o_orderkey % 3 = 0 then 'agent_' || o_custkey else 'unknown_agent' end agent_id, case when o_orderkey % 2 = 0 then 'reviewer' else 'worker' end "role", case when o_orderkey % 3 = 0 then 'a.ts,' || o_orderkey else '' end files from orders""")
def _(s, d):
    """Arguments of handshakes: defaults, and lists without what isn't text."""
    k, t = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    named = F.concat(F.lit('{"agent_id":"agent_'), t("o_custkey"), F.lit('","files_to_lock":["a.ts",7,null,"'), t("o_orderkey"), F.lit('"]'))
    role = F.when(k % 2 == 0, F.lit('"role":"reviewer"}')).otherwise(F.lit('"role":5}'))
    arguments = F.when(k % 3 == 0, F.concat(named, F.lit(","), role)).otherwise(F.concat(F.lit('{"agent_id":1,"files_to_lock":"a.ts",'), role))
    found = api.handshakes(V.read(s, d, "orders").select("o_orderkey", arguments.alias("arguments")))
    return found.select("o_orderkey", "agent_id", "role", F.array_join("files", ",").alias("files"))


@query("tool_slice", "select 'total' target_symbol, '2' as first_line, 'export interface Item { id: string; price: number }' contract, '[\"tests\"]' locked, false valid, 'Tool execution failed' as failed")
def _(s, d):
    """Answers of the tools to requests, one after the other."""
    import json

    tools = api.Tools(s, scans.sample(s, "shop"), V.telemetry(s, d))

    def call(name, **arguments):
        answer = json.loads(tools.answer(json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})))
        return answer["result"]["content"][0]["text"]

    made = json.loads(call("get_context_slice", file_path="src/cart.ts", symbol_name="total"))
    shaken = json.loads(call("a2a_handshake", agent_id="x", files_to_lock=["tests", 4]))
    valid = json.loads(call("verify_architecture", source_file="src/ui/a.ts", proposed_imports=["src/db/client"]))["valid"]
    failed = call("nope").split(":")[0]
    return s.createDataFrame([(made["target_symbol"], str(made["sparse_code_lines"][0]["line_no"]), made["type_contracts"][0], json.dumps(shaken["locked_files"]), valid, failed)], "target_symbol string, first_line string, contract string, locked string, valid boolean, failed string")
