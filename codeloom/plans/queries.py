"""The library's queries over the star-schema tables, with their SQL.

``QUERIES``: name -> (spark, sf_dir) -> DataFrame.  ``SQL``: name -> the same
result for DuckDB.  Queries without SQL have plain versions in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, guard, index, outbox, proof, search, slicer, symbols, telemetry
from ..session import scratch_folder
from ..sources import tables as V
from ..sources.tables import NOW_MS
from ..streaming.reindex import Indexer
from .views_sql import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def hmac(secret: str, payload: str) -> str:
    """SQL of the keyed hash of a payload."""
    inner, outer = (x.hex() for x in X.hmac_pads(secret))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({payload}))))"


def query(name: str, text: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


# ---------------------------------------------------------------- telemetry

_SUMMARY = """select cast(count(*) as bigint) total_events,
  cast(coalesce(sum(case when event_type = 'slice' then 1 end), 0) as bigint) total_slices,
  cast(coalesce(sum(raw_tokens), 0) as bigint) total_raw_tokens, cast(coalesce(sum(sliced_tokens), 0) as bigint) total_sliced_tokens,
  cast(coalesce(sum(tokens_saved), 0) as bigint) total_tokens_saved, coalesce(avg(latency_us), 0.0) avg_latency_us,
  cast(coalesce(sum(case when event_type = 'guard_check' and status = 'violation' then 1 end), 0) as bigint) boundary_violations_caught,
  cast(coalesce(sum(case when event_type = 'sandbox_run' then 1 end), 0) as bigint) sandboxed_runs,
  case when coalesce(sum(raw_tokens), 0) > 0 then 1.0::double - cast(sum(sliced_tokens) as double) / cast(sum(raw_tokens) as double) else 0.0::double end compression_ratio,
  round(coalesce(sum(tokens_saved), 0)::double / 1e6 * 3.0::double * 100.0::double) / 100.0::double estimated_usd_saved
from telemetry"""

for _name, _window in (("", telemetry.TimeWindow.LIFETIME), ("_24h", telemetry.TimeWindow.LAST_24H), ("_7d", telemetry.TimeWindow.LAST_7D), ("_30d", telemetry.TimeWindow.LAST_30D)):
    QUERIES[f"telemetry_summary{_name}"] = lambda s, d, w=_window: telemetry.summary(V.telemetry(s, d), w, NOW_MS)
    SQL[f"telemetry_summary{_name}"] = sql("telemetry", f'{_SUMMARY} where "timestamp" >= {_window.start_ms(NOW_MS)}')


@query("telemetry_summary_empty", sql("telemetry", f"{_SUMMARY} where false"))
def _(s, d):
    return telemetry.summary(V.telemetry(s, d).filter(F.lit(False)))


@query("client_breakdown", sql("telemetry", """select client_id, events_count, tokens_saved,
  case when sum(tokens_saved) over () > 0 then round(tokens_saved::double / (sum(tokens_saved) over ())::double * 100.0::double * 10.0::double) / 10.0::double else 0.0::double end percentage
from (select client_id, count(*) events_count, cast(sum(tokens_saved) as bigint) tokens_saved from telemetry group by 1)"""))
def _(s, d):
    return telemetry.client_breakdown(V.telemetry(s, d))


@query("daily_velocity", sql("telemetry", f"""select strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d') date, cast(sum(tokens_saved) as bigint) tokens_saved, count(*) events_count,
  round(sum(tokens_saved)::double / 1e6 * 3.0::double * 100.0::double) / 100.0::double usd_saved from telemetry where "timestamp" >= {NOW_MS - 30 * V.DAY_MS} group by 1"""))
def _(s, d):
    return telemetry.daily_velocity(V.telemetry(s, d), 30, NOW_MS)


@query("sync_counts", sql("telemetry", "select count(*) total, cast(sum(case when synced = 0 then 1 else 0 end) as bigint) unsynced from telemetry"))
def _(s, d):
    return telemetry.sync_counts(V.telemetry(s, d))


_RECENT = 'order by "timestamp" desc, id desc limit'


@query("recent_events", sql("telemetry", f"select * from telemetry {_RECENT} 50"))
def _(s, d):
    return telemetry.recent(V.telemetry(s, d), 50)


@query("unsynced_batch", sql("telemetry", 'select * from telemetry where synced = 0 order by "timestamp", id limit 500'))
def _(s, d):
    return telemetry.unsynced(V.telemetry(s, d))


@query("zero_pii_packets", sql("telemetry", 'select id event_id, "timestamp", client_id, event_type, raw_tokens, sliced_tokens, tokens_saved, latency_us, status from telemetry'))
def _(s, d):
    return telemetry.zero_pii(V.telemetry(s, d))


@query("event_rows_ui", sql("telemetry", f"""select id, client_id, event_type, coalesce(nullif(symbol_name, ''), nullif(file_path, ''), '-') as label,
  cast(case when raw_tokens > 0 then round(tokens_saved::double / raw_tokens::double * 100) else 0 end as bigint) saved_pct,
  round(latency_us / 1000.0::double * 100.0::double) / 100.0::double latency_ms from telemetry {_RECENT} 50"""))
def _(s, d):
    return telemetry.event_rows(V.telemetry(s, d), 50)


@query("export_csv_lines", sql("telemetry", f"""select id, concat_ws(',', id, "timestamp", '"' || client_id || '"', '"' || event_type || '"', '"' || replace(coalesce(file_path, ''), '"', '""') || '"',
  '"' || replace(coalesce(symbol_name, ''), '"', '""') || '"', raw_tokens, sliced_tokens, tokens_saved, latency_us, '"' || status || '"') line from (select * from telemetry {_RECENT} 100000)"""))
def _(s, d):
    return telemetry.csv_lines(V.telemetry(s, d))


@query("export_json_lines", sql("telemetry", f"""select id, cast(to_json(struct_pack(id := id, "timestamp" := "timestamp", client_id := client_id, event_type := event_type, file_path := file_path, symbol_name := symbol_name,
  raw_tokens := raw_tokens, sliced_tokens := sliced_tokens, tokens_saved := tokens_saved, latency_us := latency_us, status := status, extra_json := extra_json)) as varchar) line from (select * from telemetry {_RECENT} 100000)"""))
def _(s, d):
    return telemetry.json_lines(V.telemetry(s, d))


@query("sync_after_mark", sql("telemetry", """, b as (select id from telemetry where synced = 0 order by "timestamp", id limit 500)
select t.id, case when b.id is not null then 1 else t.synced end synced from telemetry t left join b on t.id = b.id""".replace(", b as", "+b as", 1)))
def _(s, d):
    return telemetry.sync_batch(V.telemetry(s, d))[1].select("id", "synced")


_LEDGER = f"""l as (select id, "timestamp", symbol_name, raw_tokens, sliced_tokens, tokens_saved,
  case when raw_tokens > 0 then round(tokens_saved::double / raw_tokens::double * 100 * 10.0::double) / 10.0::double else 0.0::double end compression_pct
  from telemetry where event_type = 'slice' {_RECENT} 50)"""


@query("ledger_rank", sql("telemetry", f"""+{_LEDGER} select *, cast(row_number() over (order by "timestamp", id) as integer) number from l"""))
def _(s, d):
    return telemetry.ledger(V.telemetry(s, d))


@query("browser_metrics", sql("telemetry", f"""+{_LEDGER} select count(*) total_slices, cast(sum(tokens_saved) as bigint) total_tokens_saved,
  round(sum(tokens_saved)::double / 1e6 * 3.0::double * 100.0::double) / 100.0::double total_usd_saved, round(avg(compression_pct) * 10.0::double) / 10.0::double avg_compression from l"""))
def _(s, d):
    return telemetry.ledger_metrics(telemetry.ledger(V.telemetry(s, d)))


@query("roi_projection", """select c_custkey, team_size, prompts_per_day, price_per_million, team_size * prompts_per_day * 9500 * 21 tokens_monthly,
  (team_size * prompts_per_day * 9500 * 21) / 1e6 * price_per_million usd_monthly, cast(round(team_size * 2.5 * 12) as bigint) hours_annual
from (select c_custkey, c_custkey % 200 + 1 team_size, c_custkey % 80 + 5 prompts_per_day, case when c_custkey % 2 = 0 then 3.0::double else 15.0::double end price_per_million from customer)""")
def _(s, d):
    c = V.read(s, d, "customer")
    return telemetry.roi(c.select("c_custkey", (F.col("c_custkey") % 200 + 1).alias("team_size"), (F.col("c_custkey") % 80 + 5).alias("prompts_per_day"), F.when(F.col("c_custkey") % 2 == 0, 3.0).otherwise(15.0).alias("price_per_million")))


@query("compression", sql("telemetry", "select id, case when raw_tokens = 0 or sliced_tokens >= raw_tokens then 0::float else 1::float - (raw_tokens::float * 0 + sliced_tokens::float) / raw_tokens::float end compression_ratio from telemetry where event_type = 'slice'"))
def _(s, d):
    return V.telemetry(s, d).filter("event_type = 'slice'").select("id", X.compression_ratio(F.col("raw_tokens"), F.col("sliced_tokens")).alias("compression_ratio"))


# ---------------------------------------------------------------- text


@query("token_counts", "select doc_id, cast(ceil(strlen(coalesce(text, '')) / 3.8::double) as bigint) tokens from documents")
def _(s, d):
    return V.read(s, d, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


_PUNCT = r"""{}()\[\],.;:+\-*/=<>!&|^~"''`"""


@query("browser_token_counts", rf"""select doc_id, case when text is null or regexp_full_match(text, '\s*') then 0 else greatest(1, cast(list_sum(list_transform(
  regexp_extract_all(text, '(\s+|[{_PUNCT}]|[^\s{_PUNCT}]+)'), lambda p: case when length(p) <= 4 then 1 else cast(ceil(length(p) / 3.7::double) as bigint) end)) as bigint)) end tokens from documents""")
def _(s, d):
    return V.read(s, d, "documents").select("doc_id", X.count_tokens_by_words(F.col("text")).alias("tokens"))


@query("language_detect", sql("paths", r"""select p_partkey, case lower(regexp_extract(path, '\.([^./]*)$', 1)) when 'ts' then 'TypeScript' when 'tsx' then 'TypeScript' when 'js' then 'JavaScript' when 'jsx' then 'JavaScript'
  when 'mjs' then 'JavaScript' when 'cjs' then 'JavaScript' when 'py' then 'Python' when 'go' then 'Go' when 'rs' then 'Rust' else 'Unknown' end as language from paths"""))
def _(s, d):
    return V.paths(s, d).select("p_partkey", X.language_of(F.col("path")).alias("language"))


@query("risk_levels", sql("paths", r"""select p_partkey, path, case when regexp_matches(lower(path), '\.env|id_rsa|\.ssh|\.git/hooks|credentials|secret|\.\.') then 'Restricted'
  when regexp_matches(lower(path), '(cargo\.toml|package\.json|tsconfig\.json|\.lock)$|migration') then 'Warning' else 'Safe' end as risk from paths"""))
def _(s, d):
    return V.paths(s, d).select("p_partkey", "path", X.mutation_risk(F.col("path")).alias("risk"))


@query("supported_files", sql("paths", r"select p_partkey from paths where regexp_extract(path, '\.([^./]*)$', 1) in ('ts', 'tsx', 'js', 'jsx', 'py', 'rs', 'go') and not regexp_matches(path, '(^|/)(\.git|node_modules|target|\.codeloom|\.next|dist)/')"))
def _(s, d):
    return V.paths(s, d).filter(guard.supported(F.col("path")) & guard.outside_ignored(F.col("path"))).select("p_partkey")


@query("preset_infer", sql("repo_files", """select repo, case when bool_or(path in ('next.config.js', 'next.config.mjs', 'next.config.ts')) then 'nextjs-app'
  when bool_or(path in ('pyproject.toml', 'requirements.txt', 'Pipfile')) then 'fastapi' when bool_or(path = 'Cargo.toml') then 'rust' else 'clean-architecture' end preset from repo_files group by repo"""))
def _(s, d):
    return guard.inferred_preset(V.repo_files(s, d))


@query("sanitize", sql("comments", """select conv_id, turn, """ + "replace(" * 11 + "text" + "".join(f", '{t}', '{X.BLOCKED_TOKEN}')" for t in X.CONTROL_TOKENS) + "".join(f", '{t}', '{X.BLOCKED_PHRASE}')" for t in X.OVERRIDE_PHRASES) + " as text from comments"))
def _(s, d):
    return V.comments(s, d).select("conv_id", "turn", X.sanitized(F.col("text")).alias("text"))


@query("sanitize_any_case", sql("comments", """select conv_id, turn, """ + "regexp_replace(" * 5 + "replace(" * 6 + "text" + "".join(f", '{t}', '{X.BLOCKED_TOKEN}')" for t in X.CONTROL_TOKENS) + "".join(f", '{t}', '{X.BLOCKED_PHRASE}', 'gi')" for t in X.OVERRIDE_PHRASES) + " as text from comments"))
def _(s, d):
    return V.comments(s, d).select("conv_id", "turn", X.sanitized(F.col("text"), any_case=True).alias("text"))


@query("content_hash", "select doc_id, sha256(coalesce(text, '')) hash from documents")
def _(s, d):
    return V.read(s, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("idempotency_keys", "select o_orderkey, sha256(concat_ws(':', o_orderpriority, o_orderstatus, o_custkey)) idempotency_key from orders")
def _(s, d):
    return V.read(s, d, "orders").select("o_orderkey", X.idempotency_key(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("idempotency_key"))


@query("webhook_verify", """select o_orderkey, header = sig or ends_with(header, sig) is_valid from (
  select o_orderkey, sig, case o_orderkey % 3 when 0 then sig when 1 then 'sha256=' || sig else 'sha256=' || upper(sig) end header
  from (select o_orderkey, """ + hmac("secret", "o_orderpriority || o_orderkey") + """ sig from orders))""")
def _(s, d):
    o = V.read(s, d, "orders").withColumn("payload", F.concat("o_orderpriority", F.col("o_orderkey").cast("string")))
    sig = X.signature(F.col("payload"), "secret")
    header = F.when(F.col("o_orderkey") % 3 == 0, sig).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("sha256="), sig)).otherwise(F.concat(F.lit("sha256="), F.upper(sig)))
    return o.select("o_orderkey", X.signature_matches(header, F.col("payload"), "secret").alias("is_valid"))


@query("org_slugs", "select c_custkey, 'org_' || replace(lower(c_mktsegment || ' ' || c_name), ' ', '_') slug from customer")
def _(s, d):
    return V.read(s, d, "customer").select("c_custkey", X.org_slug(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("slug"))


@query("github_urls", r"""select p_partkey, regexp_extract(u, p, 1) as owner, regexp_replace(regexp_extract(u, p, 2), '\.git$', '') repo, coalesce(nullif(regexp_extract(u, p, 3), ''), 'main') branch, nullif(regexp_extract(u, p, 4), '') file_path
from (select p_partkey, 'github\.com/([^/]+)/([^/]+)(?:/blob/([^/]+)/(.+))?' p, regexp_replace(regexp_replace(case p_partkey % 3 when 0 then 'https://github.com/' || replace(p_name, ' ', '/') || '.git/' when 1 then ' http://github.com/' || replace(p_name, ' ', '/') || '/blob/dev/src/a.ts ' else 'https://example.com/' || p_partkey end, '^\s*(https?://)?|\s+$', '', 'g'), '/$', '') u from part) where regexp_matches(u, p)""")
def _(s, d):
    name = F.replace("p_name", F.lit(" "), F.lit("/"))
    k = F.col("p_partkey") % 3
    url = F.when(k == 0, F.concat(F.lit("https://github.com/"), name, F.lit(".git/"))).when(k == 1, F.concat(F.lit(" http://github.com/"), name, F.lit("/blob/dev/src/a.ts "))).otherwise(F.concat(F.lit("https://example.com/"), F.col("p_partkey").cast("string")))
    return V.read(s, d, "part").select("p_partkey", X.github_parts(url).alias("g")).filter("g is not null").select("p_partkey", "g.*")


@query("progress_bars", sql("telemetry", "select client_id, repeat('█', n) || repeat('░', greatest(24 - n, 0)) bar from (select client_id, cast(round((sum(tokens_saved)::double / sum(raw_tokens)::double) * 24) as integer) n from telemetry where event_type = 'slice' group by 1)"))
def _(s, d):
    by = V.telemetry(s, d).filter("event_type = 'slice'").groupBy("client_id").agg((F.sum("tokens_saved").cast("double") / F.sum("raw_tokens").cast("double")).alias("ratio"))
    return by.select("client_id", X.progress_bar(F.col("ratio")).alias("bar"))


@query("trace_symbols", r"""select doc_id, coalesce(nullif(case when hit is null then null when contains(hit, '::') then regexp_extract(list_last(string_split(hit, '::')), '^[^\s''"(:]*') else regexp_extract(string_split(hit, 'at ')[2], '^[^\s(:]*') end, ''), 'test_target') symbol
from (select doc_id, list_filter(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), lambda x: contains(x, '::') or contains(x, 'at '))[1] hit
  from (select doc_id, case when doc_id % 4 = 0 then 'panicked' || chr(10) || 'tests::mod_a::check_' || doc_id || ' (x)' || chr(10) else '' end || coalesce(text, '') t from documents))""")
def _(s, d):
    put = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("panicked\ntests::mod_a::check_"), F.col("doc_id").cast("string"), F.lit(" (x)\n"))).otherwise(F.lit(""))
    return V.read(s, d, "documents").select("doc_id", X.symbol_from_trace(F.concat(put, F.coalesce("text", F.lit("")))).alias("symbol"))


# ---------------------------------------------------------------- guard

#: Rules for the pages' links.
RULES = [("English to The", "en/**", ["/the**", "/of/**"], "English pages keep to themselves."), ("Numbered pages", "*/1*", ["/and/**", "/[A-D]*"], "Pages from 1 on."), ("Invalid", "a**b", ["/x"], "")]

_FIRST = """select *, case
    when regexp_matches(source_file, '^en/.*$') and starts_with(imported_module, '/of') then 1
    when regexp_matches(source_file, '^.*/1.*$') and (starts_with(imported_module, '/and') or regexp_matches(imported_module, '^/[A-D].*$') or starts_with(imported_module, '/[A-D]*')) then 2 end r from imports"""
_VIOLATIONS = f"""v as (select page_id, import_ord, source_file, imported_module, case r when 1 then 'English to The' else 'Numbered pages' end rule_name,
  case r when 1 then 'English pages keep to themselves.' else 'Pages from 1 on.' end message from ({_FIRST}) where r is not null)"""


def _violations(s, d):
    return guard.check_imports(V.imports(s, d), RULES)


@query("guard_violations", sql("imports", f"+{_VIOLATIONS} select page_id, import_ord, source_file, imported_module, rule_name, message from v"))
def _(s, d):
    return _violations(s, d)


@query("guard_report", sql("imports", f"""+{_VIOLATIONS} select f.n total_files_checked, w.n violations, greatest(f.n - w.n, 0) clean_files, f.n - w.bad files_without_violation
from (select count(distinct source_file) n from imports) f, (select count(*) n, count(distinct source_file) bad from v) w"""))
def _(s, d):
    files = V.imports(s, d).select(F.col("source_file").alias("file_path"))
    return guard.report(files, _violations(s, d))


@query("guard_annotations", sql("imports", f"""+{_VIOLATIONS} select page_id, import_ord, '::error file=' || source_file || ',title=Architecture Violation::Rule ''' || rule_name || ''' violated: Cannot import ''' || imported_module || '''. ' || message as annotation from v"""))
def _(s, d):
    return guard.annotations(_violations(s, d)).select("page_id", "import_ord", "annotation")


@query("guard_markdown_rows", sql("imports", f"""+{_VIOLATIONS} select page_id, import_ord, '| **' || rule_name || '** | `' || source_file || '` | `' || imported_module || '` | ' || message || ' |' as row from v"""))
def _(s, d):
    return guard.markdown_rows(_violations(s, d)).select("page_id", "import_ord", "row")


@query("guard_changed_files", sql("imports", f"""+{_VIOLATIONS} select page_id, import_ord, rule_name from v where source_file in (select regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) from pages where page_id % 2 = 0)"""))
def _(s, d):
    changed = V.read(s, d, "pages").filter("page_id % 2 = 0").select(F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1).alias("c")).distinct()
    return _violations(s, d).join(changed, F.col("source_file") == F.col("c"), "left_semi").select("page_id", "import_ord", "rule_name")


_LINES = r"""ln as (select file_path, unnest(range(len(ls))) k, unnest(ls) as line from (
  select file_path, case when ls[len(ls)] = '' then ls[1:len(ls) - 1] else ls end ls from (select file_path, string_split_regex(content, '\r?\n') ls from {})))"""
_CODE = """code as (select file_path, case when doc_id % 3 = 0 then 'import ''m' || doc_id || ''';' || chr(10) || 'from pkg.sub import x' || chr(10) || 'import { a } from "src/db/' || doc_id || '";' || chr(10) || 'export function f' || doc_id || '(a) {' || chr(10) || '  return from ' || chr(10) || '}' || chr(10) || 'def g_' || doc_id || '(x): pass' || chr(10) || 'pub struct S' || doc_id || ' {}' || chr(10) else '' end || content as content from source_files)"""


def _code(s, d) -> DataFrame:
    """Files with a few lines of code before the text."""
    n = F.col("doc_id").cast("string")
    put = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("import 'm"), n, F.lit("';\nfrom pkg.sub import x\nimport { a } from \"src/db/"), n, F.lit("\";\nexport function f"), n, F.lit("(a) {\n  return from \n}\ndef g_"), n, F.lit("(x): pass\npub struct S"), n, F.lit(" {}\n"))).otherwise(F.lit(""))
    return V.source_files(s, d).select("file_path", F.concat(put, "content").alias("content"))


@query("import_extract", sql("source_files", rf"""+{_CODE}, {_LINES.format('code')}, t as (select file_path, k + 1 line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') l from ln),
r as (select *, strpos(l, 'from ') p, regexp_replace(substr(l, strpos(l, 'from ') + 5), '^\s+|\s+$', '', 'g') rest from t),
m as (select file_path source_file, line_no, case when p > 0 and rest = '' then null else coalesce(
  case when p > 0 and rest[1] in ('''', '"') and strpos(rest[2:], rest[1]) > 0 then substr(rest, 2, strpos(rest[2:], rest[1]) - 1) end,
  case when starts_with(l, 'from ') then nullif(regexp_extract(l, '^from \s*(\S+)', 1), '') end,
  case when starts_with(l, 'import ') and regexp_extract(l, '^import \s*(\S+)', 1) <> '' then regexp_replace(regexp_extract(l, '^import \s*(\S+)', 1), '^['';"]+|['';"]+$', '', 'g') end) end imported_module from r)
select * from m where imported_module is not null"""))
def _(s, d):
    return guard.file_imports(_code(s, d))


# ---------------------------------------------------------------- symbols and index


@query("line_symbols", sql("source_files", "+" + _CODE + r""", ln as (select file_path, unnest(range(len(ls))) + 1 line_no, unnest(ls) as line from (select file_path, string_split(content, chr(10)) ls from code)),
t as (select file_path, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') signature, regexp_extract(file_path, '\.([^./]*)$', 1) e from ln),
p(e, o, pat) as (values """ + ", ".join(f"('{e}', {k}, '{p}')" for e, name in (("ts", "TypeScript"), ("py", "Python"), ("rs", "Rust"), ("go", "Go")) for k, p in enumerate(symbols.PATTERNS[name])) + r"""),
m as (select file_path, line_no, signature, o, regexp_extract(signature, pat, 1) as name from t join p on t.e = p.e
  where regexp_matches(signature, 'function|const|let|var|interface|type|class|def|fn|struct|enum|trait|func|\(')),
f as (select file_path, line_no, signature, arg_min(name, o) as name from m where name <> '' and name not in ('if', 'for', 'while', 'switch', 'catch', 'constructor') group by 1, 2, 3)
select file_path, name, cast(min(line_no) as integer) line_no, arg_min(signature, line_no) signature from f group by 1, 2"""))
def _(s, d):
    return symbols.line_symbols(_code(s, d))


@query("function_nodes", sql("source_files", rf"""+{_CODE}, {_LINES.format('code')}, t as (select *, regexp_replace(line, '^\s+|\s+$', '', 'g') l from ln),
n as (select *, trim(regexp_extract(l, '^(?:export function |export async function |function |def |pub fn |fn )([^(]*)', 1)) as name from t)
select 'repo://demo/' || file_path || '#' || name as id, name symbol_name, 'Function' kind, case regexp_extract(file_path, '\.([^./]*)$', 1) when 'ts' then 'TypeScript' when 'py' then 'Python' when 'rs' then 'Rust' else 'Go' end as language,
  file_path, cast(k + 1 as integer) start_line, cast(k + 1 as integer) end_line, cast(strlen(line) as integer) end_col from n where name <> ''"""))
def _(s, d):
    return symbols.function_nodes(_code(s, d), "demo")


@query("lexical_slice", sql("source_files", r"""+t as (select file_path, content, case when ls[len(ls)] = '' then ls[1:len(ls) - 1] else ls end ls from (select *, string_split_regex(content, '\r?\n') ls from source_files)),
h as (select *, list_position(list_transform(ls, lambda x: contains(x, 'the')), true) p from t),
c as (select *, greatest(p - 2, 1) a, ls[greatest(p - 2, 1):p + 24] cut from h where p > 0),
k as (select *, cast(ceil(strlen(array_to_string(cut, chr(10)) || chr(10)) / 3.8::double) as bigint) s, cast(ceil(strlen(content) / 3.8::double) as bigint) o from c)
select file_path, cast(a as integer) first_line, array_to_string(cut, chr(10)) lines, s estimated_tokens, o original_file_tokens,
  case when o = 0 or s >= o then 0::float else 1::float - s::float / o::float end compression_ratio, true syntax_degraded from k"""))
def _(s, d):
    return symbols.lexical_slices(V.source_files(s, d), F.lit("the")).select("file_path", "first_line", F.array_join("lines", "\n").alias("lines"), "estimated_tokens", "original_file_tokens", "compression_ratio", "syntax_degraded")


_CACHE = """files as (select file_path, sha256(content) hash from source_files),
cache as (select file_path, case when doc_id % 4 = 1 then 'old' else sha256(content) end hash, doc_id last_indexed_at from source_files where doc_id % 4 <> 0)"""


def _cache(s, d) -> tuple[DataFrame, DataFrame]:
    f = V.source_files(s, d).withColumn("h", X.content_hash(F.col("content")))
    cache = f.filter("doc_id % 4 <> 0").select("file_path", F.when(F.col("doc_id") % 4 == 1, "old").otherwise(F.col("h")).alias("hash"), F.col("doc_id").alias("last_indexed_at"))
    return f.select("file_path", F.col("h").alias("hash")), cache


@query("stale_files", sql("source_files", f"+{_CACHE} select f.file_path, f.hash from files f where not exists (select 1 from cache c where c.file_path = f.file_path and c.hash = f.hash)"))
def _(s, d):
    return index.stale_files(*_cache(s, d))


@query("file_freshness", sql("source_files", f"+{_CACHE} select f.file_path, f.hash, coalesce(c.hash = f.hash, false) is_cached from files f left join cache c on c.file_path = f.file_path"))
def _(s, d):
    return index.freshness(*_cache(s, d))


@query("file_cache_upsert", sql("source_files", f"""+{_CACHE} select file_path, hash, last_indexed_at from (select *, row_number() over (partition by file_path order by last_indexed_at desc, hash desc) n
  from (select * from cache union all select file_path, hash, 1000000 from files where hash < '8')) where n = 1"""))
def _(s, d):
    files, cache = _cache(s, d)
    return index.upsert_file_cache(cache, files.filter("hash < '8'").withColumn("last_indexed_at", F.lit(1000000).cast("long")))


@query("cache_lookup", "select content_hash, min(doc_id) doc_id, count(*) copies from (select sha256(coalesce(text, '')) content_hash, doc_id from documents) group by 1 having count(*) > 1")
def _(s, d):
    rows = V.read(s, d, "documents").select(X.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    again = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    stored = index.cache_get(index.cache_put(rows.withColumn("cached_at", -F.col("doc_id")).limit(0), rows.withColumn("cached_at", -F.col("doc_id"))), again)
    return stored.join(again.withColumnRenamed("content_hash", "h"), F.col("content_hash") == F.col("h")).select("content_hash", "doc_id", "copies")


_INDEX = "idx as (select id, file_path, symbol_name, 1 start_line, 1 end_line from symbols), fresh as (select id, file_path, symbol_name, cast(id % 7 as integer) start_line, cast(id % 7 + id % 3 as integer) end_line from symbols where file_path < 'Brand#3')"


def _symbols(s, d) -> tuple[DataFrame, DataFrame]:
    p = V.symbols(s, d)
    one = F.lit(1)
    old = p.select("id", "file_path", "symbol_name", one.alias("start_line"), one.alias("end_line"))
    new = p.filter("file_path < 'Brand#3'").select("id", "file_path", "symbol_name", (F.col("id") % 7).cast("int").alias("start_line"), (F.col("id") % 7 + F.col("id") % 3).cast("int").alias("end_line"))
    return old, new


@query("symbol_replace", sql("symbols", f"""+{_INDEX} select id, file_path, symbol_name, start_line, end_line from idx where file_path not in (select file_path from fresh)
union all select id, file_path, symbol_name, start_line, end_line from (select *, row_number() over (partition by file_path, symbol_name order by start_line, end_line desc, id) n from fresh) where n = 1"""))
def _(s, d):
    old, new = _symbols(s, d)
    return index.replace_symbols(old, new.select("file_path"), new)


@query("symbol_lookup", sql("symbols", f"+{_INDEX} select min(id) id, file_path, symbol_name from idx where file_path like '%1' group by 2, 3"))
def _(s, d):
    old, _ = _symbols(s, d)
    return index.lookup(old.select("id", "file_path", "symbol_name"), old.filter("file_path like '%1'"))


SEARCHES = ["ring", "almond  ", "STEEL", "antique blue", "brand#1", "zz", ""]
_PAIRS = "q(query) as (values ('ring'), ('almond  '), ('STEEL'), ('antique blue'), ('brand#1'), ('zz'), (''))"
_TIERS = """case when lower(trim(query)) = lower(trim(symbol_name)) then 100 when starts_with(lower(trim(symbol_name)), lower(trim(query))) then 95
  when contains(lower(trim(symbol_name)), lower(trim(query))) then 85 when contains(lower(trim(query)), lower(trim(symbol_name))) then 80
  when contains(lower(docstring), lower(trim(query))) then 70 when contains(lower(file_path), lower(trim(query))) then 50 else 0 end"""


@query("symbol_search_native", sql("symbols", f"+{_PAIRS} select query, id, symbol_name, file_path, {_TIERS} score from symbols, q where {_TIERS} > 0"))
def _(s, d):
    return search.scored(V.symbols(s, d), SEARCHES, similar=False)


@query("symbol_search_top", sql("symbols", f"+{_PAIRS} select * from (select query, id, symbol_name, file_path, {_TIERS} score, cast(row_number() over (partition by query order by {_TIERS} desc, id) as integer) as rank from symbols, q where {_TIERS} > 0) where rank <= 5"))
def _(s, d):
    return search.top_k(search.scored(V.symbols(s, d), SEARCHES, similar=False), 5)


@query("symbol_search_full")
def _(s, d):
    return search.scored(V.symbols(s, d), ["smal rign", "blueBolt", "old giszmo", "economy"])


@query("resolve_target", sql("symbols", """+q(query) as (values ('ring'), ('almond antique'), ('brand#11'), ('small thing')),
r as (select query, id, symbol_name, file_path, case when lower(symbol_name) = lower(query) then 100 when contains(lower(symbol_name), query) then 80 when contains(query, lower(symbol_name)) then 60 when contains(lower(file_path), query) then 40 end score from symbols, q)
select query, symbol_name, file_path, score from (select *, row_number() over (partition by query order by score desc, id) n from r where score is not null) where n = 1"""))
def _(s, d):
    return search.resolve(V.symbols(s, d), ["ring", "almond antique", "brand#11", "small thing"])


@query("symbol_filter", sql("symbols", "select * from symbols where contains(lower(symbol_name), 'blue') or contains(lower(file_path), 'blue') order by id limit 30"))
def _(s, d):
    return search.filtered(V.symbols(s, d), " Blue ")


@query("spiral_layout", sql("symbols", "select id, cast(place as integer) place, round(400 + cos((place * 0.4::double) % (2 * pi())) * (120 + place * 4.0::double), 6) x, round(260 + sin((place * 0.4::double) % (2 * pi())) * (120 + place * 4.0::double), 6) y from (select id, row_number() over (order by id) - 1 place from symbols order by id limit 60)"))
def _(s, d):
    hits = V.symbols(s, d).orderBy("id").limit(60)
    return search.spiral(hits, ["id"]).select("id", "place", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("chat_symbols", "select item_id, case when contains(lower(text), 'erble') then 'erBle' when contains(lower(text), 'tion') then 'Tion' else 'zebra' end symbol from benchmark")
def _(s, d):
    return search.named_in(V.read(s, d, "benchmark").select("item_id", F.col("text").alias("question")), ["zebra", "erBle", "Tion"]).select("item_id", "symbol")


# Of a file in each language: what is before its text, the line mark of a
# comment, and the lines (from, to) of the function and of the contract.
_HEADS = {
    "ts": ("interface Shape {\\n  a: string\\n}\\ninterface Idle { b: number }\\nexport function f@(x: Shape) {\\n  return '{ Idle'; // Idle }\\n}\\n", "// ", (5, 7), (1, 3)),
    "py": ("class Shape:\\n    a = 1\\n\\n\\nclass Idle:\\n    pass\\n\\n\\ndef f@(x: Shape):\\n    # Idle\\n    return 'Idle'\\n\\n\\n", "# ", (9, 11), (1, 2)),
    "rs": ("pub struct Shape {\\n    a: u32,\\n}\\nstruct Idle;\\npub fn f@(x: Shape) -> u32 {\\n    x.Idle + 1 // Idle }\\n}\\n", "// ", (5, 7), (1, 3)),
    "go": ("type Shape struct {\\n\\ta int\\n}\\ntype Idle struct {\\n}\\nfunc f@(x Shape) string {\\n\\treturn x.Idle + \"{ Idle\"\\n}\\n", "// ", (6, 8), (1, 3)),
}


def _sliced_sql() -> str:
    """Function and contract of every file, or the lines around ``the`` in the
    third of the files that is asked for that word."""
    heads = ", ".join("('{}', '{}', '{}', {}, {}, {}, {})".format(e, h.replace("'", "''"), mark, *body, *contract) for e, (h, mark, body, contract) in _HEADS.items())
    return rf"""+h(e, head, mark, f1, f2, c1, c2) as (values {heads}),
t as (select file_path, doc_id, f1, f2, c1, c2, replace(replace(replace(head, '\n', chr(10)), '\t', chr(9)), '@', cast(doc_id as varchar)) || mark || replace(replace(replace(content, chr(13), ' '), chr(10), chr(10) || mark), chr(11), ' ') as content
  from source_files join h on e = regexp_extract(file_path, '\.([^./]*)$', 1)),
l as (select *, case when ls[len(ls)] = '' then ls[1:len(ls) - 1] else ls end ls2 from (select *, string_split(content, chr(10)) ls from t)),
r as (
  select file_path, 'f' || doc_id as target_symbol, f1 first_line, ls2[f1:f2] body, array_to_string(ls2[c1:c2], chr(10)) contract, content, false syntax_degraded from l where doc_id % 3 <> 1
  union all select file_path, 'the', greatest(p - 2, 1), ls2[greatest(p - 2, 1):p + 24], null, content, true from (select *, list_position(list_transform(ls2, lambda x: contains(x, 'the')), true) p from l where doc_id % 3 = 1) where p > 0
), k as (select *, cast(ceil(strlen(coalesce(contract || chr(10), '') || array_to_string(body, chr(10)) || chr(10)) / 3.8::double) as bigint) s, cast(ceil(strlen(content) / 3.8::double) as bigint) o from r)
select file_path, target_symbol, cast(first_line as integer) first_line, array_to_string(body, chr(10)) body, coalesce(contract, '') contracts, s estimated_tokens, o original_file_tokens,
  case when o = 0 or s >= o then 0::float else 1::float - s::float / o::float end compression_ratio, syntax_degraded from k"""


@query("ast_slice", sql("source_files", _sliced_sql()))
def _(s, d):
    """A slice of every file: two thirds by a function, the others by a word."""
    f = V.source_files(s, d).withColumn("ext", X.extension(F.col("file_path")))
    of = lambda k: F.create_map(*[F.lit(x) for e, h in _HEADS.items() for x in (e, h[k].replace("\\n", "\n").replace("\\t", "\t"))])[F.col("ext")]
    text = F.replace(F.replace(F.replace("content", F.lit("\r"), F.lit(" ")), F.lit("\n"), F.concat(F.lit("\n"), of(1))), F.lit("\v"), F.lit(" "))
    files = f.select("file_path", "doc_id", F.concat(F.replace(of(0), F.lit("@"), F.col("doc_id").cast("string")), of(1), text).alias("content"))
    targets = files.select("file_path", F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).otherwise("the").alias("symbol"))
    made = slicer.slices(files.select("file_path", "content"), targets)
    return made.select("file_path", "target_symbol", F.get("sparse_code_lines", F.lit(0))["line_no"].alias("first_line"), F.array_join("sparse_code_lines.line", "\n").alias("body"), F.array_join("type_contracts", "\n").alias("contracts"), "estimated_tokens", "original_file_tokens", "compression_ratio", "syntax_degraded")


# ---------------------------------------------------------------- graph

_VERSIONS = "old as (select *, 1 as version from graph_nodes), new as (select id, upper(name) as name, file, 2 as version from graph_nodes where length(id) % 2 = 0), gone as (select id from graph_nodes where file = 'order' and id like '%7')"


def _nodes(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = V.graph_nodes(s, d)
    new = n.filter("length(id) % 2 = 0").select("id", F.upper("name").alias("name"), "file", F.lit(2).alias("version"))
    return n.withColumn("version", F.lit(1)), new, n.filter("file = 'order' and id like '%7'").select("id")


@query("graph_upsert", sql("graph_nodes", f"+{_VERSIONS} select id, name, file, version from (select *, row_number() over (partition by id order by version desc) n from (select * from old union all select * from new)) where n = 1"))
def _(s, d):
    old, new, _ = _nodes(s, d)
    return graph.upsert_nodes(old, new)


_DELTA = f"""{_VERSIONS}, kept as (select id, name, file, version from (select *, row_number() over (partition by id order by version desc) n from (select * from old where id not in (select id from gone) union all select * from new)) where n = 1)"""


@query("graph_delta_nodes", sql("graph_nodes", f"+{_DELTA} select * from kept"))
def _(s, d):
    old, new, gone = _nodes(s, d)
    edges = V.graph_edges(s, d).withColumn("version", F.lit(1))
    return graph.apply_delta(old, edges, new, gone, edges.limit(0))[0]


@query("graph_delta_edges", sql("graph_nodes graph_edges", f"+{_DELTA} select source_id, target_id, edge_type, 1 as version from graph_edges where source_id in (select id from kept) and target_id in (select id from kept)"))
def _(s, d):
    old, new, gone = _nodes(s, d)
    edges = V.graph_edges(s, d).withColumn("version", F.lit(1))
    return graph.apply_delta(old, edges, new, gone, edges.limit(0))[1]


@query("edge_endpoint_check", sql("graph_nodes graph_edges", "select source_id, target_id, edge_type from graph_edges where source_id in (select id from graph_nodes) and target_id in (select id from graph_nodes)"))
def _(s, d):
    return graph.existing_edges(V.graph_edges(s, d), V.graph_nodes(s, d))


@query("blast_radius_2hop", sql("graph_edges", """+step as (select source_id, target_id from graph_edges where edge_type in ('CALLS', 'MUTATES_SCHEMA', 'IMPORTS')),
walk(seed, id, depth) as (select source_id, target_id, 1 from step union all select w.seed, s.target_id, w.depth + 1 from walk w join step s on s.source_id = w.id where w.depth < 2)
select seed, id, cast(min(depth) as integer) depth from walk group by 1, 2"""))
def _(s, d):
    edges = V.graph_edges(s, d)
    return graph.blast_radius(edges, edges.select(F.col("source_id").alias("id")), 2)


@query("duplicate_node_ids", sql("graph_nodes", "select file, id, count(*) n from graph_nodes group by 1, 2 having count(*) > 1"))
def _(s, d):
    return graph.duplicate_ids(V.graph_nodes(s, d))


# ---------------------------------------------------------------- outbox, proofs, streams


@query("outbox_dedupe", sql("outbox", "select idempotency_key, min(aggregate_id) aggregate_id from outbox group by 1"))
def _(s, d):
    return outbox.first_of_each_key(V.outbox(s, d).select("idempotency_key", "aggregate_id"), "aggregate_id")


@query("outbox_pending", sql("outbox", "select * from outbox where status = 'PENDING'"))
def _(s, d):
    return outbox.pending(V.outbox(s, d), ["created_on", "aggregate_id"])


@query("outbox_insert_new", sql("outbox", "select idempotency_key, min(aggregate_id) aggregate_id from outbox where aggregate_id % 2 = 0 group by 1 union all select idempotency_key, min(aggregate_id) from outbox where aggregate_id % 2 = 1 and idempotency_key not in (select idempotency_key from outbox where aggregate_id % 2 = 0) group by 1"))
def _(s, d):
    rows = V.outbox(s, d).select("idempotency_key", "aggregate_id")
    first = lambda k: outbox.first_of_each_key(rows.filter(f"aggregate_id % 2 = {k}"), "aggregate_id")
    return outbox.insert_new(first(0), first(1))


@query("agent_locks", "select user_id agent_id, max(event_id) last_event, arg_max(event_type, event_id) as role from events group by 1")
def _(s, d):
    held = outbox.locks(V.read(s, d, "events").select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("last_event"), F.col("event_type").alias("role")), "last_event")
    return held


@query("swarm_size", "select count(distinct user_id) swarm_peers_count from events")
def _(s, d):
    return outbox.swarm_size(V.read(s, d, "events").select(F.col("user_id").alias("agent_id")))


@query("quarantine_actions", "select o_orderkey, case o_orderstatus when 'O' then 'APPROVED' when 'F' then 'DISPATCHED_TO_AGENT' end new_status from orders")
def _(s, d):
    action = F.when(F.col("o_orderstatus") == "O", "OVERRIDE_APPROVE").when(F.col("o_orderstatus") == "F", "TRIGGER_AGENT_REPAIR").otherwise("OTHER")
    return V.read(s, d, "orders").select("o_orderkey", proof.quarantine_action(action).alias("new_status"))


@query("fault_delay", "select l_orderkey, l_linenumber, cast(least(cast(l_quantity as bigint) + l_linenumber * 3 + (l_linenumber % 4) * 5, 40) as bigint) delay_ms from lineitem")
def _(s, d):
    fault = lambda kind, delay, retry, jitter: F.struct(F.lit(kind).alias("type"), delay.cast("long").alias("delay_ms"), retry.cast("long").alias("retry_count"), jitter.cast("long").alias("jitter_ms"))
    zero, n = F.lit(0), F.col("l_linenumber")
    faults = F.array(fault("NetworkLatency", F.col("l_quantity").cast("long"), zero, zero), fault("CpuThrottle", n * 3, zero, zero), fault("LockContention", zero, n % 4, F.lit(5)))
    return V.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", proof.injected_delay(faults, F.lit(40)).alias("delay_ms"))


_RUNS = "runs as (select cast(o_orderkey as varchar) commit_sha, 1700000000 + o_orderkey as \"timestamp\", case when o_orderkey % 5 = 0 then 2 else 0 end violations, (o_orderkey % 1000) / 1000.0::double ratio, case when o_orderkey % 7 = 0 then 0.0::double else 1.0::double end resilience from orders)"


def _runs(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    return V.read(s, d, "orders").select(k.cast("string").alias("commit_sha"), (k + 1700000000).alias("timestamp"), F.when(k % 5 == 0, 2).otherwise(0).alias("violations"), ((k % 1000) / F.lit(1000.0)).alias("ratio"), F.when(k % 7 == 0, 0.0).otherwise(1.0).alias("resilience"))


@query("proof_status", f"with {_RUNS} select commit_sha, case when violations = 0 and resilience >= 0.95 then 'VERIFIED_GREEN' else 'QUARANTINED' end status from runs")
def _(s, d):
    return _runs(s, d).select("commit_sha", proof.status(F.col("violations"), F.col("resilience")).alias("status"))


@query("proof_sign", f"""with {_RUNS}, p as (select *, case when violations = 0 and resilience >= 0.95 then 'VERIFIED_GREEN' else 'QUARANTINED' end status from runs),
g as (select *, {hmac("key", "concat_ws(':', commit_sha, \"timestamp\", status, violations, printf('%.3f', ratio), printf('%.3f', resilience))")} signature from p)
select commit_sha, status, signature, 'proof_' || signature[1:16] proof_id, true is_valid from g""")
def _(s, d):
    return proof.verified(proof.signed(_runs(s, d), "key"), "key").select("commit_sha", "status", "signature", "proof_id", "is_valid")


@query("swarm_verdicts", """select commit_sha, cast(sum(case when o_orderkey % 5 = 0 then 1 else 0 end) as bigint) violations, cast(min(case when o_orderkey % 700 = 0 then 0.0 else 1.0 end) as double) resilience,
  1.0::double - cast(sum(o_orderkey % 100) as double) / cast(sum(o_orderkey) as double) ratio,
  case when sum(case when o_orderkey % 5 = 0 then 1 else 0 end) = 0 and min(case when o_orderkey % 700 = 0 then 0.0 else 1.0 end) >= 0.95 then 'VERIFIED_GREEN' else 'QUARANTINED' end status
from (select o_orderkey, cast(o_custkey as varchar) commit_sha from orders) group by 1""")
def _(s, d):
    k = F.col("o_orderkey")
    return proof.swarm_verdict(V.read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("commit_sha"), F.when(k % 5 == 0, 1).otherwise(0).alias("violations"), F.when(k % 700 == 0, 0.0).otherwise(1.0).alias("resilience"), (k % 100).alias("sliced_tokens"), k.alias("raw_tokens")))


@query("stream_index_equals_batch", SQL["line_symbols"])
def _(s, d):
    """The streamed index over all files: the same rows as in one batch."""
    folder = scratch_folder(s, "stream-index")
    _code(s, d).withColumn("changed_at", F.lit(1).cast("long")).write.parquet(f"{folder}/log")
    indexer = Indexer(s, folder)
    log = s.readStream.schema("file_path STRING, content STRING, changed_at BIGINT").parquet(f"{folder}/log")
    indexer.start(log, f"{folder}/checkpoint").awaitTermination()
    return indexer.symbols.read()
