"""Architecture guard: layer rules on imports, first match wins.

Rules are a few rows of configuration, written into the plan as literals: each
import is matched by one projection, without a join or a shuffle.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RULES
from ..functions.text import SUPPORTED_EXTENSIONS, extension, imported_module, lines, trim

# The presets, as (name, from, cannot import, message).
_NEXT = [
    ("UI Isolation", "src/components/**", ["src/db/**", "@prisma/client", "typeorm", "mongoose"], "UI components must not import database clients directly. Use API routes or services."),
    ("Client-Server Boundary", "src/app/**/page.tsx", ["@/server/secrets"], "Client pages must not import server secrets."),
]
_PYTHON = [
    ("Domain Isolation", "app/domain/**", ["sqlalchemy", "app/infra/**", "fastapi"], "Domain models must not import SQLAlchemy or framework controllers."),
    ("Route-to-DB Boundary", "app/routers/**", ["sqlalchemy.orm.Session"], "Routers must depend on service dependencies, not direct DB sessions."),
]
_RUST = [("Core Independence", "crates/*-core/**", ["tokio", "hyper", "axum"], "Core crates must not depend on heavy async/network runtimes.")]
_CLEAN = [
    ("UI-to-DB Boundary", "src/ui/**", ["src/db/**", "src/infra/**"], "Presentation layer cannot directly depend on infrastructure or database layers."),
    ("Domain Purity", "src/domain/**", ["express", "fastify", "src/controllers/**"], "Domain entities must be pure and decoupled from HTTP presentation frameworks."),
]
DEFAULT_MESSAGE = "Architectural layer boundary violation detected"

Rule = tuple[str, str, list[str], str]


def preset(name: str | None) -> list[Rule]:
    return {"nextjs": _NEXT, "nextjs-app": _NEXT, "fastapi": _PYTHON, "python": _PYTHON, "rust": _RUST, "rust-monorepo": _RUST}.get(name or "", _CLEAN)


def load_rules(text: str | None) -> list[Rule]:
    """Rules of a YAML text; without one, or with no boundaries in it, those of
    its preset."""
    import yaml

    config = (yaml.safe_load(text) if text else None) or {}
    boundaries = config.get("boundaries") or []
    if not boundaries:
        return preset(config.get("preset") or "clean-architecture")
    return [(b["name"], b["from"], list(b["cannot_import"]), b.get("message", DEFAULT_MESSAGE)) for b in boundaries]


def glob_to_regex(glob: str) -> str | None:
    """A glob as a regular expression for whole strings; null if it is invalid.

    ``*`` and ``?`` also match a slash; ``**/`` any number of directories;
    ``**`` must be a whole component; ``[...]`` and ``[!...]`` are classes.
    """
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            if j - i > 2:
                return None
            if j - i == 2:
                if (i and glob[i - 1] != "/") or (j < n and glob[j] != "/"):
                    return None
                if j < n:
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
            i = j
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            negated = glob[i + 1 : i + 2] == "!"
            begin = i + 2 if negated else i + 1
            end = glob.find("]", begin + 1)
            if end < 0:
                return None
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\^\[&])', r'\\\1', glob[begin:end])}]")
            i = end + 1
        else:
            out.append(re.sub(r"([.^$+(){}|\\\]])", r"\\\1", c))
            i += 1
    return f"(?s)^{''.join(out)}$"


def _prefix(forbidden: str) -> str:
    while forbidden.endswith("/**"):
        forbidden = forbidden[:-3]
    return forbidden


def violation(source: Column, module: Column, rules: list[Rule]) -> Column:
    """(rule_name, message) of the first rule, by order of rules and of what
    they forbid, that the import breaks; null if none."""
    found = F.lit(None).cast("struct<rule_name:string,message:string>")
    for name, origin, forbidden, message in reversed(rules):
        at = glob_to_regex(origin)
        if at is None:
            continue
        hit = F.lit(False)
        for f in forbidden:
            to = glob_to_regex(f)
            if to is not None:
                hit = hit | module.rlike(to) | F.startswith(module, F.lit(_prefix(f)))
        found = F.when(source.rlike(at) & hit, F.struct(F.lit(name).alias("rule_name"), F.lit(message).alias("message"))).otherwise(found)
    return found


def check_imports(imports: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``imports`` (source_file, imported_module) that break a rule."""
    marked = imports.withColumn("_v", violation(F.col("source_file"), F.col("imported_module"), rules)).filter("_v is not null")
    return marked.select(*[c for c in imports.columns], "_v.rule_name", "_v.message")


@F.pandas_udf(T.StringType())
def _regex(globs: pd.Series) -> pd.Series:
    return globs.map(lambda g: None if g is None else glob_to_regex(g))


def _literal(glob: Column) -> Column:
    """What a string that fits the glob begins with."""
    return F.regexp_extract(glob, r"^[^*?\[]*", 0)


def _prefixes(text: Column, sizes: Column) -> Column:
    """The beginnings of a text that are as long as one of the sizes."""
    return F.transform(F.filter(sizes, lambda n: n <= F.char_length(text)), lambda n: F.substring(text, F.lit(1), n))


def _with_sizes(rows: DataFrame, starts: DataFrame, column: str) -> DataFrame:
    """``rows`` with the distinct lengths of a column of ``starts``: one small
    array (k lengths take k * k / 2 characters of rules), sent to all tasks."""
    sizes = starts.agg(F.sort_array(F.collect_set(F.char_length(column))).alias("_sizes"))
    return rows.join(F.broadcast(sizes.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")


def check_imports_by(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``check_imports``, with the rules as a table (of ``schemas.RULES``)
    of any size.

    No import meets all rules.  A glob only fits what begins as it does up to
    its first special character.  So source files meet the distinct globs by
    equal beginnings, and are then tried by expression; (glob, module) meets
    the rules with that glob by equal beginnings of what they forbid.  The
    first rule of each import counts, so of rules with one glob that forbid the
    same only the first goes on.  Distinct imports are judged once.

    Different rules of one glob and beginning are few beside the imports; the
    adaptive plan splits an import that very many files have.
    """
    some = rules.filter("from_glob is not null and forbid is not null")
    clean = some.groupBy("from_glob", "forbid").agg(F.min(F.struct("rule_ord", "name", "message")).alias("rule")).withColumns({"from_regex": _regex("from_glob"), "to_regex": _regex("forbid")})
    clean = clean.filter("from_regex is not null and to_regex is not null")
    globs = clean.select("from_glob", "from_regex").distinct().withColumn("begin", _literal(F.col("from_glob")))
    pairs = imports.select("source_file", "imported_module").filter("source_file is not null and imported_module is not null").distinct()

    files = _with_sizes(pairs.select("source_file").distinct(), globs, "begin")
    files = files.select("source_file", F.explode(_prefixes(F.col("source_file"), F.col("_sizes"))).alias("begin"))
    fits = files.join(globs, "begin").filter(F.expr("source_file rlike from_regex")).select("source_file", "from_glob")

    # By the plain beginning without /**, or by the expression.
    plain = clean.select("rule", "from_glob", F.regexp_replace("forbid", r"(/\*\*)+$", "").alias("to"), F.lit(None).cast("string").alias("to_regex"))
    special = clean.filter(F.col("forbid").rlike(r"[*?\[]")).select("rule", "from_glob", _literal(F.col("forbid")).alias("to"), "to_regex")
    forbidden = plain.unionByName(special)
    met = _with_sizes(pairs.join(fits, "source_file"), forbidden, "to")
    met = met.select("source_file", "imported_module", "from_glob", F.explode(_prefixes(F.col("imported_module"), F.col("_sizes"))).alias("to"))
    broken = met.join(forbidden, ["from_glob", "to"]).filter(F.expr("to_regex is null or imported_module rlike to_regex"))
    first = broken.groupBy("source_file", "imported_module").agg(F.min("rule").alias("_v"))
    return imports.join(first, ["source_file", "imported_module"]).select(*imports.columns, F.col("_v")["name"].alias("rule_name"), F.col("_v")["message"].alias("message"))


def supported(path: Column) -> Column:
    return extension(path).isin(SUPPORTED_EXTENSIONS)


IGNORED_DIRECTORIES = [".git", "node_modules", "target", ".codeloom", ".next", "dist"]


def outside_ignored(path: Column, directories: list[str] = IGNORED_DIRECTORIES) -> Column:
    return ~path.rlike(f"(^|/)({'|'.join(re.escape(d) for d in directories)})/")


def file_imports(files: DataFrame) -> DataFrame:
    """Imports of ``files`` (file_path, content), with their lines."""
    each = files.select("file_path", F.posexplode(lines(F.col("content"))).alias("at", "line"))
    each = each.filter(F.contains("line", F.lit("from ")) | F.contains("line", F.lit("import ")))
    found = each.select(F.col("file_path").alias("source_file"), (F.col("at") + 1).alias("line_no"), imported_module(trim(F.col("line"))).alias("imported_module"))
    return found.filter("imported_module is not null")


def scan(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations of a whole workspace."""
    return check_imports(file_imports(files.filter(supported(F.col("file_path")) & outside_ignored(F.col("file_path")))), rules)


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select(F.col("file_path").alias("_c")).distinct(), F.col("file_path") == F.col("_c"), "left_semi").filter(supported(F.col("file_path")))


def report(files: DataFrame, violations: DataFrame) -> DataFrame:
    """Files checked, violations, and files less violations (not below 0); and
    the files that really have none."""
    checked = files.agg(F.countDistinct("file_path").alias("total_files_checked"))
    found = violations.agg(F.count(F.lit(1)).alias("violations"), F.countDistinct("source_file").alias("_bad"))
    # Both sides are one row each.
    one = checked.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k")
    return one.select("total_files_checked", "violations", F.greatest(F.col("total_files_checked") - F.col("violations"), F.lit(0).cast("long")).alias("clean_files"), (F.col("total_files_checked") - F.col("_bad")).alias("files_without_violation"))


def annotations(violations: DataFrame) -> DataFrame:
    text = F.concat(F.lit("::error file="), "source_file", F.lit(",title=Architecture Violation::Rule '"), "rule_name", F.lit("' violated: Cannot import '"), "imported_module", F.lit("'. "), "message")
    return violations.select(*violations.columns, text.alias("annotation"))


def markdown_rows(violations: DataFrame) -> DataFrame:
    """The table rows of a report, a row for each violation."""
    row = F.concat(F.lit("| **"), "rule_name", F.lit("** | `"), "source_file", F.lit("` | `"), "imported_module", F.lit("` | "), "message", F.lit(" |"))
    return violations.select(*violations.columns, row.alias("row"))


def markdown(total_files: int, latency_ms: float, rows: list[str]) -> str:
    """A report around the rows of its table."""
    verdict = f"{len(rows)} import(s) cross a layer" if rows else "no import crosses a layer"
    head = f"## Import check: {verdict}\n\n{total_files} file(s) in {latency_ms:.2f} ms.\n"
    if not rows:
        return head
    return "\n".join([head, "| Rule | File | Import | Why not |", "|---|---|---|---|", *rows]) + "\n"


def inferred_preset(repo_files: DataFrame) -> DataFrame:
    """The preset of each repository by marker files at its root: web before
    Python before Rust, else clean architecture."""
    has = lambda *names: F.max(F.col("path").isin(*names).cast("int")) == 1
    name = F.when(has("next.config.js", "next.config.mjs", "next.config.ts"), "nextjs-app").when(has("pyproject.toml", "requirements.txt", "Pipfile"), "fastapi").when(has("Cargo.toml"), "rust").otherwise("clean-architecture")
    return repo_files.groupBy("repo").agg(name.alias("preset"))


def boundaries(rules: list[Rule]) -> list[tuple[int, str, str, int, str, str]]:
    """Rules as rows of ``schemas.RULES``: one for each thing a rule forbids."""
    return [(k, name, origin, j, to, message) for k, (name, origin, forbidden, message) in enumerate(rules) for j, to in enumerate(forbidden)]


def rules_file(name: str | None) -> str:
    """The YAML text of a preset, as a new workspace gets it."""
    import yaml

    listed = [{"name": n, "from": o, "cannot_import": f, "message": m} for n, o, f, m in preset(name)]
    return yaml.safe_dump({"version": "1", "preset": name or "clean-architecture", "boundaries": listed}, sort_keys=False, allow_unicode=True)


def rules_of(configs: DataFrame) -> DataFrame:
    """The rules of each repository (repo, then ``schemas.RULES``) from its YAML
    text (repo, text); null is no text."""
    schema = T.StructType([T.StructField("repo", T.StringType()), *T._parse_datatype_string(RULES).fields])

    def read(batches):
        for batch in batches:
            rows = [(repo, *row) for repo, text in zip(batch["repo"], batch["text"], strict=True) for row in boundaries(load_rules(text))]
            yield pd.DataFrame(rows, columns=schema.names)

    return configs.select("repo", "text").mapInPandas(read, schema)
