"""Symbolic slices with hoisted contracts.

A parser turns each file into rows: its definitions, contracts and the names
they use.  Python is parsed by its own ``ast``; TypeScript, Rust and Go by a
scanner for declarations and braces, in code from which comments and the text
of strings were blanked.  A slice finds the definition, takes the contracts whose
names it uses and cuts its lines, in the same pass.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import math
import re
import textwrap
import tokenize
import warnings
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BYTES_PER_TOKEN, compression_ratio, count_tokens, language_of, symbol_from_trace

NODES = "file_path string, language string, visit_ord int, kind string, name string, start_line int, end_line int, is_definition boolean, is_contract boolean, text string, identifiers array<string>, degraded boolean"

_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
# Declarations with a name and a kind, by language.
_DECLARED = {
    "TypeScript": [
        (r"^(\s*)export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|type|enum)\s+([A-Za-z0-9_$]+)", "export_statement"),
        (r"^(\s*)(?:export\s+(?:default\s+)?)?(?:async\s+)?function\*?\s+([A-Za-z0-9_$]+)", "function_declaration"),
        (r"^(\s*)(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([A-Za-z0-9_$]+)", "class_declaration"),
        (r"^(\s*)(?:export\s+)?interface\s+([A-Za-z0-9_$]+)", "interface_declaration"),
        (r"^(\s*)(?:export\s+)?type\s+([A-Za-z0-9_$]+)\s*[=<]", "type_alias_declaration"),
        (r"^(\s*)(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z0-9_$]+)", "enum_declaration"),
        (r"^(\s+)(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([A-Za-z0-9_$]+)\s*\([^;]*\)\s*(?::[^;={]+)?\{", "method_definition"),
    ],
    "Rust": [
        (r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z0-9_]+)", "function_item"),
        (r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z0-9_]+)", "struct_item"),
        (r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z0-9_]+)", "enum_item"),
        (r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z0-9_]+)", "trait_item"),
        (r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?type\s+([A-Za-z0-9_]+)", "type_item"),
    ],
    "Go": [
        (r"^()func\s+([A-Za-z0-9_]+)", "function_declaration"),
        (r"^()func\s+\([^)]*\)\s+([A-Za-z0-9_]+)", "method_declaration"),
        (r"^()type\s+([A-Za-z0-9_]+)", "type_spec"),
    ],
}
_DECLARED = {name: [(re.compile(p), kind) for p, kind in each] for name, each in _DECLARED.items()}
_DECLARED["JavaScript"] = _DECLARED["TypeScript"]
DEFINITIONS = {"function_declaration", "method_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "export_statement", "function_definition", "class_definition", "method_declaration", "type_declaration", "function_item", "struct_item", "enum_item", "trait_item", "impl_item"}
CONTRACTS = {"interface_declaration", "type_alias_declaration", "enum_declaration", "struct_item", "enum_item", "type_item", "trait_item", "type_declaration", "type_spec", "class_definition"}


# Comments and quoted text; a template's ${...} is code.
_BLANKED = {
    "TypeScript": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`", re.S),
    "Rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^\n']+|\\')'", re.S),
    "Go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n']+|\\')'", re.S),
}
_BLANKED["JavaScript"] = _BLANKED["TypeScript"]
_INNER = re.compile(r"\$\{([^{}]*)\}")


def blanked(source: str, language: str) -> str:
    """``source`` with spaces for comments and quoted text; lines and places
    stay as they are."""

    def blank(m: re.Match) -> str:
        out = re.sub(r"[^\n]", " ", m[0])
        if m[0][0] == "`":
            for inner in _INNER.finditer(m[0]):
                out = out[: inner.start(1)] + inner[1] + out[inner.end(1) :]
        return out

    return _BLANKED[language].sub(blank, source) if language in _BLANKED else source


def identifiers(code: str, language: str) -> list[str]:
    """Names used in blanked code.  What follows a dot is a field in Rust and
    Go, which is no name of its own; elsewhere a property is one."""
    if language in ("Rust", "Go"):
        code = re.sub(r"(?<![.\d])\.\s*[A-Za-z_][A-Za-z0-9_]*", " ", code)
    return sorted(set(_WORD.findall(code)))


class _Blocks:
    """Where the declarations of a file end: every brace is matched once."""

    def __init__(self, code: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]
        self.marks = [(m.start(), m[0]) for m in re.finditer(r"[{}();]", code)]
        self.places, self.code, self.close = [at for at, _ in self.marks], code, {}
        held = []
        for k, (_, c) in enumerate(self.marks):
            if c == "{":
                held.append(k)
            elif c == "}" and held:
                self.close[held.pop()] = k

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def end(self, at: int, limit: int) -> int:
        """Last line of a declaration at a place; ``limit``: where the next one
        starts, which it doesn't reach unless it holds it."""
        depth, k = 0, bisect.bisect_left(self.places, at)
        while k < len(self.marks):
            place, c = self.marks[k]
            if place >= limit:
                break
            if c == "{" and depth <= 0:
                if k not in self.close:  # unclosed: up to the next declaration
                    return max(self.line(at), self.line(min(limit, len(self.code))) - (limit <= len(self.code)))
                shut = self.close[k]
                after = self.marks[shut + 1] if shut + 1 < len(self.marks) else (0, "")
                # A type in braces before the body.
                if after[1] == "{" and not self.code[self.marks[shut][0] + 1 : after[0]].strip(" "):
                    k = shut + 1
                    continue
                return self.line(self.marks[shut][0])
            if c == "{":
                k = self.close.get(k, k)
            elif c in "()":
                depth += 1 if c == "(" else -1
            elif c == ";" and depth <= 0:
                return self.line(place)
            elif c == "}":
                break
            k += 1
        return self.line(at)


def _scan(source: str, language: str) -> tuple[list[tuple], bool]:
    clean = blanked(source, language)
    code, bare = source.split("\n"), clean.split("\n")
    if code[-1] == "":
        code.pop()
    blocks = _Blocks(clean)
    kinds = _DECLARED.get(language, [])
    found = [(k, kind, m[2]) for k, line in enumerate(bare) if line and not line.isspace() for pattern, kind in kinds if (m := pattern.match(line))]
    heads = sorted({k for k, *_ in found})
    out = []
    for k, kind, name in found:
        later = bisect.bisect_right(heads, k)
        limit = blocks.starts[heads[later]] if later < len(heads) else len(clean) + 1
        end = min(blocks.end(blocks.starts[k], limit), len(code) - 1)
        text = "\n".join(code[k : end + 1])
        out.append((kind, name, k + 1, end + 1, text, identifiers("\n".join(bare[k : end + 1]), language)))
    return out, clean.count("{") != clean.count("}")


def _python_names(text: str) -> list[str]:
    """Names of a piece of Python, without keywords, strings and comments."""
    names = set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(textwrap.dedent(text)).readline):
            if t.type == tokenize.NAME and not keyword.iskeyword(t.string):
                names.add(t.string)
    except (tokenize.TokenError, SyntaxError):
        names |= set(_WORD.findall(text))
    return sorted(names)


def _parse_python(source: str) -> tuple[list[tuple], bool]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], True
    code, out = source.split("\n"), []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            text = "\n".join(code[node.lineno - 1 : node.end_lineno])
            out.append((kind, node.name, node.lineno, node.end_lineno, text, _python_names(text)))
    return out, False


def parsed(source: str, language: str) -> list[tuple]:
    """Nodes in the order in which a search visits them: the last sibling
    first, a parent before its children, an export before what it exports."""
    found, degraded = _parse_python(source) if language == "Python" else _scan(source, language)
    order: list[tuple] = []
    todo: list = [sorted(found, key=lambda n: (n[2], -n[3], n[0] != "export_statement"))]
    while todo:
        now = todo.pop()
        if isinstance(now, tuple):
            order.append(now)
            continue
        tops: list[tuple[tuple, list[tuple]]] = []
        for n in now:
            if tops and tops[-1][0][2] <= n[2] and n[3] <= tops[-1][0][3]:
                tops[-1][1].append(n)
            else:
                tops.append((n, []))
        for top, inner in tops:  # the last one is taken first
            todo += [inner, top]
    return [(k, *n[:4], n[0] in DEFINITIONS, n[0] in CONTRACTS, n[4], n[5], degraded) for k, n in enumerate(order)]


def _nodes(batches):
    for files in batches:
        rows = [(f.file_path, f.language, *node) for f in files.itertuples(index=False) for node in parsed(f.content or "", f.language)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in NODES.split(", ")])


def syntax_nodes(files: DataFrame) -> DataFrame:
    """A row for each declaration of ``files`` (file_path, content)."""
    return files.select("file_path", language_of(F.col("file_path")).alias("language"), "content").mapInPandas(_nodes, NODES)


def strip_comments(code: str) -> str:
    """Without doc strings, comment lines and blank lines.  ``//`` lines that
    start with a flash mark and attributes stay.  A block that ends on its own
    line swallows nothing else."""
    kept, end = [], None
    for line in code.splitlines():
        t = line.strip()
        if end:
            if end in t:
                end = None
            continue
        opened = next((m for m in ("/*", '"""', "'''") if t.startswith(m)), None)
        if opened:
            close = "*/" if opened == "/*" else opened
            if close not in t[len(opened) :]:
                end = close
            continue
        if t.startswith("///") or (t.startswith("//") and not t.startswith("// ⚡")) or (t.startswith("#") and not t.startswith("#[")):
            continue
        if t:
            kept.append(line)
    return "\n".join(kept)


CUTS = "file_path string, target_symbol string, first_line int, lines array<string>, type_contracts array<string>, original_file_tokens bigint, syntax_degraded boolean"


def cut(content: str, language: str, symbol: str, nodes: list[tuple], multi_rubric: bool = False) -> tuple | None:
    """First line, lines, contracts and degraded for a symbol of a parsed file:
    its first definition in visiting order, or the lines around its first
    mention; none where there is none."""
    rows = re.split("\r?\n", content)
    if rows[-1] == "":
        rows.pop()
    found = next((n for n in nodes if n[5] and n[2] == symbol), None)
    if found is None:
        hit = next((k for k, r in enumerate(rows, 1) if symbol in r), 0)
        first = max(hit - 2, 1)
        return (first, rows[first - 1 : hit + 24], [], True) if hit else None
    start, end, used = found[3], found[4], set(found[8])
    contracts = [n[7] for n in nodes if n[6] and n[2] in used and not (n[3] >= start and n[4] <= end)]
    if multi_rubric:
        contracts = [c for c in map(strip_comments, contracts) if c.strip()]
    return start, rows[start - 1 : end], contracts, found[9]


def _cuts(batches, multi_rubric: bool):
    columns = [x.split()[0] for x in CUTS.split(", ")]
    for files in batches:
        out = []
        for f in files.itertuples(index=False):
            nodes = parsed(f.content, f.language)
            tokens = math.ceil(len(f.content.encode()) / BYTES_PER_TOKEN)
            for symbol in sorted(f.symbols):
                made = cut(f.content, f.language, symbol, nodes, multi_rubric)
                if made is not None:
                    out.append((f.file_path, symbol, *made[:3], tokens, made[3]))
        yield pd.DataFrame(out, columns=columns)


def slices(files: DataFrame, targets: DataFrame, multi_rubric: bool = False) -> DataFrame:
    """A slice for each target (file_path, symbol): its lines, and the
    contracts outside of it that it names, last in the file first.

    Where no definition has the name, the lines around its first mention; no
    row where there is none.  All targets are sliced in one job, and a file is
    parsed once for all of its targets.
    """
    wanted = targets.filter("symbol is not null").groupBy(F.col("file_path").alias("_file")).agg(F.collect_set("symbol").alias("symbols"))
    asked = files.join(wanted, F.col("file_path") == F.col("_file")).select("file_path", language_of(F.col("file_path")).alias("language"), F.coalesce("content", F.lit("")).alias("content"), "symbols")
    made = asked.mapInPandas(partial(_cuts, multi_rubric=multi_rubric), CUTS)
    made = made.withColumn("sparse_code_lines", F.expr("transform(lines, (l, i) -> struct(first_line + i as line_no, l as line))"))
    text = F.concat(F.expr("array_join(transform(type_contracts, c -> concat(c, '\n')), '')"), F.expr("array_join(transform(lines, x -> concat(x, '\n')), '')"))
    made = made.withColumn("estimated_tokens", count_tokens(text))
    return made.select("file_path", "target_symbol", "sparse_code_lines", "type_contracts", "estimated_tokens", "original_file_tokens", compression_ratio(F.col("original_file_tokens"), F.col("estimated_tokens")).alias("compression_ratio"), "syntax_degraded")


def slices_of_failures(files: DataFrame, failures: DataFrame, multi_rubric: bool = False) -> DataFrame:
    """A slice for the symbol that each failure's trace names (file_path,
    trace)."""
    return slices(files, failures.select("file_path", symbol_from_trace(F.col("trace")).alias("symbol")), multi_rubric)


def tier(name: str) -> bool:
    """Whether a tier's name asks for stripped contracts."""
    return "multi" in name or "lamr" in name
