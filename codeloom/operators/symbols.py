"""Symbols and slices by lines, in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compression_ratio, content_hash, count_tokens, function_name, language_of, lines, trim

# The patterns that declare a symbol, in order, by language.
PATTERNS = {
    "TypeScript": [
        r"export\s+(?:async\s+)?function\s+([a-zA-Z0-9_$]+)",
        r"(?:async\s+)?function\s+([a-zA-Z0-9_$]+)",
        r"(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s*)?\(",
        r"export\s+(?:interface|type|class)\s+([a-zA-Z0-9_$]+)",
        r"(?:interface|type|class)\s+([a-zA-Z0-9_$]+)",
        r"([a-zA-Z0-9_$]+)\s*\([^)]*\)\s*:\s*[a-zA-Z0-9_$<>\[\]\s|]+\s*\{",
    ],
    "Python": [r"def\s+([a-zA-Z0-9_]+)\s*\(", r"class\s+([a-zA-Z0-9_]+)\s*[:(]", r"async\s+def\s+([a-zA-Z0-9_]+)\s*\("],
    "Rust": [r"pub\s+fn\s+([a-zA-Z0-9_]+)\s*[<(]", r"fn\s+([a-zA-Z0-9_]+)\s*[<(]", r"pub\s+(?:struct|enum|trait)\s+([a-zA-Z0-9_]+)", r"(?:struct|enum|trait)\s+([a-zA-Z0-9_]+)"],
    "Go": [r"func\s+(?:\([^)]+\)\s+)?([a-zA-Z0-9_]+)\s*\(", r"type\s+([a-zA-Z0-9_]+)\s+struct"],
}
NOT_NAMES = ["if", "for", "while", "switch", "catch", "constructor"]


#: Text without which a line declares nothing, by language.
MARKS = {"TypeScript": ["function", "const", "let", "var", "interface", "type", "class", "("], "Python": ["def", "class"], "Rust": ["fn", "struct", "enum", "trait"], "Go": ["func", "type"]}


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in parts])


def _by_language(language: Column, of) -> Column:
    out = of("TypeScript")
    for name in ("Python", "Rust", "Go"):
        out = F.when(language == name, of(name)).otherwise(out)
    return out


def declared(line: Column, language: Column) -> Column:
    """The name a trimmed line declares: of the first pattern that fits with a
    name that is none of the control words.  Each pattern is tried once."""
    def of(name: str) -> Column:
        found = F.array(*[F.regexp_extract(line, p, 1) for p in PATTERNS[name]])
        return F.get(F.filter(found, lambda x: (x != "") & ~x.isin(NOT_NAMES)), F.lit(0))

    return _by_language(language, of)


def line_symbols(files: DataFrame) -> DataFrame:
    """(file_path, name, line_no, signature): the first line for each name.
    Most lines are passed over by a search for plain text."""
    each = files.select("file_path", language_of(F.col("file_path")).alias("language"), F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    each = each.filter(_by_language(F.col("language"), lambda name: _any(F.col("line"), MARKS[name])))
    each = each.select("file_path", "language", "at", trim(F.col("line")).alias("signature"))
    found = each.select("file_path", declared(F.col("signature"), F.col("language")).alias("name"), (F.col("at") + 1).alias("line_no"), "signature").filter("name is not null")
    best = found.groupBy("file_path", "name").agg(F.min(F.struct("line_no", "signature")).alias("r"))
    return best.select("file_path", "name", "r.line_no", "r.signature")


def function_nodes(files: DataFrame, repository: str) -> DataFrame:
    """Graph nodes of the functions that lines declare."""
    each = files.select("file_path", F.posexplode(lines(F.col("content"))).alias("at", "line"))
    each = each.filter(_any(F.col("line"), ["function ", "def ", "fn "]))
    named = each.withColumn("name", function_name(F.col("line"))).filter("name is not null")
    line_no = F.col("at") + 1
    return named.select(F.concat(F.lit(f"repo://{repository}/"), "file_path", F.lit("#"), "name").alias("id"), F.col("name").alias("symbol_name"), F.lit("Function").alias("kind"), language_of(F.col("file_path")).alias("language"), "file_path", line_no.alias("start_line"), line_no.alias("end_line"), F.octet_length("line").alias("end_col"))


def lexical_slices(files: DataFrame, symbol: Column) -> DataFrame:
    """For each file with a line that holds the symbol: the lines from two
    before the first such line to 24 after it."""
    all_lines = lines(F.col("content"))
    with_lines = files.withColumn("_symbol", symbol).withColumn("_lines", all_lines)
    hit = F.expr("array_position(transform(_lines, l -> contains(l, _symbol)), true)").cast("int")
    kept = with_lines.withColumn("_hit", hit).filter("_hit > 0")
    start = F.greatest(F.col("_hit") - 2, F.lit(1))
    taken = F.slice("_lines", start, F.col("_hit") + 25 - start)
    text = F.concat(F.array_join(taken, "\n"), F.lit("\n"))
    tokens, original = count_tokens(text), count_tokens(F.col("content"))
    return kept.select("file_path", F.col("_symbol").alias("target_symbol"), start.alias("first_line"), taken.alias("lines"), tokens.alias("estimated_tokens"), original.alias("original_file_tokens"), compression_ratio(original, tokens).alias("compression_ratio"), F.lit(True).alias("syntax_degraded"))


def hashed(files: DataFrame) -> DataFrame:
    return files.select("file_path", content_hash(F.col("content")).alias("hash"))


# What a declaration that others depend on starts with, the lines
# of a block that doesn't close, and those shown without the symbol.
CONTRACT_HEADS = ["export interface ", "interface ", "export type ", "type ", "@dataclass", "pub struct ", "struct ", "pub enum ", "enum "]
OPEN_BLOCK_LINES, MIDDLE_LINES, MOST_CONTRACTS = 35, 25, 3


def _count(line: Column, text: str) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(text), F.lit("")))


def block_slices(files: DataFrame, symbol: Column) -> DataFrame:
    """For each of ``files`` (file_path, content) the block at the first line
    that holds its symbol, and what is declared outside of it.

    The block ends with the first later line at which the depth of braces is
    back at 0 (in Python files a colon opens one, too).  Without such a line it
    has 35 lines; without a line that holds the symbol the 25 lines after the
    first third of the file are shown.  (first_line, last_line, lines, pruned:
    the number of other lines, hoisted: the number of contracts, contracts: the
    first three.)  A contract begins outside the block and ends where its own
    depth is back at 0, in Python files with the last line that is indented.
    All of it is expressions over the file's lines; nothing is shuffled.
    """
    python = F.col("_python")
    opens = lambda line: _count(line, "{") + F.when(python, _count(line, ":")).otherwise(0)
    braces = lambda line: _count(line, "{") - _count(line, "}")
    texts = files.withColumns({"_symbol": symbol, "_lines": F.split("content", "\n", -1), "_python": language_of(F.col("file_path")) == "Python"}).withColumn("_python", F.coalesce("_python", F.lit(False)))
    n = F.size("_lines")
    hit = F.when(F.col("_symbol") != "", F.array_position(F.transform("_lines", lambda line: F.contains(line, F.col("_symbol"))), True).cast("int"))
    texts = texts.withColumns({"_n": n, "_hit": F.coalesce(hit, F.lit(0))})

    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("size"))

    def step(s: Column, line: Column) -> Column:
        seen, depth, opened = s["seen"] + 1, s["depth"] + opens(line) - _count(line, "}"), s["opened"] | (opens(line) > 0)
        size = F.when(s["size"] > 0, s["size"]).when(opened & (depth <= 0) & (seen > 1), seen).otherwise(0)
        return F.struct(seen.alias("seen"), depth.alias("depth"), opened.alias("opened"), size.alias("size"))

    closed = F.aggregate(F.slice("_lines", F.greatest("_hit", F.lit(1)), F.col("_n")), start, step, lambda s: s["size"])
    texts = texts.withColumn("_size", closed)
    third = F.floor(F.col("_n") / 3).cast("int")
    first = F.when(F.col("_hit") > 0, F.col("_hit")).otherwise(third + 1)
    last = F.when(F.col("_hit") == 0, F.least("_n", third + MIDDLE_LINES)).when(F.col("_size") > 0, F.col("_hit") + F.col("_size") - 1).otherwise(F.least("_n", F.col("_hit") - 1 + OPEN_BLOCK_LINES))
    texts = texts.withColumns({"first_line": first, "last_line": last})

    is_head = lambda line: _any_start(trim(line), CONTRACT_HEADS)
    heads = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda k: ((k < F.col("first_line")) | (k > F.col("last_line"))) & is_head(F.get("_lines", k - 1)))
    texts = texts.withColumn("_heads", heads)

    def contract(k: Column) -> Column:
        begin = F.struct(F.lit(0).alias("size"), F.lit(0).alias("depth"), F.lit(True).alias("inside"))

        def more(s: Column, line: Column) -> Column:
            on = s["inside"] & ((s["size"] == 0) | (s["depth"] > 0) | (python & F.startswith(line, F.lit("    "))))
            return F.struct((s["size"] + on.cast("int")).alias("size"), (s["depth"] + F.when(on, braces(line)).otherwise(0)).alias("depth"), on.alias("inside"))

        size = F.aggregate(F.slice("_lines", k, F.col("_n")), begin, more, lambda s: s["size"])
        return F.array_join(F.slice("_lines", k, size), "\n")

    shown = F.col("last_line") - F.col("first_line") + 1
    return texts.select("file_path", F.col("_symbol").alias("target_symbol"), "first_line", "last_line", F.slice("_lines", F.col("first_line"), shown).alias("lines"), F.greatest(F.col("_n") - shown, F.lit(0)).alias("pruned"), F.size("_heads").alias("hoisted"), F.transform(F.slice("_heads", 1, MOST_CONTRACTS), contract).alias("contracts"))


def _any_start(line: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for x in starts:
        out = out | F.startswith(line, F.lit(x))
    return out
