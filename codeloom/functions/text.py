"""Text functions: tokens, imports, names, sanitizing, hashing.

All are column expressions.  ``trim`` below strips Unicode-blind white space
(Java ``\\s``), as names and paths hold no other.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BYTES_PER_TOKEN = 3.8
USD_PER_MILLION = 3.0
CONTROL_TOKENS = ["<|im_start|>", "<|im_end|>", "SYSTEM:", "SYSTEM PROMPT:", "[INST]", "[/INST]"]
OVERRIDE_PHRASES = ["ignore previous instructions", "ignore all previous instructions", "ignore above instructions", "disregard all previous instructions", "system override:"]
BLOCKED_TOKEN, BLOCKED_PHRASE = "[BLOCKED_INJECTION_TOKEN]", "[BLOCKED_PROMPT_OVERRIDE]"
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust"}
SUPPORTED_EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "rs", "go"]
RESTRICTED_PARTS = [".env", "id_rsa", ".ssh", ".git/hooks", "credentials", "secret", ".."]
WARNING_ENDINGS = ["cargo.toml", "package.json", "tsconfig.json", ".lock"]
NAME_PREFIXES = ["export function ", "export async function ", "function ", "def ", "pub fn ", "fn "]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; an empty last one is no line."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_tokens(text: Column) -> Column:
    """UTF-8 bytes over 3.8, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(BYTES_PER_TOKEN)).cast("long")


def count_tokens_by_words(text: Column) -> Column:
    """Pieces between white space runs and punctuation, and those themselves:
    up to four characters are one token, else a token for each 3.7; at least
    one, and none for blank text."""
    # Fixed value: the pattern of the pieces.
    pieces = F.regexp_extract_all(text, F.lit(r"(\s+|[{}()\[\],.;:+\-*/=<>!&|^~\"'`]|[^\s{}()\[\],.;:+\-*/=<>!&|^~\"'`]+)"), F.lit(1))
    each = F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.when(F.char_length(p) <= 4, F.lit(1).cast("long")).otherwise(F.ceil(F.char_length(p) / F.lit(3.7)).cast("long")))
    return F.when(text.isNull() | (trim(text) == ""), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), each))


def compression_ratio(original: Column, sliced: Column) -> Column:
    """1 - sliced / original as a float, 0 if nothing is saved."""
    ratio = F.lit(1.0).cast("float") - (sliced.cast("float") / original.cast("float")).cast("float")
    return F.when((original == 0) | (sliced >= original), F.lit(0.0).cast("float")).otherwise(ratio).cast("float")


def round_half_away(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.round(x * F.lit(scale)) / F.lit(scale)


def usd(tokens: Column) -> Column:
    return round_half_away(tokens / F.lit(1e6) * F.lit(USD_PER_MILLION), 2)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def language_of(path: Column) -> Column:
    ext = F.lower(extension(path))
    return reduce(lambda c, kv: c.when(ext == kv[0], kv[1]), LANGUAGES.items(), F.when(ext.isNull(), "Unknown")).otherwise("Unknown")


def imported_module(line: Column) -> Column:
    """The module a trimmed line imports: the first quoted text after ``from``,
    else the word after a leading ``from`` or ``import``; else null.

    Nothing after the first ``from`` ends the search without a module.
    """
    at = F.instr(line, "from ")
    rest = trim(line.substr(at + 5, F.char_length(line)))
    mark = F.substring(rest, 1, 1)
    inner = rest.substr(F.lit(2), F.char_length(rest))
    close = F.when(mark == "'", F.instr(inner, "'")).otherwise(F.instr(inner, '"'))
    quoted = F.when((at > 0) & mark.isin("'", '"') & (close > 0), inner.substr(F.lit(1), close - 1))
    word = lambda n: F.regexp_extract(line, rf"^{n} \s*(\S+)", 1)
    by_from = F.when(F.startswith(line, F.lit("from ")) & (word("from") != ""), word("from"))
    by_import = F.when(F.startswith(line, F.lit("import ")) & (word("import") != ""), F.regexp_replace(word("import"), "^['\";]+|['\";]+$", ""))
    return F.when((at > 0) & (rest == ""), F.lit(None).cast("string")).otherwise(F.coalesce(quoted, by_from, by_import))


def function_name(line: Column) -> Column:
    """The name a line declares by one of the prefixes; null if none or empty."""
    t = trim(line)
    name = F.lit(None).cast("string")
    for p in reversed(NAME_PREFIXES):
        name = F.when(F.startswith(t, F.lit(p)), trim(F.substring_index(t.substr(F.lit(len(p) + 1), F.char_length(t)), "(", 1))).otherwise(name)
    return F.nullif(name, F.lit(""))


def sanitized(text: Column, tokens: list[str] | None = None, enabled: bool = True, any_case: bool = False) -> Column:
    """Control tokens and override phrases replaced in list order.  Phrases
    count in their lower-case form only unless ``any_case``."""
    if not enabled:
        return text
    for token in CONTROL_TOKENS if tokens is None else tokens:
        text = F.replace(text, F.lit(token), F.lit(BLOCKED_TOKEN))
    for phrase in OVERRIDE_PHRASES:
        text = F.regexp_replace(text, f"(?i){phrase}", BLOCKED_PHRASE) if any_case else F.replace(text, F.lit(phrase), F.lit(BLOCKED_PHRASE))
    return text


def mutation_risk(path: Column) -> Column:
    p = F.lower(path)
    restricted = reduce(lambda a, b: a | b, [F.contains(p, F.lit(x)) for x in RESTRICTED_PARTS])
    warning = reduce(lambda a, b: a | b, [F.endswith(p, F.lit(x)) for x in WARNING_ENDINGS]) | F.contains(p, F.lit("migration"))
    return F.when(restricted, "Restricted").when(warning, "Warning").otherwise("Safe")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def idempotency_key(repository: Column, branch: Column, sha: Column) -> Column:
    return F.sha2(F.concat_ws(":", repository, branch, sha), 256)


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """What HMAC-SHA-256 puts before a message and before its hash; the key is
    the SHA-256 of the secret."""
    key = hashlib.sha256(secret.encode()).digest().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def signature(payload: Column, secret: str) -> Column:
    """HMAC-SHA-256 of a payload, in hex."""
    inner, outer = hmac_pads(secret)
    once = F.sha2(F.concat(F.lit(inner), F.encode(payload, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(once)), 256)


def signature_matches(header: Column, payload: Column, secret: str) -> Column:
    """Equal to the header, or what the header ends with."""
    s = signature(payload, secret)
    return (trim(header) == s) | F.endswith(trim(header), s)


def symbol_from_trace(trace: Column) -> Column:
    """The failing symbol: of the first line with ``::`` what follows the last
    of them, or of one with ``at `` the word after it; else ``test_target``."""
    def of(line: Column) -> Column:
        by_path = trim(F.regexp_extract(F.substring_index(line, "::", -1), r"^[^\s'\"(:]*", 0))
        by_at = trim(F.regexp_extract(F.element_at(F.split(line, "at ", -1), 2), r"^[^\s(:]*", 0))
        return F.when(F.contains(line, F.lit("::")), by_path).otherwise(by_at)

    hit = F.filter(lines(trace), lambda x: F.contains(x, F.lit("::")) | F.contains(x, F.lit("at ")))
    found = F.when(F.size(hit) > 0, of(F.element_at(hit, 1)))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("test_target"))


def org_slug(name: Column) -> Column:
    return F.concat(F.lit("org_"), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def github_parts(url: Column) -> Column:
    """owner, repo, branch (main if not named) and file of a repository url;
    null if it is none."""
    clean = F.regexp_replace(F.regexp_replace(trim(url), "^https?://", ""), "/$", "")
    pattern = r"github\.com/([^/]+)/([^/]+)(?:/blob/([^/]+)/(.+))?"
    part = lambda k: F.regexp_extract(clean, pattern, k)
    return F.when(
        clean.rlike(pattern),
        F.struct(part(1).alias("owner"), F.regexp_replace(part(2), r"\.git$", "").alias("repo"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("main")).alias("branch"), F.nullif(part(4), F.lit("")).alias("file_path")),
    )


def argument(arguments: Column, name: str, default: str | None = "") -> Column:
    """A text argument of a tool (variant); the default if it is no text."""
    value = F.try_variant_get(arguments, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string")).otherwise(F.lit(default))


def argument_list(arguments: Column, name: str) -> Column:
    """The text items of an argument that is an array; none if it isn't one."""
    items = F.try_variant_get(arguments, f"$.{name}", "array<variant>")
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def is_fresh(checked_at: Column, now_s: Column, hours: int = 12) -> Column:
    """Whether a cached answer of an update check still holds; none never does."""
    return F.coalesce((now_s >= checked_at) & (now_s - checked_at < hours * 3600), F.lit(False))


def gutter(at: Column, line: Column, width: int = 4) -> Column:
    """A line behind its right-aligned number, as an editor shows it; signs of
    markup are written out."""
    safe = F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lpad(at.cast("string"), width, " "), F.lit(" | "), safe)


def progress_bar(ratio: Column, width: int = 24) -> Column:
    n = F.round(ratio * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.greatest(F.lit(width) - n, F.lit(0))))
