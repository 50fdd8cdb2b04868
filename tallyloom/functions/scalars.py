"""Scalar functions over columns: tokens, severities, paths, hashes, numbers. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "STRUCTURAL_WEAKNESS")
WEIGHTS = {"CRITICAL": 25, "HIGH": 10, "MEDIUM": 3, "LOW": 1}


def truthy(c: Column) -> Column:
    """The string itself, or null where it is empty: what a chain of alternatives skips."""
    return F.when(c != "", c)


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*(truthy(c) for c in cols))


def has_content(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def token(c: Column) -> Column:
    """Trimmed, upper case, runs of blanks and hyphens as one underscore."""
    return F.upper(F.regexp_replace(F.trim(c), r"[\s-]+", "_"))


def status_token(c: Column, missing: str) -> Column:
    return F.coalesce(truthy(token(c)), F.lit(missing))


def severity(c: Column) -> Column:
    t = token(c)
    return F.when(t == "STRUCTURAL", "STRUCTURAL_WEAKNESS").when(t.isin(*SEVERITIES), t).otherwise("INFO")


def analyzer_severity(c: Column) -> Column:
    u = F.upper(c)
    return F.when(c.isNull(), "INFO").when(u == "ERROR", "HIGH").when(u == "WARNING", "MEDIUM").when(u == "INFO", "LOW").otherwise(u)


def weight(sev: Column) -> Column:
    out = F.lit(0)
    for name, w in WEIGHTS.items():
        out = F.when(sev == name, w).otherwise(out)
    return out


def scored(status: Column, sev: Column, included: Column) -> Column:
    """Counts for the score: confirmed or downgraded, not a structural weakness, not switched off (an unknown flag counts)."""
    return F.coalesce(status.isin("CONFIRMED", "DOWNGRADED") & (sev != "STRUCTURAL_WEAKNESS") & F.coalesce(included, F.lit(True)), F.lit(False))


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^(\\./)+", ""), "/+$", "")


def safe_relative(c: Column) -> Column:
    """No empty, `.` or `..` segment, no backslash or NUL, not absolute."""
    return (c != "") & ~c.contains("\\") & ~c.contains("\0") & F.forall(F.split(c, "/"), lambda s: ~s.isin("", ".", ".."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".py": "python", ".go": "go", ".rs": "rust"}


def language(path: Column) -> Column:
    out = F.lit("unsupported")
    for e, name in LANGUAGES.items():
        out = F.when(extension(path) == e, name).otherwise(out)
    return out


def estimated_tokens(size: Column, per: int = 4) -> Column:
    return F.ceil(size / per).cast("long")


def display_id(digest: Column, prefix: str = "F-") -> Column:
    """Fifteen hex digits as a number, its last twelve decimal digits."""
    return F.concat(F.lit(prefix), F.lpad((F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % 1_000_000_000_000).cast("string"), 12, "0"))


def record_name(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def line_count(text: Column) -> Column:
    """Lines ended by CRLF, CR or LF; an empty file has none, a last line needs no end."""
    ends = F.size(F.split(text, "\r\n|\r|\n")) - 1
    return F.when(text == "", 0).otherwise(ends + F.when(text.rlike("[\r\n]$"), 0).otherwise(1)).cast("long")


def version_at_least(version: Column, least: tuple[int, int, int]) -> Column:
    parts = F.transform(F.split(F.regexp_extract(version, r"^(\d+\.\d+\.\d+)", 1), "\\."), lambda p: p.cast("int"))
    return parts >= F.array(*map(F.lit, least))


def backoff(base_ms: int, attempt: Column) -> Column:
    return (F.lit(base_ms) * F.pow(F.lit(2), attempt - 1)).cast("long")


def ratio(a: Column, b: Column, empty=None) -> Column:
    """a / b; `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def valid_json(text: Column) -> Column:
    """Whether all of the text is one JSON value; false for null.

    Spark's parsers stop behind the first value, so the text is read as the first of a list's two elements: whatever follows its value breaks the list or takes the
    second place, in which the text's own digest has to stand.
    """
    digest = F.sha2(text, 256)
    read = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')), "array<string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    return F.coalesce((F.size(read) == 2) & (F.get(read, F.lit(1)) == digest), F.lit(False))
