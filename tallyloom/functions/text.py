"""Text functions: citations, full-text matching, redaction, Unicode forms, canonical JSON."""

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def cwes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)CWE-([0-9]+)"), F.lit(1)), lambda n: F.concat(F.lit("CWE-"), n)))


def package_of(specifier: Column) -> Column:
    """The package of a bare specifier: scope and name, or name."""
    return F.when(specifier.startswith("@"), F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(specifier, r"^([^/]+)", 1))


def search_tokens(text: Column) -> Column:
    """Lower-case words, distinct: what a simple text index holds."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def matches_query(tokens: Column, text: Column, query: str) -> Column:
    """A web-style query: words must all stand, "quoted phrases" in order, `or` between alternatives, -word must not."""
    import re

    parts = re.findall(r'-?"[^"]*"|\S+', query.lower())
    groups: list[list[Column]] = [[]]
    alternative = False
    for p in parts:
        if p == "or":
            alternative = True
            continue
        negative, bare = p.startswith("-"), p.lstrip("-").strip('"')
        c = F.concat(F.lit(" "), F.array_join(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), " "), F.lit(" ")).contains(f" {bare} ") if " " in bare else F.array_contains(tokens, bare)
        if negative:
            c = ~c
        if alternative:
            groups[-1].append(c)
            alternative = False
        else:
            groups.append([c])
    out = F.lit(True)
    for g in groups:
        if g:
            any_ = g[0]
            for c in g[1:]:
                any_ = any_ | c
            out = out & any_
    return out


def citation_tokens(text: Column) -> Column:
    """Words that look like code: four characters at least with an underscore, a dot inside, or a capital within."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike(r"_|\.|[a-z][A-Z]")))


def redacted(text: Column) -> Column:
    """Bearer tokens, keys and passwords masked."""
    out = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._-]+", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(AKIA|ASIA)[A-Z0-9]{16}", "[REDACTED]")
    return F.regexp_replace(out, r"(?i)(password\s*[=:]\s*)\S+", "$1[REDACTED]")


def sections(text: Column) -> Column:
    """Parts of a Markdown text, each from its `## ` heading on."""
    return F.filter(F.split(text, r"(?m)(?=^## )"), lambda s: F.trim(s) != "")


def nfkc_lower(text: Column) -> Column:
    """NFKC, lower case, one blank between words, no signs at the end. Spark has no built-in normal form, so this runs on Arrow batches."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()).rstrip(".,;:!?"))

    return run(text)


def canonical_json(text: Column) -> Column:
    """JSON with keys in code-point order and no blanks; whole doubles are printed as integers, as a script engine prints them."""
    import pandas as pd

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(v[k]) for k in sorted(v)}
        return [plain(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else json.dumps(plain(json.loads(t)), ensure_ascii=False, separators=(",", ":")))

    return run(text)


def without_comments(text: Column) -> Column:
    """JSON with comments as plain JSON: comments outside strings and commas before a closing bracket go. Strings are matched first, so they stay whole."""
    kept = F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(kept, r'("(?:\\.|[^"\\])*")|,\s*(?=[}\]])', "$1")


#: Expressions that bring in what a user or the environment controls.
SOURCE_EXPRESSIONS = (
    r"(?i:\b(req|request)\.(body|query|params|headers|cookies)\b)",
    r"(?i:\b(ctx|context)\.(request|query|params|headers|cookies)\b)",
    r"(?i:\bevent\.(body|queryStringParameters|pathParameters|headers)\b)",
    r"(?i:\b(input|stdin|argv|process\.argv)\b)",
    r"\$_(GET|POST|REQUEST|COOKIE|SERVER)\b",
    r"\b(request|self\.request)\.(form|args|json|values|files|data|GET|POST)\b",
    r"\bparams\[",
    r"@(RequestBody|RequestParam|PathVariable|RequestHeader)\b",
    r"\br\.(FormValue|PostFormValue|Form|URL\.Query)\b",
    r"\bmux\.Vars\b",
    r"\bprocess\.env\b",
    r"\bos\.environ\b",
)


def is_source_expression(text: Column) -> Column:
    """Whether a text has any of the source expressions; null for null."""
    return text.rlike("|".join(SOURCE_EXPRESSIONS))


#: Messages that tell of pressure, that may be tried again, and that must not be.
PRESSURE = r"(?i:\b(429|503|529|ENOMEM|EMFILE|ENFILE|EAGAIN)\b|rate.?limit|overload)"
TRANSIENT = r"(?i:ECONNRESET|ETIMEDOUT|ECONNREFUSED|EHOSTUNREACH|socket|network|stream.*(disconnect|fail)|went to sleep mid-response)"
FORBIDDEN = r"(?i:permission|policy refusal|not authorized|invalid.api.key)|\b(401|403)\b"
#: Fixed value: the form of a record's time.
RECORD_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(2[0-3]|[01][0-9]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def pressure(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(429, 503, 529), F.lit(False)) | F.coalesce(message.rlike(PRESSURE), F.lit(False))


def retryable(status: Column, message: Column) -> Column:
    """Pressure and broken connections may be tried again, refusals never."""
    text = F.coalesce(message, F.lit(""))
    return ~text.rlike(FORBIDDEN) & (pressure(status, message) | text.rlike(TRANSIENT))


def retry_delay(retry_after: Column, now: Column) -> Column:
    """Milliseconds from a header of seconds or of a date (never below 0); null without one, or if it is neither."""
    seconds = F.when(retry_after.rlike(r"^[0-9]+(\.[0-9]+)?$"), retry_after.cast("double") * 1000)
    until = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(retry_after, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(seconds, F.when(until.isNotNull(), F.greatest(F.lit(0.0), (F.unix_millis(until) - F.unix_millis(now)).cast("double"))))


def record_time(text: Column) -> Column:
    """The time with its offset, Z where it has none; null if its form or its day is wrong, or its offset beyond a day."""
    day = F.substring(text, 1, 10)
    real = F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "yyyy-MM-dd") == day
    offset = F.regexp_extract(text, r"([+-])([0-9]{2}):([0-9]{2})$", 2)
    minutes = F.regexp_extract(text, r"([+-])([0-9]{2}):([0-9]{2})$", 3)
    in_range = (offset == "") | ((offset <= "23") & (minutes <= "59"))
    return F.when(text.rlike(RECORD_TIME) & F.coalesce(real, F.lit(False)) & in_range, F.when(text.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z"))))
