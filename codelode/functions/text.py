"""Scalar functions over paths, code, findings and events, as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c", "swift": "swift", "kt": "kotlin", "sql": "sql", "sh": "shell", "json": "json", "yml": "yaml", "yaml": "yaml", "xml": "xml", "toml": "toml", "tf": "hcl",
}
# Words that say nothing about a claim.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "can", "could", "this", "that", "these", "those", "on", "in", "at", "to", "for", "with", "from", "by", "of", "and",
    "or", "not", "but", "if", "then", "else", "when", "up", "out", "no", "so", "it", "its", "line", "code", "file", "found", "detected", "potential",
    "possible", "vulnerability", "issue", "problem",
)
# Stages of the pipeline, in order.
STAGES = ("ingest", "triage", "graphrag", "council", "security", "performance", "architecture", "critique", "synthesis")
#: Where scans keep a job's files; the rest of a path is relative to the repository.
JOB_ROOT = r"^.*?[/\\](?:scans[/\\]([0-9a-f]+)|review[/\\]job-([0-9a-f]+)[/\\]work)[/\\]"


def chunk_id(path: Column, line: Column, code: Column) -> Column:
    """SCL1: the first 16 hex digits of the SHA-256 of path:line:code; null if any part is."""
    return F.substring(F.sha2(F.concat(path, F.lit(":"), line.cast("string"), F.lit(":"), code), 256), 1, 16)


def content_hash(path: Column, code: Column) -> Column:
    """SCL2: the SHA-256 of path::code."""
    return F.sha2(F.concat(path, F.lit("::"), code), 256)


def strip_quotes(text: Column) -> Column:
    """SCL7: without one pair of equal quotes around it."""
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    quoted = first.isin('"', "'", "`") & (first == last) & (F.length(text) >= 2)
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def truncated(text: Column, n: int) -> Column:
    """SCL8: at most n characters and an ellipsis where something is cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def is_local_ip(ip: Column) -> Column:
    """SCL9: loopback, unspecified and the two private ranges that count as local."""
    return ip.isin("127.0.0.1", "0.0.0.0") | ip.startswith("192.168.") | ip.startswith("10.")


def entropy(text: Column) -> Column:
    """SCL10: Shannon entropy in bits a character; 0 for an empty text."""
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))

    def add(total: Column, char: Column) -> Column:
        share = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - share * F.log2(share)

    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), add)).when(n == 0, F.lit(0.0))


def normal_path(path: Column) -> Column:
    """SCL15: forward slashes, no leading ./ or /, parent references resolved, lower case."""
    p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), "^/", "")
    parts = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda seen, x: F.when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).when(x == ".", seen).otherwise(F.concat(seen, F.array(x))),
    )
    return F.lower(F.array_join(parts, "/"))


def relative_path(path: Column) -> Column:
    """The path inside its repository, with forward slashes."""
    return F.replace(F.regexp_replace(path, JOB_ROOT, ""), F.lit("\\"), F.lit("/"))


def job_of(path: Column) -> Column:
    """The job whose scan a path belongs to; null if it has none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(path, JOB_ROOT, k), F.lit("")) for k in (1, 2)))


def signature_key(path: Column, rule: Column) -> Column:
    """SCL16: normal path::rule, rules compared without case and with - for _ and spaces (T26)."""
    return F.concat(normal_path(path), F.lit("::"), F.regexp_replace(F.lower(rule), "[_ ]", "-"))


def finding_signature(path: Column, category: Column, line: Column) -> Column:
    """SCL18: path::category::line."""
    return F.concat_ws("::", path, category, line.cast("string"))


def round_half_up(x: Column, digits: int) -> Column:
    """SCL17: rounds halves up, as floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(x * 10**digits + 0.5) / 10.0**digits


def language(path: Column) -> Column:
    """SCL19: by extension; other extensions are typescript."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(table, extension), F.lit("typescript")))


def normal_severity(text: Column) -> Column:
    """SRC7: CRITICAL, HIGH and LOW in any case stay; all else, null too, is MEDIUM."""
    upper = F.upper(text)
    return F.when(upper.isin("CRITICAL", "HIGH", "LOW"), upper).otherwise("MEDIUM")


def normal_verdict(text: Column) -> Column:
    """SCL27: CONFIRMED or DISPUTED in any case and spacing, else PLAUSIBLE."""
    upper = F.upper(F.trim(text))
    return F.when(upper.isin("CONFIRMED", "DISPUTED"), upper).otherwise("PLAUSIBLE")


def keywords(claim: Column) -> Column:
    """SCL23: the claim's words of three characters or more that are no stop words, in order, with repeats."""
    words = F.transform(F.split(F.lower(claim), r"[ \t\r\n]+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def folded(text: Column) -> Column:
    """White space folded to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def code_lines(code: Column) -> Column:
    return F.split(code, "\n", -1)


def first_match(code: Column, pattern: str) -> Column:
    """SCL20: the 0-based first line that matches; null if none does."""
    lines = code_lines(code)
    hits = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.get(lines, k).rlike(pattern))
    return F.get(hits, F.lit(0))


def around_match(code: Column, pattern: str, k: int) -> Column:
    """SCL21: k lines before and after the first matching line; the first 2k + 1 lines if none matches."""
    at, lines = F.coalesce(first_match(code, pattern), F.lit(k)), code_lines(code)
    begin = F.greatest(at - k, F.lit(0))
    return F.array_join(F.slice(lines, begin + 1, at + k - begin + 1), "\n")


def window(code: Column, chunk_start: Column, start: Column, end: Column, buffer: int = 5) -> tuple[Column, Column, Column]:
    """SCL22: the cited lines with some around them, clamped to the chunk: (text, first line, last line)."""
    lines = code_lines(code)
    last = F.size(lines) - 1
    a = F.greatest(F.greatest(start - chunk_start, F.lit(0)) - buffer, F.lit(0))
    b = F.least(F.least(end - chunk_start, last) + buffer, last)
    text = F.array_join(F.slice(lines, F.least(a, last) + 1, F.greatest(b - a + 1, F.lit(0))), "\n")
    return text, chunk_start + a, chunk_start + b


def embedding_text(path: Column, start: Column, end: Column, complexity: Column, volume: Column, smells: Column, code: Column) -> Column:
    """SCL11: header lines, an empty line and the code; what is null is left empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kinds = F.array_join(F.coalesce(F.transform(smells, lambda s: s["type"]), F.array().cast("array<string>")), ", ")
    return F.concat(
        F.lit("File: "), text(path), F.lit("\nLines "), text(start), F.lit("-"), text(end), F.lit("\nComplexity: "), text(complexity), F.lit(", Halstead: "), text(volume),
        F.when(kinds == "", F.lit("\nNo code smells.\n\n")).otherwise(F.concat(F.lit("\nCode smells: "), kinds, F.lit(".\n\n"))), text(code),
    )


def fenced_code(answer: Column) -> Column:
    """SCL25: code in a fixed_code element, else in a fenced block, else the text itself unless it is []."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tag = bare(F.regexp_extract(answer, r"(?s)<fixed_code>(.*?)</fixed_code>", 1))
    fence = bare(F.regexp_extract(answer, r"(?s)```[A-Za-z]*\n(.*?)```", 1))
    raw = bare(answer)
    return F.coalesce(F.nullif(tag, F.lit("")), F.nullif(fence, F.lit("")), F.when(~raw.isin("", "[]"), raw))


def percent(x: Column) -> Column:
    """SCL32: one decimal and a percent sign."""
    return F.format_string("%.1f%%", x * 100)


def node_name(event: Column) -> Column:
    """SCL33: phase:x:start is X, agent:x:start is X Agent; null without a second part."""
    parts = F.split(event, ":")
    name = F.nullif(F.get(parts, F.lit(1)), F.lit(""))
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return F.when(F.get(parts, F.lit(0)) == "agent", F.concat(capital, F.lit(" Agent"))).otherwise(capital)


def active_node(event: Column) -> Column:
    """SCL34: the first stage whose name is in the event."""
    found = F.lit(None).cast("string")
    for stage in reversed(STAGES):
        found = F.when(event.contains(stage), F.lit(stage)).otherwise(found)
    return found


def java_hash(text: Column) -> Column:
    """The 31-hash of a text's UTF-16 units as a signed 32-bit number (for texts of the basic plane)."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(wrapped >= 2**31, wrapped - 2**32).otherwise(wrapped)


def hash_embedding(text: Column, dimensions: int) -> Column:
    """SCL14: a unit vector that follows from the text's 31-hash; equal texts get equal vectors."""
    start = java_hash(text).bitwiseAND(F.lit(0xFFFFFFFF))
    chain = F.aggregate(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        F.struct(start.alias("h"), F.array().cast("array<long>").alias("all")),
        lambda s, i: F.struct(
            (s["h"] * 31 + i).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"),
            F.concat(s["all"], F.array((s["h"] * 31 + i).bitwiseAND(F.lit(0xFFFFFFFF)))).alias("all"),
        ),
        lambda s: s["all"],
    )
    values = F.transform(chain, lambda x: F.sin(F.when(x >= 2**31, x - 2**32).otherwise(x).cast("double")) * 0.5)
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda t, v: t + v * v))
    return F.transform(values, lambda v: v / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
