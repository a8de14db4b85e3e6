"""Rules over lines and chunks: pattern scans, secrets, taint, running flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.session import spread


@dataclass(frozen=True)
class Rule:
    """A pattern with what it means."""

    name: str
    severity: str
    pattern: str


# Patterns looked for in single lines.
LINE_RULES = (
    Rule("sql-injection", "HIGH", r"(?i)(\+\s*['\"`]|['\"`]\s*\+).*(?:SELECT|INSERT|UPDATE|DELETE|DROP)"),
    Rule("code-injection", "HIGH", r"eval\s*\("),
    Rule("xss", "MEDIUM", r"innerHTML\s*="),
    Rule("command-injection", "HIGH", r"child_process|exec\s*\(|execSync\s*\("),
    Rule("hardcoded-secret", "HIGH", r"(?i)password\s*[:=]\s*['\"`][^'\"`]+['\"`]"),
    Rule("weak-random", "LOW", r"Math\.random\s*\(\)"),
    Rule("path-traversal", "MEDIUM", r"createReadStream|readFileSync|readFile"),
    Rule("code-injection", "HIGH", r"new\s+Function\s*\("),
    Rule("open-redirect", "MEDIUM", r"res\.redirect\s*\(\s*req\."),
)
# Patterns looked for in a whole chunk, one finding each.
CHUNK_RULES = (
    Rule("code-injection", "CRITICAL", r"eval\s*\("),
    Rule("input-validation", "HIGH", r"req\.(body|params|query)\s*\["),
    Rule("hardcoded-secret", "HIGH", r"(?i)(password|secret|api_?key|token)\s*[:=]\s*[\"'][^\"']+[\"']"),
    Rule("sql-injection", "CRITICAL", r"\.query\s*\(\s*[`\"'].*\$\{"),
    Rule("xss", "HIGH", r"dangerouslySetInnerHTML|\.innerHTML\s*="),
    Rule("command-injection", "HIGH", r"child_process|exec\(|execSync\(|spawn\("),
    Rule("info-leak", "LOW", r"console\.(log|error|warn|debug)\s*\("),
    Rule("code-quality", "INFO", r"(?i)TODO|FIXME|HACK|XXX"),
    Rule("code-injection", "HIGH", r"new\s+Function\s*\("),
    Rule("path-traversal", "HIGH", r"(?i)\.readFileSync|\.readFile\s*\(\s*(?:req|user|input)"),
)
# Patterns of slow code, looked for in a whole chunk.
PERFORMANCE_RULES = (
    Rule("nested-loops", "MEDIUM", r"(?s)for\s*\(.*\)\s*\{[^}]*for\s*\("),
    Rule("nested-iteration", "MEDIUM", r"(?s)\.forEach\([^)]*\.forEach\("),
    Rule("sequential-async", "HIGH", r"(?s)await\s+.*(?:for|while)\s*\("),
    Rule("deep-clone", "LOW", r"JSON\.parse\(JSON\.stringify\("),
    Rule("chained-array-ops", "LOW", r"\.filter\(.*\)\.map\(|\.map\(.*\)\.filter\("),
)
# Where data that users control comes from, by kind of source.
SOURCE_KINDS = (
    ("http-input", r"req\.(body|query|params|headers|cookies)"),
    ("environment", r"process\.env"),
    ("file-read", r"\.(?:readFile|readFileSync|createReadStream)"),
    ("user-input", r"(?:prompt|readline|stdin)"),
    ("external-data", r"(?:fetch|axios|http\.get|request)\s*\("),
    ("parsed-input", r"JSON\.parse\s*\("),
)
# Where such data does harm, by kind of sink.
SINK_KINDS = (
    ("database-query", r"(?:query|execute|run)\s*\("),
    ("eval", r"eval\s*\("),
    ("dom-manipulation", r"innerHTML"),
    ("command-execution", r"child_process|exec\s*\(|execSync\s*\(|spawn\s*\("),
    ("response-output", r"\.(?:write|send|json|render)\s*\("),
    ("redirect", r"\.redirect\s*\("),
    ("file-write", r"fs\.(writeFile|appendFile|createWriteStream)"),
    ("dynamic-function", r"new\s+Function\s*\("),
)
SOURCES = "(?i)" + "|".join(p for _, p in SOURCE_KINDS)
SINKS = "(?i)" + "|".join(p for _, p in SINK_KINDS)
ASSIGNED = r"(?:const|let|var)\s+(\w+)\s*=[^=>]"
DECLARED = r"(?:const|let|var)\s+(\w+)\s*=(.*)"
# What a string literal with a secret looks like.
SECRET = r"(?i)(api[_-]?key|secret|password|passwd|token|auth|credential|private[_-]?key|access[_-]?key)[\s\"'`:=]+[A-Za-z0-9_\-/+]{16,}"
CREDENTIAL_URL = r"(?i)https?://[^:]+:[^@]+@"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
ENTROPY_SHAPE = r"^[A-Za-z0-9+/=_\-]{20,}$"
LITERAL = "\"[^\"\\n]*\"|'[^'\\n]*'|`[^`\\n]*`"


def lines(chunks: DataFrame, *keep: str) -> DataFrame:
    """(row, id, ..., line_no, line): the lines of each row of chunks, from 1.

    Rows are told apart by a number, as an id may come again with the same code: results are made by row
    and repeats dropped from them, so that no text is exchanged.
    """
    rows = chunks.where("code is not null").select(F.monotonically_increasing_id().alias("row"), "id", *keep, "code")
    return rows.select("row", "id", *keep, F.posexplode(X.code_lines(F.col("code"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def scan_lines(chunks: DataFrame, rules: tuple[Rule, ...] = LINE_RULES) -> DataFrame:
    """RUL1: (id, line_no, rule, severity) of every line that a rule matches, each once.

    Lines meet all rules in one projection; nothing is joined, and chunks that no rule matches anywhere
    are dropped before their lines are taken apart.
    """
    chunks, some = spread(chunks.select("id", "code")), F.lit(False)
    for r in rules:
        some = some | F.col("code").rlike(r.pattern)
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(r.pattern), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules)))
    found = lines(chunks.where(some)).withColumn("hits", hits).where(F.size("hits") > 0)
    return found.select("id", F.col("line_no").cast("long").alias("line_no"), F.explode("hits").alias("hit")).select("id", "line_no", "hit.*").distinct()


def scan_chunks(chunks: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """RUL5-6: one finding for each chunk and matching rule, at the first line that matches alone.

    Columns id, file_path, rule, severity, line, last_line; of findings with the same path, rule name and
    line the first by id stays, then the first by the rules' order (WIN6). Lines count from the chunk's
    start line (0 if null).
    """
    given = spread(chunks.where("code is not null and file_path is not null").select("id", "file_path", "start_line", "end_line", "code"))
    start = F.coalesce("start_line", F.lit(0))

    def hit(k: int, r: Rule) -> Column:
        line = start + F.coalesce(X.first_match(F.col("code"), r.pattern), F.lit(0))
        made = F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), line.cast("long").alias("line"), F.least(line + 3, F.col("end_line")).cast("long").alias("last_line"), F.lit(k).alias("k"))
        return F.when(F.col("code").rlike(r.pattern), made)

    found = given.select("id", "file_path", F.explode(F.array_compact(F.array(*(hit(k, r) for k, r in enumerate(rules))))).alias("hit"))
    first = found.groupBy("file_path", F.col("hit.rule").alias("rule"), F.col("hit.line").alias("line")).agg(F.min(F.struct("id", "hit.k", "hit.severity", "hit.last_line")).alias("f"))
    return first.select("f.id", "file_path", "rule", "f.severity", "line", "f.last_line")


def literals(chunks: DataFrame) -> DataFrame:
    """(row, id, text): the string literals of each row of chunks with their quotes, with repeats."""
    rows = spread(chunks.where("code is not null").select("id", "code")).withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "id", F.explode(F.regexp_extract_all("code", F.lit(LITERAL), F.lit(0))).alias("text"))


def secret_kind(text: Column) -> Column:
    """PRS15, T17: what makes a literal suspicious, first kind wins; null if nothing does.

    All addresses in a literal count, not the first alone.
    """
    inner = X.strip_quotes(text)
    addresses = F.filter(F.regexp_extract_all(text, F.lit(IPV4), F.lit(0)), lambda ip: ~X.is_local_ip(ip))
    random = inner.rlike(ENTROPY_SHAPE) & (X.entropy(F.when(inner.rlike(ENTROPY_SHAPE), inner)) > 4.0)
    return F.when(text.rlike(SECRET), "assignment").when(text.rlike(CREDENTIAL_URL), "url").when(F.size(addresses) > 0, "address").when(random, "entropy")


def _kinds(line: Column, table: tuple[tuple[str, str], ...]) -> Column:
    return F.array_compact(F.array(*(F.when(line.rlike("(?i)" + pattern), kind) for kind, pattern in table)))


def taint(chunks: DataFrame) -> DataFrame:
    """RUL2, WIN7: what each variable that a chunk assigns takes in and where it goes, once for each id and variable.

    Only lines that name the variable count. ``sources`` and ``sinks`` count kinds on lines; a sink is
    ``dangerous`` if a line up to and including its own assigned the variable from a source that users
    control. ``from_kinds``, ``to_kinds`` and ``harmed_by`` are the different kinds of sources, sinks and
    dangerous sinks, ``passed_to`` the variables that are declared from it, each in order, with spaces.
    Lines shrink to kinds and names before anything is exchanged.
    """
    line = F.col("line")
    names = F.array_distinct(F.flatten(F.transform(X.code_lines(F.col("code")), lambda x: F.regexp_extract_all(x, F.lit(ASSIGNED), F.lit(1)))))
    some = spread(chunks.select("id", "code")).where(F.col("code").rlike(ASSIGNED)).withColumn("names", names)
    rows = lines(some, "names").select(
        "row", "id", "line_no", F.array_intersect(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0)), "names").alias("named"), F.regexp_extract_all("line", F.lit(r"(\w+)\s*=[^=>]"), F.lit(1)).alias("assigned"),
        F.regexp_extract("line", DECLARED, 1).alias("target"), F.regexp_extract_all(F.regexp_extract("line", DECLARED, 2), F.lit(r"\w+"), F.lit(0)).alias("taken"), _kinds(line, SOURCE_KINDS).alias("from"), _kinds(line, SINK_KINDS).alias("to"),
    )
    each = rows.withColumn("variable", F.explode("named"))
    none = F.array().cast("array<string>")
    has = lambda c: F.array_contains(c, F.col("variable"))
    flagged = each.select("row", "id", "variable", "line_no", F.when(has("assigned"), F.col("from")).otherwise(none).alias("from"), "to", F.when(has("taken"), F.col("target")).alias("target"))
    so_far = F.max(F.size("from") > 0).over(Window.partitionBy("row", "id", "variable").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = flagged.withColumn("harm", F.when(so_far, F.col("to")).otherwise(none))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), " ")
    counted = marked.groupBy("row", "id", "variable").agg(
        *(F.sum(F.size(a)).alias(b) for a, b in (("from", "sources"), ("to", "sinks"), ("harm", "dangerous"))),
        joined("from").alias("from_kinds"), joined("to").alias("to_kinds"), joined("harm").alias("harmed_by"), F.array_join(F.array_sort(F.collect_set("target")), " ").alias("passed_to"),
    )
    risk = F.when(F.col("dangerous") > 0, "HIGH").when(F.col("sources") > 0, "MEDIUM").otherwise("LOW")
    return counted.withColumn("risk", risk).drop("row").distinct()
