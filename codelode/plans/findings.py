"""Queries of rule scans, findings, verification, reports and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import coverage, diffing, rules, verify
from codelode.plans.graphs import EDGES, ONE, TEST, chunk_files, imports
from codelode.plans.registry import Registry, literal
from codelode.plans.scalars import JOB
from codelode.session import sent_if_small, spread
from codelode.sources.tables import table

R = Registry()
CODE = "(SELECT id, any_value(file_path) AS file_path, any_value(start_line) AS start_line, any_value(end_line) AS end_line, any_value(code) AS code FROM chunks WHERE code IS NOT NULL GROUP BY id)"
#: One row for each finding: the one received last.
LATEST = "(SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC) = 1)"


def latest_findings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row for each finding id: the one received last."""
    rows = table(spark, d, "findings")
    packed = rows.groupBy("id").agg(F.max_by(F.struct(*columns), "received_at").alias("r"))
    return packed.select("id", "r.*")


def _rule_rows(items, column: str) -> str:
    return " UNION ALL ".join(f"SELECT id, line_no, '{r.name}' AS rule, '{r.severity}' AS severity FROM lines WHERE regexp_matches({column}, {literal(r.pattern)})" for r in items)


@R.add(f"WITH split AS (SELECT id, string_split(code, chr(10)) AS l FROM {CODE}), lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM split) SELECT DISTINCT * FROM ({_rule_rows(rules.LINE_RULES, 'line')})")
def rule_scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """RUL1: all lines that a rule matches."""
    return rules.scan_lines(table(spark, d, "chunks"))


def _chunk_sql(items) -> str:
    made = " UNION ALL ".join(
        f"""SELECT id, file_path, '{r.name}' AS rule, '{r.severity}' AS severity, end_line, {k} AS k,
        coalesce(start_line, 0) + greatest(list_position(list_transform(string_split(code, chr(10)), lambda l: regexp_matches(l, {literal(r.pattern)})), true), 1) - 1 AS line
        FROM c WHERE regexp_matches(code, {literal(r.pattern)})"""
        for k, r in enumerate(items)
    )
    return f"""
WITH c AS (SELECT * FROM {CODE} WHERE file_path IS NOT NULL), hits AS ({made})
SELECT id, file_path, rule, severity, line::BIGINT AS line, least(line + 3, end_line)::BIGINT AS last_line FROM hits QUALIFY row_number() OVER (PARTITION BY file_path, rule, line ORDER BY id, k) = 1
"""


@R.add(_chunk_sql(rules.CHUNK_RULES).replace("greatest(list_position", "greatest(coalesce(list_position").replace("true), 1) - 1", "true), 0), 1) - 1"))
def security_findings(spark: SparkSession, d: str) -> DataFrame:
    """RUL5, STR14: one finding for each chunk and security rule."""
    return rules.scan_chunks(table(spark, d, "chunks"), rules.CHUNK_RULES)


@R.add(_chunk_sql(rules.PERFORMANCE_RULES).replace("greatest(list_position", "greatest(coalesce(list_position").replace("true), 1) - 1", "true), 0), 1) - 1"))
def performance_findings(spark: SparkSession, d: str) -> DataFrame:
    """RUL6, STR15: one finding for each chunk and performance rule."""
    return rules.scan_chunks(table(spark, d, "chunks"), rules.PERFORMANCE_RULES)


ENTROPY_SQL = "(SELECT -sum(k * 1.0 / length(inner_text) * log2(k * 1.0 / length(inner_text))) FROM (SELECT count(*) AS k FROM (SELECT unnest(string_split(inner_text, '')) AS ch) GROUP BY ch))"


@R.add(f"""
WITH l AS (SELECT id, unnest(regexp_extract_all(code, {literal(rules.LITERAL)})) AS text FROM {CODE}),
k AS (SELECT id, text, substring(text, 2, length(text) - 2) AS inner_text FROM l),
e AS (SELECT inner_text, -sum(n * 1.0 / len * log2(n * 1.0 / len)) AS bits FROM (SELECT inner_text, length(inner_text) AS len, ch, count(*) AS n FROM (SELECT inner_text, unnest(string_split(inner_text, '')) AS ch FROM (SELECT DISTINCT inner_text FROM k WHERE regexp_matches(inner_text, {literal(rules.ENTROPY_SHAPE)}))) GROUP BY 1, 2, 3) GROUP BY 1),
j AS (SELECT id, CASE WHEN regexp_matches(text, {literal(rules.SECRET)}) THEN 'assignment' WHEN regexp_matches(text, {literal(rules.CREDENTIAL_URL)}) THEN 'url'
  WHEN len(list_filter(regexp_extract_all(text, {literal(rules.IPV4)}), lambda ip: NOT (ip IN ('127.0.0.1', '0.0.0.0') OR starts_with(ip, '192.168.') OR starts_with(ip, '10.')))) > 0 THEN 'address' WHEN bits > 4.0 THEN 'entropy' END AS kind
  FROM k LEFT JOIN e USING (inner_text))
SELECT id, kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY id, kind
""")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """PRS15, SCL7, SCL9-10: suspicious literals of each chunk by kind."""
    found = rules.literals(table(spark, d, "chunks")).select("row", "id", rules.secret_kind(F.col("text")).alias("kind")).where("kind is not null")
    return found.groupBy("row", "id", "kind").agg(F.count("*").alias("n")).select("id", "kind", "n").distinct()


def _kinds_sql(kinds) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(line, {literal('(?i)' + pattern)}) THEN '{kind}' END" for kind, pattern in kinds) + "], lambda x: x IS NOT NULL)"


@R.add(f"""
WITH split AS (SELECT id, string_split(code, chr(10)) AS l FROM {CODE}), lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM split),
named AS (SELECT DISTINCT id, unnest(regexp_extract_all(line, {literal(rules.ASSIGNED)}, 1)) AS variable FROM lines),
words AS (SELECT DISTINCT id, line_no, line, unnest(regexp_extract_all(line, '\\w+')) AS variable FROM lines WHERE id IN (SELECT id FROM named)),
seen AS (SELECT id, variable, line_no, CASE WHEN list_contains(regexp_extract_all(line, '(\\w+)\\s*=[^=>]', 1), variable) THEN {_kinds_sql(rules.SOURCE_KINDS)} ELSE []::VARCHAR[] END AS taken_from, {_kinds_sql(rules.SINK_KINDS)} AS goes_to,
  CASE WHEN list_contains(regexp_extract_all(regexp_extract(line, {literal(rules.DECLARED)}, 2), '\\w+'), variable) THEN regexp_extract(line, {literal(rules.DECLARED)}, 1) END AS target FROM words JOIN named USING (id, variable)),
f AS (SELECT *, CASE WHEN max((len(taken_from) > 0)::int) OVER (PARTITION BY id, variable ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN goes_to ELSE []::VARCHAR[] END AS harm FROM seen),
g AS (SELECT id, variable, sum(len(taken_from))::BIGINT AS sources, sum(len(goes_to))::BIGINT AS sinks, sum(len(harm))::BIGINT AS dangerous, {", ".join(f"array_to_string(list_sort(list_distinct(flatten(list({a})))), ' ') AS {b}" for a, b in (("taken_from", "from_kinds"), ("goes_to", "to_kinds"), ("harm", "harmed_by")))},
  coalesce(array_to_string(list_sort(list_distinct(list(target))), ' '), '') AS passed_to FROM f GROUP BY 1, 2)
SELECT *, CASE WHEN dangerous > 0 THEN 'HIGH' WHEN sources > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM g
""")
def taint_running(spark: SparkSession, d: str) -> DataFrame:
    """RUL2, WIN7: sources and sinks by kind, and what is passed on, of every variable that a chunk assigns."""
    return rules.taint(table(spark, d, "chunks"))


FOLD = "trim(regexp_replace({0}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
KEYS = "list_filter(list_transform(string_split_regex(lower({0}), '[ \\t\\r\\n]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(literal(w) for w in X.STOP_WORDS) + "], w))"


@R.add(f"""
WITH f AS (SELECT DISTINCT id, unnest(chunk_ids) AS chunk_id, start_line, end_line, code_snippet, title AS claim FROM {LATEST}),
c AS (SELECT id AS chunk_id, coalesce(start_line, 1) AS b, code FROM {CODE}), j AS (SELECT * FROM f LEFT JOIN c USING (chunk_id)),
p AS (SELECT *, len(string_split(code, chr(10))) AS size, {FOLD.format('code_snippet')} AS snip, {FOLD.format('code')} AS whole, {KEYS.format('claim')} AS keys FROM j),
k AS (SELECT *, [CASE WHEN start_line IS NOT NULL THEN start_line - b BETWEEN 0 AND size - 1 END, CASE WHEN end_line IS NOT NULL THEN end_line - b BETWEEN 0 AND size - 1 END,
  CASE WHEN code_snippet <> '' THEN contains(whole, snip) OR len(list_filter(string_split(lower(snip), ' '), lambda w: list_contains(string_split(lower(whole), ' '), w))) / len(string_split(lower(snip), ' ')) >= 0.6 END,
  CASE WHEN len(keys) > 0 THEN len(list_filter(keys, lambda w: contains(lower(code), w))) / len(keys) >= 0.5 END] AS checks FROM p),
n AS (SELECT id, chunk_id, code IS NOT NULL AS known, len(list_filter(checks, lambda x: x)) AS a, len(list_filter(checks, lambda x: NOT x)) AS d FROM k)
SELECT id, chunk_id, CASE WHEN known THEN a ELSE 0 END::BIGINT AS agree, CASE WHEN known THEN d ELSE 0 END::BIGINT AS disagree,
  CASE WHEN NOT known THEN 'DISPUTED' WHEN d = 0 THEN 'CONFIRMED' WHEN d <= a THEN 'PLAUSIBLE' ELSE 'DISPUTED' END AS verdict FROM n
""")
def verify_findings(spark: SparkSession, d: str) -> DataFrame:
    """RUL7, STR18, T20: every finding held against the chunks it cites."""
    found = latest_findings(spark, d, "chunk_ids", "start_line", "end_line", "code_snippet", F.col("title").alias("claim"))
    cited = sent_if_small(found.select(F.explode("chunk_ids").alias("id")).distinct())
    chunks = table(spark, d, "chunks").where("code is not null").select("id", "start_line", "code").join(cited, "id", "left_semi").dropDuplicates(["id"])
    return verify.verify(found, chunks)


@R.add(f"SELECT count(*) AS findings, sum((verdict = 'CONFIRMED')::int)::BIGINT AS confirmed, sum((verdict = 'PLAUSIBLE')::int)::BIGINT AS plausible, sum((verdict = 'DISPUTED')::int)::BIGINT AS disputed, round(avg((verdict = 'DISPUTED')::int), 4) AS dispute_rate FROM ({R.entries['verify_findings'][1]})")
def dispute_rate(spark: SparkSession, d: str) -> DataFrame:
    """AGG9-10: verdicts of the verification and the share of disputed findings."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return verify_findings(spark, d).agg(F.count("*").alias("findings"), is_("CONFIRMED").alias("confirmed"), is_("PLAUSIBLE").alias("plausible"), is_("DISPUTED").alias("disputed"), F.round(F.avg((F.col("verdict") == "DISPUTED").cast("double")), 4).alias("dispute_rate"))


@R.add(f"""
WITH s AS (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']) AS severity), f AS (SELECT upper(trim(severity)) AS severity, agent_id FROM {LATEST}), a AS (SELECT DISTINCT agent_id FROM f)
SELECT a.agent_id, s.severity, count(f.severity) AS n FROM a CROSS JOIN s LEFT JOIN f ON f.agent_id = a.agent_id AND f.severity = s.severity GROUP BY 1, 2
""")
def severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG11, AGG13: findings by agent and severity, with zeros."""
    found = latest_findings(spark, d, F.upper(F.trim("severity")).alias("severity"), "agent_id")
    counts = found.groupBy("agent_id").pivot("severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]).agg(F.count(F.lit(1))).na.fill(0)
    return counts.select("agent_id", F.expr("stack(5, 'CRITICAL', CRITICAL, 'HIGH', HIGH, 'MEDIUM', MEDIUM, 'LOW', LOW, 'INFO', INFO) as (severity, n)"))


@R.add(f"""
WITH j AS (SELECT DISTINCT {JOB} AS job FROM chunks WHERE file_path IS NOT NULL), f AS (SELECT {JOB} AS job, upper(trim(severity)) AS s FROM {LATEST} WHERE coalesce(critique_verdict, '') <> 'DISPUTED')
SELECT j.job, count(f.s) AS findings, greatest(0, least(100, 100 - 15 * count(*) FILTER (s = 'CRITICAL') - 8 * count(*) FILTER (s = 'HIGH') - 3 * count(*) FILTER (s = 'MEDIUM') - count(*) FILTER (s = 'LOW')))::BIGINT AS health
FROM j LEFT JOIN f ON j.job = f.job WHERE j.job IS NOT NULL GROUP BY j.job
""")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    """AGG12: 100 less 15, 8, 3 and 1 for each critical, high, medium and low finding that isn't disputed, from 0 to 100."""
    jobs = table(spark, d, "chunks").select(X.job_of(F.col("file_path")).alias("job")).where("job is not null").distinct()
    found = latest_findings(spark, d, X.job_of(F.col("file_path")).alias("job"), F.upper(F.trim("severity")).alias("s"), F.coalesce("critique_verdict", F.lit("")).alias("v")).where("v <> 'DISPUTED'")
    is_ = lambda s: F.count_if(F.col("s") == s)
    penalty = 15 * is_("CRITICAL") + 8 * is_("HIGH") + 3 * is_("MEDIUM") + is_("LOW")
    return jobs.join(found.select("job", "s"), "job", "left").groupBy("job").agg(F.count("s").alias("findings"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("long").alias("health"))


@R.add(f"""
SELECT agent_id, count(*) AS findings, count(critique_verdict) AS judged, sum((critique_verdict = 'CONFIRMED')::int)::BIGINT AS confirmed, sum((critique_verdict = 'DISPUTED')::int)::BIGINT AS disputed,
  sum((critique_verdict = 'CONFIRMED' AND upper(severity) IN ('CRITICAL', 'HIGH'))::int)::BIGINT AS urgent FROM {LATEST} GROUP BY agent_id
""")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG9, AGG14: what a report's head says, by agent."""
    found = latest_findings(spark, d, "agent_id", "critique_verdict", "severity")
    verdict = F.col("critique_verdict")
    urgent = (verdict == "CONFIRMED") & F.upper("severity").isin("CRITICAL", "HIGH")
    is_ = lambda v: F.sum((verdict == v).cast("long"))
    return found.groupBy("agent_id").agg(F.count("*").alias("findings"), F.count(verdict).alias("judged"), is_("CONFIRMED").alias("confirmed"), is_("DISPUTED").alias("disputed"), F.sum(urgent.cast("long")).alias("urgent"))


@R.add(f"""
WITH t AS (SELECT DISTINCT dst AS file_path, true AS tested FROM {EDGES} WHERE {TEST.format('src')} AND NOT {TEST.format('dst')}), v AS (SELECT DISTINCT file_path, true AS vulnerable FROM findings WHERE agent_id = 'security' AND file_path IS NOT NULL),
g AS (SELECT c.id, c.file_path, cyclomatic_complexity, coalesce(vulnerable, false) AS vulnerable, coalesce(tested, false) AS tested FROM {ONE} c LEFT JOIN t USING (file_path) LEFT JOIN v USING (file_path) WHERE cyclomatic_complexity > 5),
r AS (SELECT *, CASE WHEN cyclomatic_complexity > 10 AND vulnerable AND NOT tested THEN 1 WHEN NOT tested THEN 2 ELSE 3 END AS tier FROM g)
SELECT id, file_path, cyclomatic_complexity, vulnerable, tested, tier FROM r WHERE tier <= 2 OR vulnerable
""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """RUL8, JOI14: all complex chunks that no test reaches or that are vulnerable, with their tier."""
    tested = coverage.test_edges(imports(spark, d))
    vulnerable = table(spark, d, "findings").where("agent_id = 'security'")
    return coverage.coverage_gaps(chunk_files(spark, d), tested, vulnerable)


@R.add(f"SELECT id, tier, cyclomatic_complexity FROM ({R.entries['coverage_gaps'][1]}) ORDER BY tier, cyclomatic_complexity DESC, id LIMIT 30")
def risk_tiers(spark: SparkSession, d: str) -> DataFrame:
    """RUL8: the thirty riskiest gaps."""
    return coverage_gaps(spark, d).orderBy("tier", F.col("cyclomatic_complexity").desc(), "id").limit(30).select("id", "tier", "cyclomatic_complexity")


@R.add(f"""
SELECT count(DISTINCT file_path) FILTER ({TEST.format('file_path')}) AS test_files, count(DISTINCT file_path) FILTER (NOT {TEST.format('file_path')}) AS source_files, (SELECT count(DISTINCT dst) FROM {EDGES} WHERE {TEST.format('src')} AND NOT {TEST.format('dst')}) AS mapped FROM chunks WHERE file_path IS NOT NULL
""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG21: test files, source files and sources that a test imports."""
    files = table(spark, d, "chunks").where("file_path is not null").select("file_path").distinct()
    a = files.agg(F.count_if(coverage.is_test(F.col("file_path"))).alias("test_files"), F.count_if(~coverage.is_test(F.col("file_path"))).alias("source_files"), F.lit(1).alias("k"))
    b = coverage.test_edges(imports(spark, d)).agg(F.countDistinct("source").alias("mapped"), F.lit(1).alias("k"))
    return a.join(b, "k").select("test_files", "source_files", "mapped")


@R.add(f"SELECT id, file_path, cyclomatic_complexity FROM {ONE} WHERE cyclomatic_complexity IS NOT NULL ORDER BY cyclomatic_complexity DESC, id LIMIT 20")
def topk_complexity(spark: SparkSession, d: str) -> DataFrame:
    """WIN1, RUL11: the twenty most complex chunks."""
    return chunk_files(spark, d).where("cyclomatic_complexity is not null").orderBy(F.col("cyclomatic_complexity").desc(), "id").limit(20)


@R.add("""
WITH c AS (SELECT id, any_value(file_path) AS f, max(cyclomatic_complexity) AS cc, max(coalesce(len(smells), 0)) AS s FROM chunks GROUP BY id)
SELECT count(*) AS chunks, count(DISTINCT f) AS files, round(avg(cc), 2) AS mean_complexity, sum(s)::BIGINT AS smells, count(*) FILTER (cc > 10) AS complex FROM c
""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG1, AGG16, AGG19-20: the size and quality of all chunks in one row."""
    one = table(spark, d, "chunks").groupBy("id").agg(F.max("file_path").alias("f"), F.max("cyclomatic_complexity").alias("cc"), F.max(F.coalesce(F.size("smells"), F.lit(0))).alias("s"))
    return one.agg(F.count("*").alias("chunks"), F.countDistinct("f").alias("files"), F.round(F.avg("cc"), 2).alias("mean_complexity"), F.sum("s").cast("long").alias("smells"), F.count_if(F.col("cc") > 10).alias("complex"))


@R.add("""
WITH s AS (SELECT DISTINCT id, file_path, unnest(smells) AS s FROM chunks WHERE file_path IS NOT NULL)
SELECT file_path, count(*) AS smells, string_agg(DISTINCT s.type, ' ' ORDER BY s.type) AS kinds FROM s GROUP BY file_path
""")
def files_with_smells(spark: SparkSession, d: str) -> DataFrame:
    """AGG3, T4: each file's smells and their kinds."""
    smells = table(spark, d, "chunks").where("file_path is not null").select("id", "file_path", F.explode("smells").alias("s")).distinct()
    return smells.groupBy("file_path").agg(F.count("*").alias("smells"), F.array_join(F.array_sort(F.collect_set("s.type")), " ").alias("kinds"))


@R.add(f"""
WITH c AS (SELECT id, file_path, code, len(string_split(rtrim(code, chr(10)), chr(10))) AS n FROM {CODE})
SELECT id, 'LongFunction' AS smell FROM c WHERE n > 80
UNION ALL SELECT id, 'ConsoleLog' FROM c WHERE regexp_matches(code, 'console[.](log|warn|error|info|debug|trace)[ ]*[(]') AND NOT coalesce(regexp_matches(lower(file_path), 'utils|logger'), false)
UNION ALL SELECT id, 'HardcodedSecret' FROM c WHERE regexp_matches(code, {literal(rules.SECRET)})
""")
def smell_union(spark: SparkSession, d: str) -> DataFrame:
    """PRS11, PRS14, PRS16: what line-oriented detectors say of each chunk."""
    given = spread(table(spark, d, "chunks").where("code is not null").select("id", "file_path", "code"))
    quiet = F.coalesce(F.lower("file_path").rlike("utils|logger"), F.lit(False))
    long = F.size(X.code_lines(F.rtrim("code", F.lit("\n")))) > 80
    kinds = F.array(F.when(long, "LongFunction"), F.when(F.col("code").rlike("console[.](log|warn|error|info|debug|trace)[ ]*[(]") & ~quiet, "ConsoleLog"), F.when(F.col("code").rlike(rules.SECRET), "HardcodedSecret"))
    return given.select("id", F.explode(F.array_compact(kinds)).alias("smell")).distinct()


@R.add(f"""
WITH f AS (SELECT id, chunk_ids, lower(file_path) AS p, lower(category) AS c, lower(title) AS t, evidence FROM {LATEST}),
k AS (SELECT id, evidence, list_filter(evidence, lambda e: coalesce(len(list_filter(chunk_ids, lambda x: contains(lower(e.input), lower(x)))) > 0, false) OR coalesce(contains(lower(e.input), p) OR contains(lower(e.output), p), false)
  OR coalesce(contains(lower(e.output), c), false) OR coalesce(contains(lower(e.output), t), false)) AS kept FROM f)
SELECT id, len(evidence)::BIGINT AS given, len(CASE WHEN len(kept) > 0 THEN kept ELSE evidence END)::BIGINT AS kept FROM k
""")
def evidence_match(spark: SparkSession, d: str) -> DataFrame:
    """SCL31, JOI19: how much of each finding's evidence is about it."""
    found = latest_findings(spark, d, "chunk_ids", "file_path", "category", "title", "evidence")
    kept = verify.relevant_evidence(*(F.col(c) for c in ("evidence", "chunk_ids", "file_path", "category", "title")))
    size = lambda c: F.when(c.isNotNull(), F.size(c)).cast("long")
    return found.select("id", size(F.col("evidence")).alias("given"), size(kept).alias("kept"))


# Topics and the public documents about them; the second list holds for JavaScript-like technology only.
TOPICS = (
    ("sql-injection", "https://owasp.org/www-community/attacks/SQL_Injection"),
    ("sql-injection", "https://cwe.mitre.org/data/definitions/89.html"),
    ("sql-injection", "https://cheatsheetseries.owasp.org/cheatsheets/SQL_Injection_Prevention_Cheat_Sheet.html"),
    ("xss", "https://owasp.org/www-community/attacks/xss/"),
    ("xss", "https://cwe.mitre.org/data/definitions/79.html"),
    ("xss", "https://cheatsheetseries.owasp.org/cheatsheets/Cross_Site_Scripting_Prevention_Cheat_Sheet.html"),
    ("command-injection", "https://owasp.org/www-community/attacks/Command_Injection"),
    ("command-injection", "https://cwe.mitre.org/data/definitions/78.html"),
    ("code-injection", "https://owasp.org/www-community/attacks/Code_Injection"),
    ("code-injection", "https://cwe.mitre.org/data/definitions/94.html"),
    ("hardcoded-secret", "https://owasp.org/www-community/vulnerabilities/Use_of_hard-coded_password"),
    ("hardcoded-secret", "https://cwe.mitre.org/data/definitions/798.html"),
    ("path-traversal", "https://owasp.org/www-community/attacks/Path_Traversal"),
    ("path-traversal", "https://cwe.mitre.org/data/definitions/22.html"),
    ("open-redirect", "https://cwe.mitre.org/data/definitions/601.html"),
    ("memory-leak", "https://nodejs.org/en/docs/guides/diagnostics/memory/using-heap-profiler"),
    ("event-loop", "https://nodejs.org/en/docs/guides/event-loop-timers-and-nexttick"),
    ("complexity", "https://www.bigocheatsheet.com/"),
)
SCRIPT_TOPICS = (
    ("error-handling", "https://expressjs.com/en/guide/error-handling.html"),
    ("error-handling", "https://nodejs.org/api/errors.html"),
    ("authentication", "https://cheatsheetseries.owasp.org/cheatsheets/Authentication_Cheat_Sheet.html"),
    ("input-validation", "https://cheatsheetseries.owasp.org/cheatsheets/Input_Validation_Cheat_Sheet.html"),
)
SCRIPT = "node|express|javascript|typescript"


def references(category: Column, technology: Column) -> Column:
    """JOI17: the different documents for a category (lower case): topic in category or category in topic."""
    fits = lambda t: category.contains(t) | F.lit(t).contains(category)
    some = [F.when(fits(t), F.lit(u)) for t, u in TOPICS] + [F.when(fits(t) & F.lower(technology).rlike(SCRIPT), F.lit(u)) for t, u in SCRIPT_TOPICS]
    return F.array_distinct(F.array_compact(F.array(*some)))


#: Categories that agents report, and some more that documents are kept for.
ASKED = "(SELECT lower(category) AS category FROM findings WHERE category IS NOT NULL UNION SELECT unnest(['error-handling', 'authentication', 'input', 'memory-leak', 'event-loop', 'cyclomatic complexity', 'open-redirect', 'code-injection']))"


@R.add("WITH r(topic, url, script) AS (VALUES " + ", ".join(f"({literal(a)}, {literal(b)}, {str(s).lower()})" for s, rows in ((False, TOPICS), (True, SCRIPT_TOPICS)) for a, b in rows) + f"), c AS (SELECT category, technology FROM {ASKED}, (SELECT unnest(['TypeScript', 'go']) AS technology)) SELECT DISTINCT category, technology, url FROM c JOIN r ON (contains(category, topic) OR contains(topic, category)) AND (NOT script OR technology = 'TypeScript')")
def reference_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JOI17: documents for each category, for a JavaScript-like technology and another one."""
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("error-handling", "authentication", "input", "memory-leak", "event-loop", "cyclomatic complexity", "open-redirect", "code-injection")))).alias("category"))
    named = table(spark, d, "findings").where("category is not null").select(F.lower("category").alias("category")).unionAll(more).distinct()
    both = named.withColumn("technology", F.explode(F.array(F.lit("TypeScript"), F.lit("go"))))
    return both.select("category", "technology", F.explode(references(F.col("category"), F.col("technology"))).alias("url"))
