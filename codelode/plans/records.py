"""Queries of plans, answers in text, stored tables and advisories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import answers
from codelode.functions import text as X
from codelode.operators import cards, graph, knowledge
from codelode.plans import evaluations
from codelode.plans.findings import LATEST, latest_findings
from codelode.plans.graphs import EDGES, R as GRAPHS, chunk_files, imports
from codelode.plans.registry import Registry, literal
from codelode.session import cut, shared_dir
from codelode.sources import repository, store
from codelode.sources.tables import table

R = Registry()

ONCE = "(SELECT id, any_value(file_path) AS file_path, max(cyclomatic_complexity) AS cc, max(coalesce(len(smells), 0)) AS smelly FROM chunks GROUP BY id)"
PLAN = f"""
WITH t AS (SELECT * FROM {ONCE} ORDER BY cc DESC NULLS LAST, id LIMIT 30),
a AS (SELECT 'security' AS agent, id, cc FROM t WHERE smelly > 0 OR regexp_matches(lower(file_path), 'auth|login|session|token|secret|password|crypto|sql|query|db|middleware') UNION ALL SELECT 'performance', id, cc FROM t WHERE cc >= 5),
s AS (SELECT id, cc FROM t ORDER BY cc DESC NULLS LAST, id LIMIT 10), n AS (SELECT unnest(['security', 'performance']) AS agent),
b AS (SELECT * FROM a UNION ALL SELECT agent, id, cc FROM n, s WHERE agent NOT IN (SELECT agent FROM a))
SELECT agent, id AS chunk, row_number() OVER (PARTITION BY agent ORDER BY cc DESC NULLS LAST, id) AS place FROM b
"""


@R.add(PLAN)
def default_plan(spark: SparkSession, d: str) -> DataFrame:
    """RUL10-11: which of the most complex chunks each agent looks at."""
    rows = table(spark, d, "chunks").groupBy("id").agg(F.max("file_path").alias("file_path"), F.max("cyclomatic_complexity").alias("cyclomatic_complexity"), F.max_by("smells", F.coalesce(F.size("smells"), F.lit(0))).alias("smells"))
    return knowledge.plan(rows)


@R.add("SELECT coalesce(bool_or(contains(lower(file_path), '.test.') OR contains(lower(file_path), '.spec.') OR contains(lower(file_path), '__tests__')), false) AS tests FROM chunks")
def coverage_wanted(spark: SparkSession, d: str) -> DataFrame:
    """RUL10: whether the coverage agent has anything to do."""
    return knowledge.tests_wanted(table(spark, d, "chunks").select(F.col("file_path").alias("path")))


@R.add(f"""
WITH p AS ({PLAN}), f AS (SELECT DISTINCT agent_id AS agent, unnest(chunk_ids) AS chunk FROM {LATEST} WHERE critique_verdict = 'DISPUTED' AND agent_id <> 'performance')
SELECT agent, chunk FROM f UNION ALL SELECT agent, chunk FROM p WHERE place <= 3 AND agent NOT IN (SELECT agent FROM f)
""")
def review_targets(spark: SparkSession, d: str) -> DataFrame:
    """RUL16, STR10: chunks for another round: those of disputed findings, for agents without any the first of the plan (here for performance)."""
    found = latest_findings(spark, d, F.col("agent_id").alias("agent"), "chunk_ids", F.col("critique_verdict").alias("verdict")).where("agent <> 'performance'")
    return cards.targets(found, default_plan(spark, d))


@R.add(f"WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {EDGES}) SELECT a, b, shared, score FROM ({GRAPHS.entries['coupling'][1]}) JOIN e USING (a, b)")
def linked_coupling(spark: SparkSession, d: str) -> DataFrame:
    """GRV11: the coupling of the pairs of files that import each other, either way."""
    edge = imports(spark, d)
    pairs = edge.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return graph.coupling(edge).join(pairs, ["a", "b"]).select("a", "b", "shared", "score")


def _hint_sql() -> str:
    about = "lower(concat_ws(' ', category, description))"
    return "concat_ws(chr(10), " + ", ".join(f"CASE WHEN regexp_matches({about}, {literal(p)}) THEN {literal('- ' + hint)} END" for p, hint in cards.HINTS) + ")"


@R.add(f"SELECT id, {_hint_sql()} AS advice FROM {LATEST}")
def finding_advice(spark: SparkSession, d: str) -> DataFrame:
    """SCL24: how a redesign for each finding would be asked for."""
    return latest_findings(spark, d, "category", "description").select("id", cards.advice(F.col("category"), F.col("description")).alias("advice"))


@R.add("""
WITH f AS (SELECT doc_id, regexp_replace(regexp_extract(text, '(?s)```[A-Za-z]*\\n(.*?)```', 1), '^\\s+|\\s+$', '', 'g') AS fence, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(coalesce(nullif(fence, ''), bare)) AS code_md5 FROM f WHERE coalesce(nullif(fence, ''), bare) NOT IN ('', '[]')
""")
def fenced_codes(spark: SparkSession, d: str) -> DataFrame:
    """SCL25: the code of every document's first fence, or its whole text."""
    rows = table(spark, d, "documents").select("doc_id", X.fenced_code(F.col("text")).alias("code")).where("code is not null")
    return rows.select("doc_id", F.md5("code").alias("code_md5"))


@R.add(f"SELECT id, coalesce(category, '') AS category, coalesce(title, '') AS title, coalesce(severity, 'MEDIUM') AS severity, coalesce(confidence, 'LOW') AS confidence, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, coalesce(len(chunk_ids), 0)::INTEGER AS chunks FROM {LATEST}")
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """SCL26, SCL28: findings written into an answer's text as JSON, read back with defaults."""
    found = latest_findings(spark, d, "category", "title", "severity", "confidence", "start_line", "end_line", "chunk_ids")
    one = F.struct("id", "category", "title", "severity", "confidence", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("chunk_ids").alias("chunkIds"))
    told = found.select(F.concat(F.lit('See [x] and "[2", then:\n```json\n'), F.to_json(F.array(one)), F.lit("\n``` [done]")).alias("answer"))
    read = answers.findings_in(told, "answer")
    return read.select("id", "category", "title", "severity", "confidence", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), F.size("chunkIds").alias("chunks"))


@R.add(f"SELECT id AS finding, CASE WHEN critique_verdict IN ('CONFIRMED', 'DISPUTED') THEN critique_verdict ELSE 'PLAUSIBLE' END AS verdict, coalesce(critique_reason, '') AS reason FROM {LATEST} WHERE critique_verdict IS NOT NULL")
def parsed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """SCL29: verdicts written into an answer's text as JSON, read back."""
    found = latest_findings(spark, d, "critique_verdict", "critique_reason").where("critique_verdict is not null")
    one = F.struct(F.col("id").alias("findingId"), F.col("critique_verdict").alias("verdict"), F.col("critique_reason").alias("reason"))
    return answers.verdicts_in(found.select(F.concat(F.lit("Verdicts: "), F.to_json(F.array(one))).alias("answer")), "answer")


@R.add(f"SELECT agent_id AS agent, 0 AS source_files, count(*)::INTEGER AS gaps, agent_id AS summary FROM {LATEST} GROUP BY agent_id")
def parsed_reports(spark: SparkSession, d: str) -> DataFrame:
    """SCL30: coverage reports written as JSON, read back with defaults."""
    found = latest_findings(spark, d, "agent_id", "file_path", F.get("chunk_ids", F.lit(0)).alias("chunk"))
    gaps = found.groupBy("agent_id").agg(F.collect_list(F.struct(F.col("chunk").alias("chunkId"), F.col("file_path").alias("filePath"), F.lit(1).alias("riskTier"))).alias("gaps"))
    report = answers.report_in(F.to_json(F.struct("gaps", F.col("agent_id").alias("summary")))).alias("r")
    return gaps.select(F.col("agent_id").alias("agent"), report).select("agent", F.col("r.totalSourceFiles").alias("source_files"), F.size("r.gaps").alias("gaps"), "r.summary")


PERCENT = ", ".join(f"round(({c} * 100)::VARCHAR::DECIMAL(24, 15), 1)::DECIMAL(6, 1)::VARCHAR || '%' AS {c}" for c in ("precision", "recall", "f1"))


@R.add(f"SELECT agent, tp, fp, fn, {PERCENT}, row_number() OVER (ORDER BY s.f1 DESC, agent) AS place FROM ({evaluations.R.entries['verdict_scores'][1]}) s")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """SNK17, SCL32: the agents' scores as percent texts, with their place by F1."""
    scored = evaluations.verdict_scores(spark, d)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("f1").desc(), "agent"))  # over one row for each agent
    return store.summary(scored).join(scored.select("agent", place.cast("long").alias("place")), "agent")


@R.add(f"SELECT count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'WARNING') AS warning, (count(*) FILTER (level = 'CRITICAL') > 0)::INTEGER AS status FROM ({evaluations.R.entries['regressions'][1]})")
def exit_status(spark: SparkSession, d: str) -> DataFrame:
    """AGG22: what a run of evaluations ends with: 1 if any score fell critically."""
    level = F.col("level")
    counts = evaluations.regressions(spark, d).agg(F.count_if(level == "CRITICAL").alias("critical"), F.count_if(level == "WARNING").alias("warning"))
    return counts.withColumn("status", (F.col("critical") > 0).cast("int"))


@R.add("""
WITH c AS (SELECT id, any_value(file_path) AS f, max(cyclomatic_complexity) AS cc FROM chunks GROUP BY id), k AS (SELECT * FROM c WHERE cc IS NULL OR cc <= 10)
SELECT 'chunks' AS part, count(*) AS n FROM k UNION ALL SELECT 'contains', count(*) FROM k WHERE f IS NOT NULL
""")
def graph_without(spark: SparkSession, d: str) -> DataFrame:
    """SNK8: the property graph without its complex chunks."""
    chunks = chunk_files(spark, d)
    g = knowledge.without_chunks(knowledge.property_graph(chunks, imports(spark, d)), chunks.where("cyclomatic_complexity > 10"))
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(g.chunks, "chunks").unionAll(count(g.contains, "contains"))


@R.add("SELECT chunk_id AS id, any_value(file_path) AS file_path, true AS bare FROM vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def stored_payloads(spark: SparkSession, d: str) -> DataFrame:
    """SCL13: stored payloads as chunks; what only chunks have is null."""
    rows = knowledge.stored_chunks(table(spark, d, "vectors"))
    return rows.select("id", "file_path", (F.col("imports").isNull() & F.col("resolved_deps").isNull() & F.col("smells").isNull()).alias("bare"))


@R.add("SELECT id, count(*) AS n FROM chunks GROUP BY id HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """SNK6: the chunk ids that come more than once."""
    return store.repeated(table(spark, d, "chunks"), "id")


@R.add(f"SELECT agent_id AS agent, CASE WHEN agent_id = 'security' THEN 2 ELSE 1 END * count(*) AS n FROM {LATEST} WHERE agent_id <> 'performance' GROUP BY agent_id")
def stored_reports(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK4-5, SNK9-10, SNK12-13, SNK16, SRC18: a table is written, one part replaced by itself, one added to, one dropped, read, and the table removed."""
    at = store.Store(spark, f"{shared_dir(spark)}/codelode-reports-{uuid.uuid4().hex}", "agent")
    rows = latest_findings(spark, d, F.col("agent_id").alias("agent"), "category")
    at.ensure(rows)
    at.replace(rows)
    at.replace(at.read("testing"))
    at.append(rows.where("agent = 'security'"))
    at.drop("performance")
    counted = cut(at.read().groupBy("agent").agg(F.count("*").alias("n")))
    at.drop_all()
    return counted


@R.add("""
WITH a AS (SELECT DISTINCT name, rule_id, upper(severity) AS severity, description FROM known_vulnerabilities WHERE rule_id IS NOT NULL),
o AS (SELECT name, rule_id, min(coalesce(severity, '')) AS s FROM a GROUP BY 1, 2)
SELECT name AS package, rule_id AS cve, CASE WHEN s IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN s ELSE 'MEDIUM' END AS severity FROM o QUALIFY row_number() OVER (PARTITION BY name ORDER BY rule_id) <= 10
""")
def package_advisories(spark: SparkSession, d: str) -> DataFrame:
    """SRC16: up to ten advisories of every package; the known vulnerabilities stand for the database."""
    known = table(spark, d, "known_vulnerabilities").where("rule_id is not null")
    database = known.groupBy(F.col("name").alias("package"), F.col("rule_id").alias("cve")).agg(F.min(F.coalesce(F.upper("severity"), F.lit(""))).alias("severity"), F.first("description").alias("summary"), F.array().cast("array<string>").alias("links"))
    return repository.advisories(known.select(F.col("name").alias("package")), database).select("package", "cve", "severity")


@R.add("""
SELECT DISTINCT name AS package, commit_hash AS version, rule_id AS cve, CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(severity) ELSE 'MEDIUM' END AS severity, description AS summary FROM known_vulnerabilities
""")
def scanned_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """SRC6-7: a scanner's JSON about the known vulnerabilities, read back; one broken document among them gives nothing."""
    known = table(spark, d, "known_vulnerabilities")
    found = F.struct(F.col("rule_id").alias("id"), F.col("description").alias("summary"), F.struct("severity").alias("database_specific"))
    document = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct("name", F.col("commit_hash").alias("version")).alias("package"), F.array(found).alias("vulnerabilities"))).alias("packages"))).alias("results")))
    scanned = known.select(document.alias("value")).unionAll(spark.range(1).select(F.lit('{"results": [').alias("value")))
    return repository.dependency_risks(scanned).distinct()


@R.add("""
WITH v AS (SELECT DISTINCT name, file_path, line, rule_id FROM known_vulnerabilities)
SELECT name, file_path, line, rule_id, row_number() OVER (PARTITION BY name ORDER BY file_path NULLS FIRST, line NULLS FIRST, rule_id NULLS FIRST) - 1 AS position FROM v
""")
def truth_positions(spark: SparkSession, d: str) -> DataFrame:
    """WIN9: the place of every known vulnerability in its repository's list, from 0."""
    order = Window.partitionBy("name").orderBy("file_path", "line", "rule_id")
    rows = table(spark, d, "known_vulnerabilities").select("name", "file_path", "line", "rule_id").distinct()
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


@R.add(f"""
WITH c AS {ONCE}, e AS {EDGES}
(SELECT 'high_complexity_chunks' AS query, id AS item, cc::DOUBLE AS n FROM c WHERE cc IS NOT NULL ORDER BY cc DESC, id LIMIT 20)
UNION ALL (SELECT 'most_imported_files', dst, count(*) FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 20)
UNION ALL (SELECT 'files_with_smells', file_path, sum(smelly) FROM c WHERE smelly > 0 GROUP BY file_path ORDER BY sum(smelly) DESC, file_path NULLS FIRST LIMIT 20)
UNION ALL (SELECT 'dependency_fan_out', src, count(*) FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 20)
UNION ALL (SELECT 'chunk_stats', 'mean_complexity', round(avg(cc), 2) FROM c)
""")
def knowledge_queries(spark: SparkSession, d: str) -> DataFrame:
    """GRV12: all canned queries by their names."""
    chunks = table(spark, d, "chunks").groupBy("id").agg(F.max("file_path").alias("file_path"), F.max("cyclomatic_complexity").alias("cyclomatic_complexity"), F.max_by("smells", F.coalesce(F.size("smells"), F.lit(0))).alias("smells"))
    g = knowledge.KnowledgeGraph(chunks, imports(spark, d))
    item = lambda name, column, n="n": g.query(name).select(F.lit(name).alias("query"), F.col(column).alias("item"), F.col(n).cast("double").alias("n"))
    lists = item("high_complexity_chunks", "id").unionAll(item("most_imported_files", "file_path")).unionAll(item("files_with_smells", "file_path")).unionAll(item("dependency_fan_out", "file_path"))
    return lists.unionAll(g.query("chunk_stats").select(F.lit("chunk_stats"), F.lit("mean_complexity"), "mean_complexity"))
