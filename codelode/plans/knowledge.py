"""Queries of the property graph, synchronisation, context and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import cards, knowledge
from codelode.plans.evaluations import GREEDY, found_rows, true_rows
from codelode.plans.findings import LATEST, latest_findings
from codelode.plans.graphs import AROUND, EDGES, ONE, chunk_files, imports
from codelode.plans.registry import Registry, literal
from codelode.sources.tables import table

R = Registry()


@R.add(f"""
WITH e AS {EDGES}, c AS {ONE}, f AS (SELECT src AS path FROM e UNION SELECT dst FROM e UNION SELECT file_path FROM c WHERE file_path IS NOT NULL)
SELECT 'files' AS part, count(*) AS n FROM f UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'contains', count(*) FROM c WHERE file_path IS NOT NULL UNION ALL SELECT 'imports', count(*) FROM e
""")
def graph_parts(spark: SparkSession, d: str) -> DataFrame:
    """SNK7: the size of each table of the property graph."""
    g = knowledge.property_graph(chunk_files(spark, d), imports(spark, d))
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(g.files, "files").unionAll(count(g.chunks, "chunks")).unionAll(count(g.contains, "contains")).unionAll(count(g.imports, "imports"))


@R.add(f"""
WITH c AS (SELECT id, file_path AS file FROM {ONE}), w AS (SELECT id, file FROM c WHERE id IN (SELECT unnest(chunk_ids) FROM findings WHERE upper(severity) = 'CRITICAL')), n AS {AROUND},
h AS (SELECT w.id, next AS file FROM w JOIN n USING (file)), h2 AS (SELECT id, file FROM h UNION SELECT h.id, next FROM h JOIN n USING (file)),
r AS (SELECT h2.id, c.id AS neighbour FROM h2 JOIN c USING (file) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.id = h2.id AND w.file = h2.file))
SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY neighbour) AS place, count(*) OVER (PARTITION BY id) AS neighbours FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY neighbour) <= 20
""")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    """JOI18: up to twenty chunks near each chunk with a critical finding."""
    wanted = table(spark, d, "findings").where("upper(severity) = 'CRITICAL'").select(F.explode("chunk_ids").alias("id")).distinct()
    return knowledge.context(chunk_files(spark, d), imports(spark, d), wanted)


@R.add("""
WITH c AS (SELECT id, max(sha256(file_path || '::' || code)) AS hash FROM chunks GROUP BY id HAVING hash IS NOT NULL), s AS (SELECT chunk_id AS id, max(hash) AS hash FROM vectors WHERE chunk_id IS NOT NULL GROUP BY 1)
SELECT c.id, c.hash FROM c
""")
def sync_state(spark: SparkSession, d: str) -> DataFrame:
    """GRV8: what is stored after the stored vectors were brought in step with the chunks."""
    current = table(spark, d, "chunks").select("id", X.content_hash(F.col("file_path"), F.col("code")).alias("hash")).where("hash is not null").groupBy("id").agg(F.max("hash").alias("hash"))
    stored = table(spark, d, "vectors").where("chunk_id is not null").groupBy(F.col("chunk_id").alias("id")).agg(F.max("hash").alias("hash"))
    return knowledge.sync(stored, current)[0]


@R.add(f"SELECT dst AS file_path, count(*) AS n FROM {EDGES} GROUP BY dst ORDER BY n DESC, dst LIMIT 20")
def knowledge_query(spark: SparkSession, d: str) -> DataFrame:
    """GRV12: one of the canned queries by its name."""
    return knowledge.KnowledgeGraph(table(spark, d, "chunks"), imports(spark, d)).query("most_imported_files", 20)


STRUCTURAL = f"regexp_matches(lower(concat_ws(' ', category, description)), {literal(cards.STRUCTURAL)})"


@R.add(f"""
WITH f AS (SELECT id, category, description, chunk_ids[1] AS chunk, greatest(coalesce(end_line, start_line) - start_line + 1, 1) AS span FROM {LATEST}), c AS (SELECT DISTINCT id AS chunk, len(string_split(code, chr(10))) AS lines FROM chunks WHERE code IS NOT NULL)
SELECT CASE WHEN lines > 100 THEN 'bypass' WHEN lines > 50 AND {STRUCTURAL} THEN 'architectural' WHEN span <= 30 THEN 'windowed' WHEN lines <= 60 THEN 'full' ELSE 'truncated' END AS strategy, count(*) AS n FROM f JOIN c USING (chunk) GROUP BY 1
""")
def fix_strategies(spark: SparkSession, d: str) -> DataFrame:
    """RUL9: how fixes would be asked for, by number of findings."""
    span = F.greatest(F.coalesce("end_line", "start_line") - F.col("start_line") + 1, F.lit(1))
    found = latest_findings(spark, d, "category", "description", F.get("chunk_ids", F.lit(0)).alias("chunk"), span.alias("span"))
    sizes = table(spark, d, "chunks").where("code is not null").select(F.col("id").alias("chunk"), F.size(X.code_lines(F.col("code"))).alias("lines")).distinct()
    made = cards.strategy(F.col("lines"), F.col("span"), F.col("category"), F.col("description"))
    return found.join(sizes, "chunk").groupBy(made.alias("strategy")).agg(F.count("*").alias("n"))


@R.add(f"""
SELECT id, CASE WHEN agent_id = 'security' AND code_snippet IS NOT NULL AND description IS NOT NULL THEN description ELSE format('{{}} ({{}}, {{}}) at {{}}', coalesce(title, ''), coalesce(category, ''), coalesce(severity, 'MEDIUM'), concat_ws(':', file_path, start_line)) END AS explanation,
  CASE WHEN agent_id = 'security' THEN coalesce(code_snippet, '') ELSE '' END AS fixed_code, NOT (coalesce(agent_id = 'security', false) AND code_snippet IS NOT NULL AND description IS NOT NULL) AS fallback
FROM {LATEST} WHERE coalesce(critique_verdict, 'PLAUSIBLE') <> 'DISPUTED'
""")
def finding_cards(spark: SparkSession, d: str) -> DataFrame:
    """JOI15-16, RUL14: a card for each finding that isn't disputed: made ones for security (their description and snippet), the template for others; a made card of an unknown finding is dropped."""
    found = latest_findings(spark, d, "agent_id", "description", "code_snippet", "category", "title", "severity", "file_path", "start_line", "critique_verdict", "critique_reason")
    verdicts = found.where("critique_verdict is not null").select(F.col("id").alias("finding"), F.col("critique_verdict").alias("verdict"), F.col("critique_reason").alias("reason"))
    made = found.where("agent_id = 'security' and code_snippet is not null").select("id", F.col("description").alias("explanation"), F.col("code_snippet").alias("fixed_code"))
    unknown = spark.range(1).select(F.lit("no such finding").alias("id"), F.lit("x").alias("explanation"), F.lit("y").alias("fixed_code"))
    return cards.cards(cards.with_verdicts(found, verdicts), made.unionAll(unknown))


@R.add(GREEDY + f"""SELECT l.agent_id AS agent, count(*) AS matched, round(avg(coalesce((upper(l.severity) = k.severity)::INT, 0)), 4) AS accuracy FROM tp JOIN {LATEST} l ON l.id = tp.finding
JOIN (SELECT md5(concat_ws('|', name, file_path, rule_id, line, commit_hash)) AS vulnerability, max(upper(severity)) AS severity FROM known_vulnerabilities WHERE line IS NOT NULL GROUP BY 1) k ON k.vulnerability = tp.vulnerability GROUP BY 1""")
def severity_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """JOI13: by agent, the share of matched findings that have the vulnerability's severity."""
    from codelode.operators import evaluation

    tp = evaluation.match(found_rows(spark, d), true_rows(spark, d)).where("class = 'TP'").select("finding", "vulnerability")
    said = latest_findings(spark, d, "agent_id", F.upper("severity").alias("said")).withColumnRenamed("id", "finding")
    vulnerable = table(spark, d, "known_vulnerabilities").where("line is not null")
    key = F.md5(F.concat_ws("|", "name", "file_path", "rule_id", F.col("line").cast("string"), "commit_hash"))
    true = vulnerable.groupBy(key.alias("vulnerability")).agg(F.max(F.upper("severity")).alias("true"))
    joined = tp.join(said, "finding").join(true, "vulnerability")
    return joined.groupBy(F.col("agent_id").alias("agent")).agg(F.count("*").alias("matched"), F.round(F.avg(F.coalesce((F.col("said") == F.col("true")).cast("double"), F.lit(0.0))), 4).alias("accuracy"))


@R.add("""
WITH split AS (SELECT DISTINCT id, string_split(code, chr(10)) AS l FROM chunks WHERE code IS NOT NULL), lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM split),
m AS (SELECT DISTINCT id, line_no FROM lines WHERE regexp_matches(line, 'catch [(]err[)]'))
SELECT id, count(*) AS lines FROM (SELECT DISTINCT l.id, l.line_no FROM lines l JOIN m ON l.id = m.id AND l.line_no BETWEEN m.line_no - 2 AND m.line_no + 2) GROUP BY id
""")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    """WIN8: lines within two of a catch, by chunk: a running frame over each chunk's lines."""
    from pyspark.sql import Window

    from codelode.operators import rules

    rows = rules.lines(table(spark, d, "chunks").where(F.col("code").rlike("catch [(]err[)]"))).withColumn("hit", F.col("line").rlike("catch [(]err[)]"))
    near = F.max("hit").over(Window.partitionBy("row", "id").orderBy("line_no").rowsBetween(-2, 2))
    return rows.drop("line").withColumn("near", near).where("near").groupBy("row", "id").agg(F.count("*").alias("lines")).drop("row").distinct()
