"""Queries that score findings against the known vulnerabilities and follow scores over days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import evaluation
from codelode.plans.findings import LATEST, latest_findings
from codelode.plans.registry import Registry, literal
from codelode.plans.scalars import NORMAL
from codelode.sources.tables import table

R = Registry()
#: Findings name files by their place on disk, truths by their place in the repository.
ON_DISK = "lower(replace(regexp_replace(file_path, " + literal(X.JOB_ROOT) + ", ''), chr(92), '/'))"
F_SQL = f"(SELECT id AS finding, agent_id AS agent, {ON_DISK} || '::' || regexp_replace(lower(category), '[_ ]', '-', 'g') AS signature, start_line::BIGINT AS line, received_at AS place FROM {LATEST} WHERE file_path IS NOT NULL AND category IS NOT NULL AND start_line IS NOT NULL)"
T_SQL = f"(SELECT DISTINCT {NORMAL} || '::' || regexp_replace(lower(rule_id), '[_ ]', '-', 'g') AS signature, line::BIGINT AS line, md5(concat_ws('|', name, file_path, rule_id, line, commit_hash)) AS vulnerability, coalesce(expected_agent, 'security') AS agent FROM known_vulnerabilities WHERE line IS NOT NULL)"


def found_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_findings(spark, d, "agent_id", "file_path", "category", "start_line", F.col("received_at").alias("place")).where("file_path is not null and category is not null and start_line is not null")
    signature = F.concat(F.lower(X.relative_path(F.col("file_path"))), F.lit("::"), F.regexp_replace(F.lower("category"), "[_ ]", "-"))
    return rows.select(F.col("id").alias("finding"), F.col("agent_id").alias("agent"), signature.alias("signature"), F.col("start_line").cast("long").alias("line"), "place")


def true_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "known_vulnerabilities").where("line is not null")
    key = F.md5(F.concat_ws("|", "name", "file_path", "rule_id", F.col("line").cast("string"), "commit_hash"))
    return rows.select(X.signature_key(F.col("file_path"), F.col("rule_id")).alias("signature"), F.col("line").cast("long").alias("line"), key.alias("vulnerability"), F.coalesce("expected_agent", F.lit("security")).alias("agent")).distinct()


@R.add(f"SELECT finding, vulnerability, signature, abs(f.line - t.line) AS delta FROM {F_SQL} f JOIN {T_SQL} t USING (signature) WHERE abs(f.line - t.line) <= 3")
def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    """JOI11: findings and vulnerabilities of one signature at most three lines apart."""
    return evaluation.candidates(found_rows(spark, d), true_rows(spark, d)).distinct()


GREEDY = f"""
WITH RECURSIVE f AS {F_SQL}, t AS {T_SQL},
near AS (SELECT f.finding, min(place) AS place, list({{'v': vulnerability, 'd': abs(f.line - t.line)}} ORDER BY abs(f.line - t.line), vulnerability) AS l FROM f JOIN t USING (signature) WHERE abs(f.line - t.line) <= 3 GROUP BY f.finding),
s AS (SELECT *, row_number() OVER (ORDER BY place, finding) AS n FROM near),
g AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS finding, [NULL::STRUCT(v VARCHAR, d BIGINT)] AS pick, []::VARCHAR[] AS taken
  UNION ALL SELECT s.n, s.finding, list_filter(l, lambda x: NOT list_contains(taken, x.v))[1:1], list_concat(taken, list_transform(list_filter(l, lambda x: NOT list_contains(taken, x.v))[1:1], lambda x: x.v)) FROM g JOIN s ON s.n = g.n + 1),
tp AS (SELECT finding, pick[1].v AS vulnerability, pick[1].d AS delta FROM g WHERE finding IS NOT NULL AND len(pick) > 0),
m AS (SELECT 'TP' AS class, finding, vulnerability, delta FROM tp UNION ALL SELECT 'FP', finding, NULL, NULL FROM f WHERE finding NOT IN (SELECT finding FROM tp) UNION ALL SELECT 'FN', NULL, vulnerability, NULL FROM t WHERE vulnerability NOT IN (SELECT vulnerability FROM tp))
"""
COUNTED = GREEDY + """, b AS (SELECT m.class, f.agent FROM m JOIN f USING (finding) WHERE m.class <> 'FN' UNION ALL SELECT m.class, t.agent FROM m JOIN t ON m.vulnerability = t.vulnerability WHERE m.class = 'FN'),
c AS (SELECT agent, count(*) FILTER (class = 'TP') AS tp, count(*) FILTER (class = 'FP') AS fp, count(*) FILTER (class = 'FN') AS fn FROM b GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM c),
z AS (SELECT agent, tp, fp, fn, floor(p * 10000 + 0.5) / 10000.0 AS precision, floor(q * 10000 + 0.5) / 10000.0 AS recall, floor(coalesce(2 * p * q / nullif(p + q, 0), 0) * 10000 + 0.5) / 10000.0 AS f1 FROM r)
"""


@R.add(GREEDY + "SELECT class, finding, vulnerability, delta FROM m")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """JOI11, STR21: one-to-one matches in the order of arrival, and what is left on both sides."""
    return evaluation.match(found_rows(spark, d), true_rows(spark, d))


@R.add(COUNTED + "SELECT * FROM z")
def agent_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG6: precision, recall and F1 of every agent."""
    found, true = found_rows(spark, d), true_rows(spark, d)
    matched = evaluation.match(found, true)
    by_finding = matched.where("class <> 'FN'").join(found.select("finding", "agent"), "finding").select("class", "agent")
    by_truth = matched.where("class = 'FN'").join(true.select("vulnerability", "agent"), "vulnerability").select("class", "agent")
    of = lambda c: F.count_if(F.col("class") == c)
    counts = by_finding.unionAll(by_truth).groupBy("agent").agg(of("TP").alias("tp"), of("FP").alias("fp"), of("FN").alias("fn"))
    return evaluation.scores(counts)


@R.add(COUNTED + "SELECT " + ", ".join(f"floor(avg({c}) * 10000 + 0.5) / 10000.0 AS {c}" for c in ("precision", "recall", "f1")) + " FROM z")
def macro_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG7-8: the agents' scores on average."""
    return evaluation.macro(agent_scores(spark, d))


VERDICT_COUNTS = f"SELECT agent_id AS agent, count(*) FILTER (critique_verdict = 'CONFIRMED') AS tp, count(*) FILTER (critique_verdict = 'DISPUTED') AS fp, count(*) FILTER (critique_verdict IS NULL) AS fn FROM {LATEST} GROUP BY 1"


@R.add(f"""
WITH c AS ({VERDICT_COUNTS}), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM c)
SELECT agent, tp, fp, fn, floor(p * 10000 + 0.5) / 10000.0 AS precision, floor(q * 10000 + 0.5) / 10000.0 AS recall, floor(coalesce(2 * p * q / nullif(p + q, 0), 0) * 10000 + 0.5) / 10000.0 AS f1 FROM r
""")
def verdict_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG6 on the critique's verdicts: confirmed, disputed and unjudged findings of each agent."""
    verdict = F.col("critique_verdict")
    found = latest_findings(spark, d, F.col("agent_id").alias("agent"), "critique_verdict")
    counts = found.groupBy("agent").agg(F.count_if(verdict == "CONFIRMED").alias("tp"), F.count_if(verdict == "DISPUTED").alias("fp"), F.count_if(verdict.isNull()).alias("fn"))
    return evaluation.scores(counts)


HISTORY = "(SELECT agent_id AS agent, date_trunc('hour', received_at) AS hour, round(avg((critique_verdict = 'CONFIRMED')::int), 4) AS precision FROM findings WHERE critique_verdict IS NOT NULL AND received_at IS NOT NULL GROUP BY 1, 2)"


def history(spark: SparkSession, d: str) -> DataFrame:
    """Share of confirmed among judged findings by agent and hour."""
    judged = table(spark, d, "findings").where("critique_verdict is not null and received_at is not null")
    hour = F.date_trunc("hour", "received_at").alias("hour")
    return judged.groupBy(F.col("agent_id").alias("agent"), hour).agg(F.round(F.avg((F.col("critique_verdict") == "CONFIRMED").cast("double")), 4).alias("precision"))


@R.add(f"SELECT agent, epoch(hour)::BIGINT AS hour, before, precision, delta, level FROM (SELECT agent, hour, lag(precision) OVER w AS before, precision, round(precision - lag(precision) OVER w, 4) AS delta, CASE WHEN round(precision - lag(precision) OVER w, 4) < -0.15 THEN 'CRITICAL' WHEN round(precision - lag(precision) OVER w, 4) < -0.05 THEN 'WARNING' END AS level FROM {HISTORY} WINDOW w AS (PARTITION BY agent ORDER BY hour)) WHERE level IS NOT NULL")
def regressions(spark: SparkSession, d: str) -> DataFrame:
    """WIN5, AGG22: hours in which an agent's precision fell."""
    found = evaluation.regressions(history(spark, d), "agent", "hour", "precision")
    return found.withColumn("hour", F.expr("unix_timestamp(cast(hour as timestamp))"))


@R.add(f"SELECT agent, epoch(hour)::BIGINT AS hour, precision FROM {HISTORY} QUALIFY row_number() OVER (PARTITION BY agent ORDER BY hour DESC) = 1")
def previous_scores(spark: SparkSession, d: str) -> DataFrame:
    """WIN3, T28: the newest score of every agent."""
    return history(spark, d).groupBy("agent").agg(F.expr("unix_timestamp(cast(max(hour) as timestamp))").alias("hour"), F.max_by("precision", "hour").alias("precision"))


@R.add(f"SELECT agent, epoch(hour)::BIGINT AS hour, precision FROM {HISTORY} QUALIFY row_number() OVER (PARTITION BY agent ORDER BY hour DESC) <= 5")
def history_trend(spark: SparkSession, d: str) -> DataFrame:
    """WIN4: the five newest scores of every agent."""
    place = F.row_number().over(Window.partitionBy("agent").orderBy(F.col("hour").desc()))
    rows = history(spark, d).withColumn("place", place).where("place <= 5")
    return rows.select("agent", F.expr("unix_timestamp(cast(hour as timestamp))").alias("hour"), "precision")
