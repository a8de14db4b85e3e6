"""The whole analysis of a repository: files to functions, graph, findings and report, lazily."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import cards, coverage, evaluation, graph, knowledge, rules, verify
from codelode.session import cut
from codelode.sources import javascript, repository


@dataclass
class Analysis:
    """What is known about one repository; every member is a DataFrame."""

    files: DataFrame
    languages: DataFrame
    chunks: DataFrame
    imports: DataFrame
    errors: DataFrame
    findings: DataFrame
    verdicts: DataFrame
    gaps: DataFrame
    report: DataFrame


def _scanned(chunks: DataFrame) -> DataFrame:
    """The rules' findings of some chunks, each with the id that follows from its place and rule."""
    hits = rules.scan_chunks(chunks, rules.CHUNK_RULES).withColumn("agent_id", F.lit("security")).unionAll(rules.scan_chunks(chunks, rules.PERFORMANCE_RULES).withColumn("agent_id", F.lit("performance")))
    return hits.select(
        X.chunk_id(F.col("file_path"), F.col("line"), F.col("rule")).alias("id"), "agent_id", F.col("rule").alias("category"), "severity", "file_path", F.col("line").alias("start_line"), F.col("last_line").alias("end_line"), F.array("id").alias("chunk_ids")
    )


def _verified(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    cited = findings.select("id", "chunk_ids", "start_line", "end_line", F.lit(None).cast("string").alias("code_snippet"), F.lit("").alias("claim"))
    return verify.verify(cited, chunks.select("id", "start_line", "code").dropDuplicates(["id"]))


def analyze(spark: SparkSession, root: str, ignore: list[str] | None = None, reviews: int = 2, threshold: float = 0.6) -> Analysis:
    """SRC8, STR7, STR10-20: reads, parses, scans, verifies and sums up the repository under a folder.

    Files and chunks are written once, since many of the results read them; all else is lazy. Paths stay
    relative to the repository, so that two analyses can be compared (T2). Findings are the rules' own,
    each verified against its chunk by the rule's words (T20); what can't be parsed is in ``errors``.
    While more than ``threshold`` of the verdicts dispute, up to ``reviews`` times, the chunks of disputed
    findings are scanned anew and their findings replaced (STR10).
    """
    files = cut(repository.read_files(spark, root, ignore))
    parsed = cut(javascript.parse(files))
    errors = parsed.where("error is not null").select("path", "error")
    whole = parsed.where("error is null")
    chunks = whole.select(
        X.chunk_id(F.col("path"), F.col("start_line"), F.col("code")).alias("id"), "code", F.col("path").alias("file_path"), "start_line", "end_line", "imports", "name",
        F.col("complexity").alias("cyclomatic_complexity"), F.col("volume").alias("halstead_volume"), "smells",
    )
    raw = whole.select("path", F.explode("imports").alias("spec")).distinct()
    edges = graph.edges(javascript.resolve(raw, files.select("path")))
    findings = cut(_scanned(chunks))
    verdicts = cut(_verified(findings, chunks))
    planned = knowledge.plan(chunks.select("id", "file_path", "cyclomatic_complexity", "smells").dropDuplicates(["id"]))
    for _ in range(reviews):
        share = verdicts.agg(F.coalesce(F.avg((F.col("verdict") == "DISPUTED").cast("double")), F.lit(0.0))).first()[0]
        if share <= threshold:
            break
        # STR10: what is disputed is looked at again, agents without any look at the first of the plan
        judged = findings.join(verdicts.select("id", "verdict").dropDuplicates(["id"]), "id").select(F.col("agent_id").alias("agent"), "chunk_ids", "verdict")
        again = cards.targets(judged, planned)
        fresh = _scanned(chunks.join(again.select(F.col("chunk").alias("id")).distinct(), "id", "left_semi")).join(again.select(F.col("agent").alias("agent_id"), F.array("chunk").alias("chunk_ids")).distinct(), ["agent_id", "chunk_ids"], "left_semi")
        disputed = verdicts.where("verdict = 'DISPUTED'").select("id").distinct()
        findings = cut(findings.join(disputed, "id", "left_anti").unionByName(fresh).dropDuplicates(["id"]))
        verdicts = cut(_verified(findings, chunks))
    gaps = coverage.coverage_gaps(chunks.select("id", "file_path", "cyclomatic_complexity").distinct(), coverage.test_edges(edges), findings.where("agent_id = 'security'"))
    counted = findings.join(verdicts.select("id", "verdict"), "id").where("verdict <> 'DISPUTED'")
    n = lambda s: F.count_if(F.col("severity") == s)
    health = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * n("CRITICAL") - 8 * n("HIGH") - 3 * n("MEDIUM") - n("LOW")))
    report = counted.agg(F.count("*").alias("findings"), n("CRITICAL").alias("critical"), n("HIGH").alias("high"), health.alias("health"))
    return Analysis(files, repository.fingerprint(files), chunks, edges, errors, findings, verdicts, gaps, report)


def evaluate(findings: DataFrame, truth: DataFrame, tolerance: int = 3) -> tuple[DataFrame, DataFrame]:
    """STR21-22, WIN9: (scores of every agent, their mean) of findings against a ground truth of one repository.

    findings: id, agent_id, category, file_path, start_line; truth as ``repository.ground_truths`` gives it.
    Findings choose in the order of their ids. The order of the truth is that of file, line and rule.
    """
    key = lambda path, rule: X.signature_key(F.col(path), F.col(rule)).alias("signature")
    f = findings.select(F.col("id").alias("finding"), F.col("agent_id").alias("agent"), key("file_path", "category"), F.col("start_line").cast("long").alias("line"), F.col("id").alias("place"))
    number = F.concat_ws("|", "file_path", F.lpad(F.col("line").cast("string"), 9, "0"), "rule_id")
    t = truth.select(number.alias("vulnerability"), key("file_path", "rule_id"), F.col("line").cast("long").alias("line"), F.col("expected_agent").alias("agent")).dropDuplicates(["vulnerability"])
    matched = cut(evaluation.match(f, t, tolerance))
    by_finding = matched.where("class <> 'FN'").join(f.select("finding", "agent"), "finding").select("class", "agent")
    by_truth = matched.where("class = 'FN'").join(t.select("vulnerability", "agent"), "vulnerability").select("class", "agent")
    of = lambda c: F.count_if(F.col("class") == c)
    scored = evaluation.scores(by_finding.unionAll(by_truth).groupBy("agent").agg(of("TP").alias("tp"), of("FP").alias("fp"), of("FN").alias("fn")))
    return scored, evaluation.macro(scored)
