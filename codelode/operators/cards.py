"""Findings with verdicts and explanations, and how a fix for each would be asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import normal_verdict

# What a finding must be about to call for a redesign, and what is then advised.
HINTS = (
    ("complex", "Extract the branches of long conditionals into named functions; replace long switches by a map of handlers."),
    ("god|large|long", "Divide the file by responsibility; keep one reason to change for each part."),
    ("coupl|circular|depend", "Depend on interfaces and turn the direction of the import around."),
    ("duplicat", "Move what is repeated into one shared function."),
)
STRUCTURAL = "|".join(p for p, _ in HINTS) + "|architect|refactor|structur"


def with_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JOI15: findings (id) with verdict and reason; those without one are PLAUSIBLE.

    verdicts: finding, verdict, reason, one row for each finding.
    """
    v = verdicts.select(F.col("finding").alias("id"), "verdict", "reason")
    return findings.join(v, "id", "left").withColumn("verdict", normal_verdict(F.col("verdict"))).withColumn("reason", F.coalesce("reason", F.lit("")))


def strategy(lines: Column, span: Column, category: Column, description: Column) -> Column:
    """RUL9: bypass above 100 lines, redesign above 50 if the finding is structural, else a window around a short span, the whole up to 60 lines, or its first 60."""
    structural = F.lower(F.concat_ws(" ", category, description)).rlike(STRUCTURAL)
    return F.when(lines > 100, "bypass").when((lines > 50) & structural, "architectural").when(span <= 30, "windowed").when(lines <= 60, "full").otherwise("truncated")


def advice(category: Column, description: Column) -> Column:
    """SCL24: the hints that fit a finding, one a line; empty if none does."""
    about = F.lower(F.concat_ws(" ", category, description))
    return F.concat_ws("\n", *(F.when(about.rlike(p), F.lit(f"- {hint}")) for p, hint in HINTS))


def cards(findings: DataFrame, made: DataFrame) -> DataFrame:
    """JOI16, RUL14, HLP16: each finding that isn't disputed with its card, or one from a template.

    findings: id, category, title, severity, file_path, start_line, verdict; made: id, explanation, fixed_code.
    Cards of unknown findings are dropped.
    """
    kept = findings.where("verdict <> 'DISPUTED'").join(made.select("id", "explanation", "fixed_code").dropDuplicates(["id"]), "id", "left")
    where = F.concat_ws(":", "file_path", F.col("start_line").cast("string"))
    template = F.format_string("%s (%s, %s) at %s", F.coalesce("title", F.lit("")), F.coalesce("category", F.lit("")), F.coalesce("severity", F.lit("MEDIUM")), where)
    return kept.select("id", F.coalesce("explanation", template).alias("explanation"), F.coalesce("fixed_code", F.lit("")).alias("fixed_code"), F.col("explanation").isNull().alias("fallback"))


def targets(findings: DataFrame, plan: DataFrame, most: int = 3) -> DataFrame:
    """RUL16: (agent, chunk) to look at again: chunks of disputed findings, else the first of the plan.

    findings: agent, chunk_ids, verdict; plan: agent, chunk, place.
    """
    disputed = findings.where("verdict = 'DISPUTED'").select("agent", F.explode("chunk_ids").alias("chunk")).distinct()
    others = plan.join(disputed.select("agent").distinct(), "agent", "left_anti").where(F.col("place") <= most).select("agent", "chunk")
    return disputed.unionAll(others)
