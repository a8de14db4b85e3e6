"""Holding findings against the code they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X


def verify(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """RUL7: (id, chunk_id, agree, disagree, verdict) for each finding and chunk it cites.

    findings: id, chunk_ids, start_line, end_line, code_snippet, claim. chunks: id, start_line (null is
    1), code, one row for each id. Checks: both lines lie in the chunk; the snippet is in its code after
    white space is folded, or three fifths of its words are; half of the claim's keywords are in it. No
    disagreement: CONFIRMED; no more than agreements: PLAUSIBLE; else, and without the chunk: DISPUTED.
    """
    cited = findings.select("id", F.explode("chunk_ids").alias("chunk_id"), "start_line", "end_line", "code_snippet", "claim").distinct()
    code = chunks.where("code is not null").select(F.col("id").alias("chunk_id"), F.coalesce("start_line", F.lit(1)).alias("begin"), "code")
    rows = cited.join(code, "chunk_id", "left")
    size = F.size(X.code_lines(F.col("code")))

    def inside(line: str):
        at = F.col(line) - F.col("begin")
        return F.when(F.col(line).isNotNull(), (at >= 0) & (at < size))

    snippet, whole = X.folded(F.col("code_snippet")), X.folded(F.col("code"))
    words, code_words = F.split(F.lower(snippet), " "), F.split(F.lower(whole), " ")
    known = F.size(F.filter(words, lambda w: F.array_contains(code_words, w)))
    found = F.when(F.col("code_snippet") != "", whole.contains(snippet) | (known / F.size(words) >= 0.6))
    keys = X.keywords(F.col("claim"))
    low = F.lower("code")
    relevant = F.when(F.size(keys) > 0, F.size(F.filter(keys, lambda k: F.contains(low, k))) / F.size(keys) >= 0.5)
    checks = F.array(inside("start_line"), inside("end_line"), found, relevant)
    counted = rows.select("id", "chunk_id", F.col("code").isNotNull().alias("known"), F.size(F.filter(checks, lambda c: c)).alias("agree"), F.size(F.filter(checks, lambda c: ~c)).alias("disagree"))
    verdict = F.when(~F.col("known"), "DISPUTED").when(F.col("disagree") == 0, "CONFIRMED").when(F.col("disagree") <= F.col("agree"), "PLAUSIBLE").otherwise("DISPUTED")
    count = lambda c: F.when(F.col("known"), F.col(c)).otherwise(0).cast("long").alias(c)
    return counted.select("id", "chunk_id", count("agree"), count("disagree"), verdict.alias("verdict"))


def relevant_evidence(evidence, chunk_ids, path, category, title):
    """SCL31, JOI19: the evidence that mentions a chunk id or the path in its input, or path, category or title in its output; all of it if none does."""
    low = F.lower

    def fits(e):
        named = F.exists(chunk_ids, lambda c: low(e["input"]).contains(low(c)))
        in_path = low(e["input"]).contains(low(path)) | low(e["output"]).contains(low(path))
        return F.coalesce(named, F.lit(False)) | F.coalesce(in_path, F.lit(False)) | F.coalesce(low(e["output"]).contains(low(category)), F.lit(False)) | F.coalesce(low(e["output"]).contains(low(title)), F.lit(False))

    kept = F.filter(evidence, fits)
    return F.when(F.size(kept) > 0, kept).otherwise(evidence)
