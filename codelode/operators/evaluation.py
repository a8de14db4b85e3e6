"""Scoring findings against known vulnerabilities, and following scores over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as X


def candidates(findings: DataFrame, truth: DataFrame, tolerance: int = 3) -> DataFrame:
    """JOI11: (finding, vulnerability, delta) that could match: same signature, lines at most so far apart.

    findings: finding, signature, line; truth: vulnerability, signature, line. The range condition is an
    equi join on blocks of lines: a vulnerability meets the finding's block and its neighbours only, so one
    signature with very many lines doesn't pair them all.
    """
    width = max(1, tolerance)
    block = lambda c: F.floor(F.col(c) / width)
    f = findings.select("finding", "signature", F.col("line").alias("a"), block("line").alias("block"))
    t = truth.select("vulnerability", "signature", F.col("line").alias("b"), F.explode(F.array(block("line") - 1, block("line"), block("line") + 1)).alias("block"))
    delta = F.abs(F.col("a") - F.col("b"))
    return f.join(t, ["signature", "block"]).where(delta <= tolerance).select("finding", "vulnerability", "signature", delta.cast("long").alias("delta"))


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    taken: set = set()
    found = []
    for finding, group in rows.sort_values(["place", "finding", "delta", "vulnerability"]).groupby(["place", "finding"], sort=True):
        free = group[~group["vulnerability"].isin(taken)]
        if len(free):
            best = free.iloc[0]
            taken.add(best["vulnerability"])
            found.append((best["finding"], best["vulnerability"], best["delta"]))
    return pd.DataFrame(found, columns=["finding", "vulnerability", "delta"])


def match(findings: DataFrame, truth: DataFrame, tolerance: int = 3) -> DataFrame:
    """JOI11: (class, finding, vulnerability, delta): TP pairs one to one, FP findings, FN vulnerabilities.

    Findings choose in the order of ``place``, each the nearest vulnerability left, ties the smaller
    number. Pairs without any rival are matched as they are; only the others enter the ordered step,
    grouped by signature and by runs of candidates that touch, since choices in one run can't touch another.
    """
    close = candidates(findings, truth, tolerance).join(findings.select("finding", "place"), "finding").join(truth.select("vulnerability", F.col("line").alias("at")), "vulnerability")
    by_line = Window.partitionBy("signature").orderBy("at", "vulnerability")
    gap = F.col("at") - F.lag("at", 1, -(10**9)).over(by_line)
    grouped = close.withColumn("gap", (gap > 2 * tolerance).cast("long")).withColumn("run", F.sum("gap").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = {f.name: f.dataType.simpleString() for f in close.schema.fields}
    alone = (F.count("*").over(Window.partitionBy("finding")) == 1) & (F.count("*").over(Window.partitionBy("vulnerability")) == 1)
    marked = grouped.select("signature", "run", "place", "finding", "vulnerability", "delta", alone.alias("alone"))
    contested = marked.where("not alone").groupBy("signature", "run").applyInPandas(
        lambda rows: _greedy(rows), f"finding {kinds['finding']}, vulnerability {kinds['vulnerability']}, delta long"
    )
    pairs = marked.where("alone").select("finding", "vulnerability", "delta").unionAll(contested)
    tp = pairs.select(F.lit("TP").alias("class"), "finding", "vulnerability", "delta")
    none = lambda kind: F.lit(None).cast(kind)
    fp = findings.join(pairs.select("finding"), "finding", "left_anti").select(F.lit("FP"), "finding", none(kinds["vulnerability"]), none("long"))
    fn = truth.join(pairs.select("vulnerability"), "vulnerability", "left_anti").select(F.lit("FN"), none(kinds["finding"]), "vulnerability", none("long"))
    return tp.unionAll(fp).unionAll(fn)


def scores(counts: DataFrame) -> DataFrame:
    """AGG6: agent, tp, fp, fn to precision, recall and F1 in four places; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p = ratio(F.col("tp") * 1.0, F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp") * 1.0, F.col("tp") + F.col("fn"))
    rows = counts.withColumn("p", p).withColumn("r", r).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return rows.select("agent", "tp", "fp", "fn", *(X.round_half_up(F.col(a), 4).alias(b) for a, b in (("p", "precision"), ("r", "recall"), ("f", "f1"))))


def macro(scored: DataFrame) -> DataFrame:
    """AGG7: the mean of the agents' rounded scores, rounded again."""
    return scored.agg(*(X.round_half_up(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in ("precision", "recall", "f1")))


def regressions(history: DataFrame, group: str, order: str, value: str, warning: float = 0.05, critical: float = 0.15) -> DataFrame:
    """WIN5, T27: each drop of a value against the one before in its group, by rounded difference."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    rows = history.withColumn("before", before).withColumn("delta", F.round(F.col(value) - F.col("before"), 4))
    level = F.when(F.col("delta") < -critical, "CRITICAL").when(F.col("delta") < -warning, "WARNING")
    return rows.withColumn("level", level).where("level is not null").select(group, order, F.col("before"), F.col(value), "delta", "level")
