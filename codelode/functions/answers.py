"""Rows from the JSON in free text, as a model or a tool writes it: arrays are found, fields get defaults."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<id: string, category: string, title: string, description: string, severity: string, confidence: string, filePath: string, startLine: int, endLine: int, codeSnippet: string, chunkIds: array<string>>>"
VERDICT = "array<struct<findingId: string, verdict: string, reason: string>>"
REPORT = "struct<totalSourceFiles: int, totalTestFiles: int, mappedTests: int, gaps: array<struct<chunkId: string, filePath: string, riskTier: int>>, summary: string>"


_DECODER = json.JSONDecoder()
_BRACKETS = re.compile(r"[\[\s]+")


def first_array(text: str | None) -> str | None:
    """SCL26: the first JSON array in a text, in a fenced block or not; null if none is whole and valid.

    Every opening bracket is tried until one decodes; a text that is no array is left at its first fault,
    so what follows a bracket in prose isn't read again and again.
    """
    at = text.find("[") if text else -1
    while at >= 0:
        try:
            return text[at : _DECODER.raw_decode(text, at)[1]]
        except ValueError:
            at = text.find("[", at + 1)
        except RecursionError:  # of brackets in a row, those further in than this are tried again
            at = text.find("[", max(at + 1, _BRACKETS.match(text, at).end() - 500))
    return None


def json_array(text: Column) -> Column:
    """SCL26 as a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_array)

    return F.pandas_udf(run, "string")(text)


def findings_in(answers: DataFrame, text: str, *keep: str) -> DataFrame:
    """SCL28: the findings in each answer; missing severity is MEDIUM, confidence LOW, text empty, lines 0."""
    rows = answers.select(*keep, F.explode(F.from_json(json_array(F.col(text)), FINDING)).alias("f"))
    empty = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c)
    return rows.select(
        *keep, F.col("f.id").alias("id"), *(empty(c) for c in ("category", "title", "description", "filePath", "codeSnippet")), F.coalesce("f.severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("f.confidence", F.lit("LOW")).alias("confidence"), *(F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("startLine", "endLine")), F.coalesce("f.chunkIds", F.array().cast("array<string>")).alias("chunkIds"),
    )


def verdicts_in(answers: DataFrame, text: str) -> DataFrame:
    """SCL29: (finding, verdict, reason) of each answer, the last of a finding; unknown verdicts are PLAUSIBLE."""
    from codelode.functions.text import normal_verdict

    rows = answers.select(F.posexplode(F.from_json(json_array(F.col(text)), VERDICT)).alias("place", "v")).where("v.findingId is not null")
    last = rows.groupBy("v.findingId").agg(F.max_by(F.struct("v.verdict", "v.reason"), "place").alias("v"))
    return last.select(F.col("findingId").alias("finding"), normal_verdict(F.col("v.verdict")).alias("verdict"), F.coalesce("v.reason", F.lit("")).alias("reason"))


def report_in(text: Column) -> Column:
    """SCL30: a coverage report with defaults; null if it has no list of gaps."""
    r = F.from_json(text, REPORT)
    number = lambda c: F.coalesce(r[c], F.lit(0)).alias(c)
    whole = F.struct(number("totalSourceFiles"), number("totalTestFiles"), number("mappedTests"), r["gaps"].alias("gaps"), F.coalesce(r["summary"], F.lit("")).alias("summary"))
    return F.when(r["gaps"].isNotNull(), whole)
