"""Repositories on disk or in a store, scanner results and ground truths as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import text as X

# What no analysis looks at.
IGNORED = (
    "node_modules/", ".git/", "dist/", "build/", "out/", ".next/", ".nuxt/", ".svelte-kit/", "coverage/", "__pycache__/", ".venv/", "venv/",
    "vendor/", ".idea/", ".vscode/", ".terraform/", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Pipfile.lock",
    "poetry.lock", "Gemfile.lock", "Cargo.lock", "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico",
    "*.svg", "*.webp", "*.bmp", "*.tiff", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.otf", "*.mp3", "*.mp4", "*.avi", "*.mov", "*.zip", "*.tar",
    "*.gz", "*.rar", "*.7z", "*.exe", "*.dll", "*.so", "*.dylib", "*.o", "*.a", "*.class", "*.jar", "*.war", "*.pyc", "*.pyo", "*.wasm", "*.pdf",
    "*.doc", "*.docx", "*.xls", "*.xlsx", "*.ppt", "*.pptx", ".DS_Store", "Thumbs.db", "*.map", "*.d.ts", ".env", ".env.*",
)
MOST_BYTES = 1_048_576


def pattern_of(rule: str) -> tuple[str, bool]:
    """A gitignore rule as (regular expression over relative paths, whether it takes back)."""
    back = rule.startswith("!")
    body = rule[back:].rstrip()
    folder, body = body.endswith("/"), body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    parts = re.split(r"(\*\*/|/\*\*|\*|\?)", body)
    made = "".join({"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
    return ("^" if anchored else "(?:^|/)") + made + ("/" if folder else "(?:/|$)"), back


def ignored(path: Column, rules: list[str] | tuple[str, ...] = tuple(IGNORED)) -> Column:
    """SRC2-3: whether the last rule that matches a relative path ignores it."""
    found = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern, back = pattern_of(rule)
            found = F.when(path.rlike(pattern), F.lit(not back)).otherwise(found)
    return found


def read_files(spark: SparkSession, root: str, rules: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """SRC1, SRC4: (path, bytes, code) of the files under a folder that no rule ignores and that are at most so large.

    Paths are relative to the root. Size is filtered before any content is read. Bytes that are no
    UTF-8 are replaced. ``rules`` come after the fixed ones, so they can take those back.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(F.col("length") <= most)
    path = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)) + "/", "")
    rows = found.select(path.alias("path"), F.col("length").alias("bytes"), "content").where(~ignored(F.col("path"), [*IGNORED, *(rules or [])]))
    return rows.select("path", "bytes", F.try_validate_utf8(F.expr("cast(content as string)")).alias("code"))


def fingerprint(files: DataFrame) -> DataFrame:
    """SRC5, AGG15: (language, bytes, share, main) of files with path and bytes."""
    sums = files.groupBy(X.language(F.col("path")).alias("language")).agg(F.sum("bytes").alias("bytes"))
    everything = Window.partitionBy(F.lit(1))  # over one row for each language
    place = F.row_number().over(everything.orderBy(F.col("bytes").desc(), "language"))
    return sums.select("language", "bytes", F.round(100 * F.col("bytes") / F.sum("bytes").over(everything), 2).alias("share"), (place == 1).alias("main"))


SCANNER = "results array<struct<packages: array<struct<package: struct<name: string, version: string>, vulnerabilities: array<struct<id: string, summary: string, database_specific: struct<severity: string>>>>>>>"


def dependency_risks(scanned: DataFrame, column: str = "value") -> DataFrame:
    """SRC6-7: (package, version, cve, severity, summary) from a scanner's JSON; broken JSON gives no rows."""
    rows = scanned.select(F.from_json(column, SCANNER).alias("j")).select(F.explode("j.results").alias("r")).select(F.explode("r.packages").alias("p"))
    flat = rows.select("p.package.*", F.explode("p.vulnerabilities").alias("v"))
    return flat.select(F.col("name").alias("package"), "version", F.col("v.id").alias("cve"), X.normal_severity(F.col("v.database_specific.severity")).alias("severity"), F.col("v.summary").alias("summary"))


TRUTH = "name string, repoUrl string, commitHash string, vulnerabilities array<struct<filePath: string, ruleId: string, line: int, severity: string, expectedAgent: string, description: string>>"


def ground_truths(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: the vulnerabilities of a ground-truth file, one row each; entries without name, URL, commit or list are an error."""
    rows = spark.read.schema(TRUTH).option("multiLine", True).option("mode", "FAILFAST").json(path)
    whole = F.col("name").isNotNull() & F.col("repoUrl").isNotNull() & F.col("commitHash").isNotNull() & F.col("vulnerabilities").isNotNull()
    checked = rows.where(F.assert_true(whole, "an entry lacks name, repoUrl, commitHash or vulnerabilities").isNull())
    flat = checked.select("name", F.col("repoUrl").alias("repo_url"), F.col("commitHash").alias("commit_hash"), F.explode_outer("vulnerabilities").alias("v")).where("v is not null")  # an inner explode would drop faulty entries before they are met
    return flat.select(
        "name", "repo_url", "commit_hash", F.col("v.filePath").alias("file_path"), F.col("v.ruleId").alias("rule_id"), F.col("v.line").alias("line"), F.col("v.severity").alias("severity"),
        F.coalesce("v.expectedAgent", F.lit("security")).alias("expected_agent"), F.col("v.description").alias("description"),
    )


def smoke_truth(spark: SparkSession) -> DataFrame:
    """SRC15: three made-up vulnerabilities in the form of ``ground_truths``, to try an evaluation with."""
    rows = [("src/login.js", "sql-injection", 12, "CRITICAL"), ("src/view.js", "xss", 30, "HIGH"), ("src/key.js", "hardcoded-secret", 3, "HIGH")]
    kinds = "name string, repo_url string, commit_hash string, file_path string, rule_id string, line int, severity string, expected_agent string, description string"
    return spark.createDataFrame([("smoke", "https://git.example.test/smoke.git", "HEAD", *r, "security", None) for r in rows], kinds)


def advisories(packages: DataFrame, database: DataFrame, most: int = 10, references: int = 3) -> DataFrame:
    """SRC16: for each package the known advisories by id, at most so many, with so many references.

    packages: package; database: package, cve, severity, summary, links array<string>.
    """
    place = F.row_number().over(Window.partitionBy("package").orderBy("cve"))
    found = packages.select("package").distinct().join(database, "package").withColumn("place", place).where(F.col("place") <= most)
    return found.select("package", "cve", X.normal_severity(F.col("severity")).alias("severity"), "summary", F.slice("links", 1, references).alias("links"))
