"""Queries of scalar functions: ids, paths, languages, entropy, windows, keywords, embedding texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.plans.registry import Registry, literal
from codelode.session import sent_if_small, spread
from codelode.sources.tables import table

R = Registry()
IDS = "(SELECT DISTINCT id, file_path, start_line, code FROM chunks)"
RELATIVE = f"replace(regexp_replace(file_path, {literal(X.JOB_ROOT)}, ''), chr(92), '/')"
JOB = f"coalesce(nullif(regexp_extract(file_path, {literal(X.JOB_ROOT)}, 1), ''), nullif(regexp_extract(file_path, {literal(X.JOB_ROOT)}, 2), ''))"
LANGUAGE = (
    "coalesce(CASE lower(regexp_extract(file_path, '[.]([^./\\\\]*)$', 1)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items())
    + " END, 'typescript')"
)


@R.add(f"SELECT id, substring(sha256(file_path || ':' || start_line || ':' || code), 1, 16) AS chunk_id, sha256(file_path || '::' || code) AS hash FROM {IDS}")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """SCL1-2 over all chunks, once for each id."""
    rows = table(spark, d, "chunks").select("id", X.chunk_id(F.col("file_path"), F.col("start_line"), F.col("code")).alias("chunk_id"), X.content_hash(F.col("file_path"), F.col("code")).alias("hash"))
    return rows.distinct()


@R.add(f"""
WITH files AS (SELECT {JOB} AS job, {LANGUAGE} AS language, sum(length(code))::BIGINT AS chars FROM {IDS} WHERE file_path IS NOT NULL AND code IS NOT NULL GROUP BY 1, 2)
SELECT job, language, chars, round(100.0 * chars / sum(chars) OVER (PARTITION BY job), 2) AS share,
  row_number() OVER (PARTITION BY job ORDER BY chars DESC, language) = 1 AS main FROM files
""")
def language_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """SRC5, AGG15: characters by language of every job, their share and the main language."""
    chunks = table(spark, d, "chunks").where("file_path is not null and code is not null")
    ids = chunks.select("id", X.job_of(F.col("file_path")).alias("job"), X.language(F.col("file_path")).alias("language"), F.length("code").alias("n")).distinct()
    sums = ids.groupBy("job", "language").agg(F.sum("n").cast("long").alias("chars"))
    of_job = Window.partitionBy("job")
    first = F.row_number().over(of_job.orderBy(F.col("chars").desc(), "language")) == 1
    return sums.select("job", "language", "chars", F.round(100.0 * F.col("chars") / F.sum("chars").over(of_job), 2).alias("share"), first.alias("main"))


@R.add(f"SELECT DISTINCT file_path, {RELATIVE} AS relative, {JOB} AS job, {LANGUAGE} AS language FROM chunks WHERE file_path IS NOT NULL")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """SCL19, T2: every file with its path in the repository, its job and language."""
    path = F.col("file_path")
    files = table(spark, d, "chunks").where("file_path is not null").select("file_path").distinct()
    return files.select("file_path", X.relative_path(path).alias("relative"), X.job_of(path).alias("job"), X.language(path).alias("language"))


@R.add("""
SELECT CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'LOW') THEN upper(severity) ELSE 'MEDIUM' END AS severity, count(*) AS n FROM findings GROUP BY 1
""")
def severity_normalise(spark: SparkSession, d: str) -> DataFrame:
    """SRC7 over findings."""
    return table(spark, d, "findings").groupBy(X.normal_severity(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))


PARTS = "string_split(regexp_replace(regexp_replace(replace(file_path, chr(92), '/'), '^[.]/', ''), '^/', ''), '/')"
NORMAL = f"""lower(array_to_string(list_reduce(list_transform({PARTS}, lambda p: [p]),
  lambda seen, x: CASE WHEN x[1] = '..' THEN list_slice(seen, 1, len(seen) - 1) WHEN x[1] = '.' THEN seen ELSE list_concat(seen, x) END, []::VARCHAR[]), '/'))"""


@R.add(f"SELECT DISTINCT file_path, {NORMAL} AS path, {NORMAL} || '::' || regexp_replace(lower(rule_id), '[_ ]', '-', 'g') AS signature FROM known_vulnerabilities")
def normalised_paths(spark: SparkSession, d: str) -> DataFrame:
    """SCL15-16 over the known vulnerabilities."""
    path = F.col("file_path")
    rows = table(spark, d, "known_vulnerabilities").select("file_path", X.normal_path(path).alias("path"), X.signature_key(path, F.col("rule_id")).alias("signature"))
    return rows.distinct()


@R.add("""
WITH chars AS (SELECT item_id, length(passage) AS n, unnest(string_split(passage, '')) AS c FROM eval_items WHERE passage IS NOT NULL AND passage <> ''),
counts AS (SELECT item_id, n, c, count(*) AS k FROM chars GROUP BY 1, 2, 3)
SELECT item_id, round(-sum(k * 1.0 / n * log2(k * 1.0 / n)), 6) AS bits FROM counts GROUP BY item_id
""")
def text_entropy(spark: SparkSession, d: str) -> DataFrame:
    """SCL10: bits a character of the evaluation passages; ``document_entropy`` grows with the data."""
    items = table(spark, d, "eval_items").where("passage <> ''")
    return items.select("item_id", F.round(X.entropy(F.col("passage")), 6).alias("bits"))


@R.add()
def document_entropy(spark: SparkSession, d: str) -> DataFrame:
    """SCL10: bits a character of every document's whole text; null and empty texts have none."""
    documents = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text"))
    return documents.select("doc_id", F.round(X.entropy(F.col("text")), 6).alias("bits"))


@R.add("""
WITH ids AS (SELECT DISTINCT id, description FROM findings),
words AS (SELECT id, list_filter(list_transform(string_split_regex(lower(description), '[ \\t\\r\\n]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')),
  lambda w: length(w) > 2 AND NOT list_contains([""" + ", ".join(literal(w) for w in X.STOP_WORDS) + """], w)) AS w FROM ids)
SELECT id, array_to_string(w, ' ') AS keywords, len(w)::BIGINT AS n FROM words
""")
def claim_keywords(spark: SparkSession, d: str) -> DataFrame:
    """SCL23 over the findings' descriptions."""
    words = X.keywords(F.col("description"))
    return table(spark, d, "findings").select("id", F.array_join(words, " ").alias("keywords"), F.size(words).cast("long").alias("n")).distinct()


@R.add("""
SELECT DISTINCT id, md5('File: ' || coalesce(file_path, '') || chr(10) || 'Lines ' || coalesce(start_line::VARCHAR, '') || '-' || coalesce(end_line::VARCHAR, '') || chr(10)
  || 'Complexity: ' || coalesce(cyclomatic_complexity::VARCHAR, '') || ', Halstead: ' || coalesce(halstead_volume::VARCHAR, '') || chr(10)
  || CASE WHEN coalesce(len(smells), 0) = 0 THEN 'No code smells.' ELSE 'Code smells: ' || array_to_string(list_transform(smells, lambda s: s.type), ', ') || '.' END || chr(10) || chr(10) || coalesce(code, '')) AS text_md5
FROM chunks
""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """SCL11 over all chunks, hashed."""
    made = X.embedding_text(*(F.col(c) for c in ("file_path", "start_line", "end_line", "cyclomatic_complexity", "halstead_volume", "smells", "code")))
    return table(spark, d, "chunks").select("id", F.md5(made).alias("text_md5")).distinct()


@R.add("""
SELECT event, CASE WHEN split_part(event, ':', 1) = 'agent' THEN name || ' Agent' ELSE name END AS node, stage, n FROM (
  SELECT event, upper(substring(nullif(split_part(event, ':', 2), ''), 1, 1)) || substring(split_part(event, ':', 2), 2) AS name,
    CASE """ + " ".join(f"WHEN contains(event, '{s}') THEN '{s}'" for s in X.STAGES) + """ END AS stage, count(*) AS n
  FROM progress WHERE event IS NOT NULL GROUP BY event)
""")
def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SCL33-34 over the progress events."""
    events = table(spark, d, "progress").where("event is not null").groupBy("event").agg(F.count("*").alias("n"))
    return events.select("event", X.node_name(F.col("event")).alias("node"), X.active_node(F.col("event")).alias("stage"), "n")


@R.add("""
WITH f AS (SELECT DISTINCT id, start_line AS a, coalesce(end_line, start_line) AS b, unnest(chunk_ids) AS chunk FROM findings),
c AS (SELECT DISTINCT id AS chunk, coalesce(start_line, 1) AS s, string_split(code, chr(10)) AS lines FROM chunks WHERE code IS NOT NULL),
w AS (SELECT f.id, f.chunk, lines, s, greatest(greatest(a - s, 0) - 5, 0) AS x, least(least(b - s, len(lines) - 1) + 5, len(lines) - 1) AS y, len(lines) - 1 AS last FROM f JOIN c USING (chunk))
SELECT DISTINCT id, chunk, md5(array_to_string(CASE WHEN y >= x THEN list_slice(lines, least(x, last) + 1, least(x, last) + greatest(y - x + 1, 0)) ELSE [] END, chr(10))) AS window_md5, (s + x)::BIGINT AS first_line, (s + y)::BIGINT AS last_line FROM w
""")
def window_extract(spark: SparkSession, d: str) -> DataFrame:
    """SCL22: for each finding and chunk, the cited lines with five around them."""
    findings = table(spark, d, "findings").select("id", F.col("start_line").alias("a"), F.coalesce("end_line", "start_line").alias("b"), F.explode("chunk_ids").alias("chunk")).distinct()
    cited = sent_if_small(findings.select("chunk").distinct())
    chunks = table(spark, d, "chunks").where("code is not null").select(F.col("id").alias("chunk"), F.coalesce("start_line", F.lit(1)).alias("s"), "code").join(cited, "chunk", "left_semi").dropDuplicates(["chunk"])
    text, first, last = X.window(F.col("code"), F.col("s"), F.col("a"), F.col("b"))
    rows = findings.join(chunks, "chunk").select("id", "chunk", F.md5(text).alias("window_md5"), first.cast("long").alias("first_line"), last.cast("long").alias("last_line"))
    return rows.distinct()


@R.add("""
WITH c AS (SELECT DISTINCT id, string_split(code, chr(10)) AS lines FROM chunks WHERE code IS NOT NULL),
m AS (SELECT id, lines, list_position(list_transform(lines, lambda l: regexp_matches(l, 'console[.](log|error|warn|debug)[ ]*[(]')), true) AS p FROM c)
SELECT id, (p - 1)::BIGINT AS line, md5(array_to_string(list_slice(lines, greatest(p - 3, 1), p + 3), chr(10))) AS snippet_md5 FROM m WHERE p > 0
""")
def first_match_line(spark: SparkSession, d: str) -> DataFrame:
    """SCL20-21: the first console call of each chunk and three lines around it."""
    pattern = "console[.](log|error|warn|debug)[ ]*[(]"
    chunks = spread(table(spark, d, "chunks").where(F.col("code").rlike(pattern)).select("id", "code"))
    at = X.first_match(F.col("code"), pattern)
    return chunks.select("id", at.cast("long").alias("line"), F.md5(X.around_match(F.col("code"), pattern, 3)).alias("snippet_md5")).where("line is not null").distinct()


@R.add()
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """SCL14: the 31-hash vectors of the nations' names, four dimensions."""
    return table(spark, d, "nation").select("n_nationkey", F.transform(X.hash_embedding(F.col("n_name"), 4), lambda v: F.round(v, 6)).alias("vector"))


@R.add("SELECT DISTINCT id, CASE WHEN upper(trim(critique_verdict)) IN ('CONFIRMED', 'DISPUTED') THEN upper(trim(critique_verdict)) ELSE 'PLAUSIBLE' END AS verdict, file_path || '::' || category || '::' || start_line AS signature, CASE WHEN length(title) > 30 THEN substring(title, 1, 30) || '…' ELSE title END AS short FROM findings")
def finding_labels(spark: SparkSession, d: str) -> DataFrame:
    """SCL8, SCL18, SCL27: verdict, signature and short title of each finding."""
    signature = F.concat("file_path", F.lit("::"), "category", F.lit("::"), F.col("start_line").cast("string"))
    return table(spark, d, "findings").select("id", X.normal_verdict(F.col("critique_verdict")).alias("verdict"), signature.alias("signature"), X.truncated(F.col("title"), 30).alias("short")).distinct()
