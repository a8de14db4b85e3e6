"""Queries that read code: functions, imports, estimates, parts, and which files are read at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import folds
from codelode.plans.registry import Registry, literal
from codelode.plans.scalars import IDS, RELATIVE
from codelode.sources import javascript, repository
from codelode.sources.tables import table

R = Registry()


@R.add()
def parsed_functions(spark: SparkSession, d: str) -> DataFrame:
    """PRS1-16, SRC9-10: the functions in every chunk's code with their metrics."""
    given = table(spark, d, "chunks").where("code is not null and file_path is not null")
    found = javascript.parse(given, "file_path", "code", "start_line", "id").drop("code", "imports")
    return found.select("path", "name", "start_line", "end_line", "params", "depth", "complexity", "volume", "unreachable", F.size("smells").alias("smells"), "error")


@R.add()
def parsed_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG16: functions, mean complexity, smells and unreadable files by language."""
    rows = parsed_functions(spark, d)
    return rows.groupBy(X.language(F.col("path")).alias("language")).agg(F.count("name").alias("functions"), F.round(F.avg("complexity"), 1).alias("mean_complexity"), F.sum("smells").cast("long").alias("smells"), F.count("error").alias("errors"))


#: The braces of a line as steps up and down.
STEPS = "list_transform(list_filter(string_split(regexp_replace({0}, '[^{{}}]', '', 'g'), ''), lambda c: c <> ''), lambda c: CASE WHEN c = '{{' THEN 1 ELSE -1 END)"
FOLDED_LINE = STEPS.format("l")
CLASSES_SQL = f"""
WITH t AS (SELECT id, any_value(code) AS code FROM chunks WHERE code IS NOT NULL GROUP BY id),
u AS (SELECT id, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS k, regexp_replace(unnest(string_split(code, chr(10))), '^\\s+|\\s+$', '', 'g') AS l FROM t),
w AS (SELECT id, k, {FOLDED_LINE} AS steps, regexp_matches(l, {literal(folds.LOOP.pattern)})::INT AS loops, regexp_matches(l, {literal(folds.CONDITION.pattern)})::INT AS conditions FROM u),
x AS (SELECT id, list({{'depth': coalesce(list_sum(steps), 0)::INT, 'least': least(0, coalesce(list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))), 0))::INT, 'deepest': 0, 'loops': loops, 'conditions': conditions, 'open': []::INT[]}} ORDER BY k) AS lines FROM w GROUP BY id),
y AS (SELECT id, list_reduce(lines, lambda s, v: {{
  'depth': s.depth + v.depth, 'least': 0,
  'deepest': CASE WHEN v.loops = 1 THEN greatest(s.deepest, len(list_filter(s.open, lambda o: o < s.depth + v.least))::INT + 1) ELSE s.deepest END,
  'loops': s.loops + v.loops, 'conditions': s.conditions + v.conditions,
  'open': CASE WHEN v.loops = 1 AND v.depth > v.least THEN list_append(list_filter(s.open, lambda o: o < s.depth + v.least), s.depth + v.least) ELSE list_filter(s.open, lambda o: o < s.depth + v.least) END}},
  {{'depth': 0, 'least': 0, 'deepest': 0, 'loops': 0, 'conditions': 0, 'open': []::INT[]}}) AS s FROM x),
n AS (SELECT id, code, coalesce(nullif(regexp_extract(code, {literal(folds.NAMED.pattern)}, 1), ''), nullif(regexp_extract(code, {literal(folds.NAMED.pattern)}, 2), '')) AS name FROM t),
c AS (SELECT id, code, CASE WHEN name IS NULL THEN 0 ELSE len(regexp_extract_all(code, '\\b' || name || '\\s*\\(')) END AS calls FROM n),
f AS (SELECT id, s.deepest AS nesting, s.loops AS loops, s.conditions AS conditions, calls > 1 AS recursion, regexp_matches(code, {literal(folds.SORT.pattern)}) AS sorts,
  CASE WHEN calls > 1 AND (s.deepest >= 1 OR calls > 2) THEN 'O(2^n)' WHEN calls > 1 THEN 'O(n)' WHEN s.deepest = 0 THEN 'O(1)' WHEN s.deepest = 1 THEN 'O(n)' WHEN s.deepest = 2 THEN 'O(n²)' ELSE 'O(n³)' END AS class FROM y JOIN c USING (id))
SELECT id, CASE WHEN sorts AND class IN ('O(1)', 'O(n)') THEN 'O(n log n)' ELSE class END AS class, nesting, loops, conditions, recursion FROM f
"""


@R.add(CLASSES_SQL)
def complexity_classes(spark: SparkSession, d: str) -> DataFrame:
    """RUL3: the estimated class of every chunk."""
    return folds.complexity_classes(table(spark, d, "chunks"))


PARTS_SQL = f"""
WITH t AS (SELECT id, max(code) AS code, max(coalesce(start_line, 1)) AS s, max(coalesce(cyclomatic_complexity, 1)) AS c, max(file_path) AS file_path FROM chunks WHERE length(code) - length(replace(code, chr(10), '')) + 1 > 100 GROUP BY id),
u AS (SELECT id, unnest(range(0, len(string_split(code, chr(10))))) AS k, unnest(string_split(code, chr(10))) AS l FROM t),
x AS (SELECT id, max(k) AS last, list({{'k': k, 'start': 0::BIGINT, 'depth': 0, 'steps': {FOLDED_LINE}, 'cuts': []::BIGINT[]}} ORDER BY k) AS lines FROM u GROUP BY id),
d AS (SELECT id, last, list_reduce(lines[:-2], lambda a, v: CASE WHEN v.k - a.start + 1 >= 100 AND (list_reduce(v.steps, lambda z, y: greatest(z + y, 0), a.depth) <= 1 OR v.k - a.start + 1 >= 150)
  THEN {{'k': v.k, 'start': v.k + 1, 'depth': 0, 'steps': []::INT[], 'cuts': list_append(a.cuts, v.k)}} ELSE {{'k': v.k, 'start': a.start, 'depth': list_reduce(v.steps, lambda z, y: greatest(z + y, 0), a.depth), 'steps': []::INT[], 'cuts': a.cuts}} END,
  {{'k': -1::BIGINT, 'start': 0::BIGINT, 'depth': 0, 'steps': []::INT[], 'cuts': []::BIGINT[]}}).cuts AS cuts FROM x),
e AS (SELECT id, last, list_append(cuts, last) AS ends FROM d),
p AS (SELECT id, last, unnest(range(1, len(ends) + 1)) AS part, unnest(ends) AS b, unnest(list_prepend(0::BIGINT, list_transform(ends[:-2], lambda v: v + 1))) AS a FROM e),
r AS (SELECT p.*, t.s, t.c, t.file_path, array_to_string(string_split(code, chr(10))[a + 1 : b + 1], chr(10)) AS piece FROM p JOIN t USING (id))
SELECT id, part::INTEGER AS part, (s + a)::INTEGER AS first_line, (s + b)::INTEGER AS last_line, greatest(1, floor(c * (b - a + 1) / (last + 1) + 0.5))::INTEGER AS complexity, substring(sha256(file_path || ':' || (s + a)::INTEGER || ':' || piece), 1, 16) AS part_id FROM r
"""


@R.add(PARTS_SQL)
def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    """PRS3: the parts of chunks of more than 100 lines."""
    return folds.split_chunks(table(spark, d, "chunks")).select("id", "part", "first_line", "last_line", "complexity", "part_id")


IGNORED_SQL = "CASE " + " ".join(f"WHEN regexp_matches(relative, {literal(p)}) THEN {str(not back).lower()}" for p, back in (repository.pattern_of(r) for r in reversed(repository.IGNORED))) + " ELSE false END"


@R.add(f"""
WITH f AS (SELECT file_path, {RELATIVE} AS relative, sum(length(code))::BIGINT AS chars FROM {IDS} WHERE file_path IS NOT NULL GROUP BY 1, 2)
SELECT file_path, chars, {IGNORED_SQL} AS ignored FROM f WHERE coalesce(chars, 0) <= 1048576
""")
def eligible_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC2-4: every file up to the size limit, and whether the rules ignore it."""
    ids = table(spark, d, "chunks").where("file_path is not null").select("id", "file_path", F.length("code").cast("long").alias("n")).distinct()
    files = ids.groupBy("file_path").agg(F.sum("n").alias("chars")).where("coalesce(chars, 0) <= 1048576")
    return files.select("file_path", "chars", repository.ignored(X.relative_path(F.col("file_path"))).alias("ignored"))


@R.add("""
WITH raw AS (SELECT DISTINCT file_path AS path, unnest(imports) AS spec FROM chunks WHERE file_path IS NOT NULL)
SELECT spec, count(DISTINCT path) AS files, CASE WHEN starts_with(spec, './') OR starts_with(spec, '../') OR spec IN ('.', '..') THEN 'relative' WHEN starts_with(spec, 'node:') THEN 'builtin' ELSE 'package' END AS kind FROM raw WHERE spec IS NOT NULL GROUP BY spec
""")
def raw_imports(spark: SparkSession, d: str) -> DataFrame:
    """PRS8: what is imported by how many files, and of what kind it is."""
    raw = table(spark, d, "chunks").where("file_path is not null").select(F.col("file_path").alias("path"), F.explode("imports").alias("spec")).where("spec is not null").distinct()
    kind = F.when(F.col("spec").startswith("./") | F.col("spec").startswith("../") | F.col("spec").isin(".", ".."), "relative").when(F.col("spec").startswith("node:"), "builtin").otherwise("package")
    return raw.groupBy("spec").agg(F.countDistinct("path").alias("files")).withColumn("kind", kind)


ENDINGS = ["", *(f".{e}" for e in (*javascript.EXTENSIONS, "json")), *(f"/index.{e}" for e in (*javascript.EXTENSIONS, "json"))]


def _norm(path: str) -> str:
    parts = f"string_split(regexp_replace(regexp_replace(replace({path}, chr(92), '/'), '^[.]/', ''), '^/', ''), '/')"
    return f"""lower(array_to_string(list_reduce(list_transform({parts}, lambda p: [p]),
      lambda seen, x: CASE WHEN x[1] = '..' THEN list_slice(seen, 1, len(seen) - 1) WHEN x[1] = '.' THEN seen ELSE list_concat(seen, x) END, []::VARCHAR[]), '/'))"""


@R.add(f"""
WITH files AS (SELECT DISTINCT file_path AS path FROM chunks WHERE file_path IS NOT NULL), raw AS (SELECT DISTINCT file_path AS path, unnest(imports) AS spec FROM chunks WHERE file_path IS NOT NULL),
rel AS (SELECT path, spec, regexp_replace(replace(path, chr(92), '/'), '/[^/]*$', '') || '/' || spec AS joined FROM raw WHERE starts_with(spec, './') OR starts_with(spec, '../') OR spec IN ('.', '..')),
w AS (SELECT path, spec, {_norm('joined')} AS full_path FROM rel), k AS (SELECT path AS dst, {_norm('path')} AS key FROM files),
e(place, ending) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(ENDINGS))})
SELECT DISTINCT path AS src, arg_min(dst, place) AS dst FROM w, e JOIN k ON key = full_path || ending GROUP BY path, spec
""")
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """PRS9-10: relative imports of all files and the files they name."""
    chunks = table(spark, d, "chunks").where("file_path is not null").select(F.col("file_path").alias("path"), "imports")
    raw = chunks.select("path", F.explode("imports").alias("spec")).distinct()
    return javascript.resolve(raw, chunks.select("path").distinct())


@R.add()
def parsed_smells(spark: SparkSession, d: str) -> DataFrame:
    """PRS11-16, SCL4-6: what the five detectors say of the functions in every chunk, by kind, and how many are components."""
    given = table(spark, d, "chunks").where("code is not null and file_path is not null")
    found = javascript.parse(given, "file_path", "code", "start_line", "id").select("key", "nth", "component", F.explode_outer("smells.type").alias("smell"))
    return found.groupBy(F.coalesce("smell", F.lit("none")).alias("smell")).agg(F.count("*").alias("n"), F.count_if("component").alias("in_components"))
