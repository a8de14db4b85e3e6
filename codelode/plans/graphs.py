"""Queries over the import graph and over states that are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import diffing, graph
from codelode.plans.registry import Registry, literal
from codelode.sources.tables import table

R = Registry()
EDGES = "(SELECT DISTINCT src, dst FROM imports WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"
ONE = "(SELECT id, any_value(file_path) AS file_path, max(cyclomatic_complexity) AS cyclomatic_complexity FROM chunks GROUP BY id)"
#: Which layers may import which.
ALLOWED = [("controllers", "services"), ("routes", "controllers"), ("services", "domain"), ("services", "models"), ("controllers", "models"), ("middleware", "services")]


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """One narrow row for each chunk id; where an id comes again its highest complexity counts."""
    return table(spark, d, "chunks").groupBy("id").agg(F.max("file_path").alias("file_path"), F.max("cyclomatic_complexity").alias("cyclomatic_complexity"))


def imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "imports"))


@R.add(f"""
WITH c AS (SELECT DISTINCT id, sha256(file_path || '::' || code) AS now FROM chunks),
cm AS (SELECT id, max(now) AS now FROM c GROUP BY id), s AS (SELECT chunk_id AS id, max(hash) AS before FROM vectors WHERE chunk_id IS NOT NULL GROUP BY 1)
SELECT coalesce(cm.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN cm.id IS NULL THEN 'deleted' WHEN now IS NOT DISTINCT FROM before THEN 'unchanged' ELSE 'updated' END AS change
FROM cm FULL JOIN s ON cm.id = s.id
""")
def diff_chunks(spark: SparkSession, d: str) -> DataFrame:
    """JOI1: the chunks against the vectors stored by an earlier run."""
    current = table(spark, d, "chunks").select("id", X.content_hash(F.col("file_path"), F.col("code")).alias("hash"))
    return diffing.diff(current, table(spark, d, "vectors").select(F.col("chunk_id").alias("id"), "hash"), "id", "hash")


@R.add(f"SELECT change, count(*) AS n FROM ({R.entries['diff_chunks'][1]}) GROUP BY change")
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    """AGG18: how many chunks are new, updated, unchanged and deleted."""
    return diff_chunks(spark, d).groupBy("change").agg(F.count("*").alias("n"))


SIGNATURE = "file_path || '::' || category || '::' || start_line"


@R.add(f"""
WITH m AS (SELECT quantile_disc(received_at, 0.5) AS middle FROM findings), a AS (SELECT DISTINCT {SIGNATURE} AS signature FROM findings, m WHERE received_at <= middle), b AS (SELECT DISTINCT {SIGNATURE} AS signature FROM findings, m WHERE received_at > middle)
SELECT coalesce(a.signature, b.signature) AS signature, CASE WHEN b.signature IS NULL THEN 'resolved' WHEN a.signature IS NULL THEN 'new' ELSE 'persisting' END AS status
FROM a FULL JOIN b ON a.signature = b.signature WHERE coalesce(a.signature, b.signature) IS NOT NULL
""")
def report_diff(spark: SparkSession, d: str) -> DataFrame:
    """JOI12: findings received up to the median time against those received later."""
    rows = table(spark, d, "findings").select(F.concat("file_path", F.lit("::"), "category", F.lit("::"), F.col("start_line").cast("string")).alias("signature"), "received_at")
    middle = table(spark, d, "findings").agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(cast(received_at as timestamp)))").alias("at"))
    dated = rows.join(F.broadcast(middle)).withColumn("late", F.expr("unix_micros(cast(received_at as timestamp)) > at"))  # one row
    return diffing.compare_reports(dated.where("not late"), dated.where("late"), "signature")


@R.add("""
WITH keyed AS (SELECT chunk_id, hash, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY hash NULLS LAST) AS r FROM vectors WHERE chunk_id IS NOT NULL), stored AS (SELECT chunk_id, hash FROM keyed WHERE r = 1),
cur AS (SELECT id AS chunk_id, max(sha256(file_path || '::' || code)) AS hash FROM chunks GROUP BY id)
SELECT chunk_id, hash FROM stored WHERE chunk_id IN (SELECT chunk_id FROM cur) AND chunk_id NOT IN (SELECT chunk_id FROM cur WHERE hash IS NOT NULL) UNION ALL SELECT chunk_id, hash FROM cur WHERE hash IS NOT NULL
""")
def upsert_vectors(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK3: the stored hashes after current chunks are written and vanished ones deleted."""
    stored = diffing.first_of(table(spark, d, "vectors").where("chunk_id is not null").select("chunk_id", "hash"), ["chunk_id"], [F.col("hash").asc_nulls_last()])
    hashed = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), X.content_hash(F.col("file_path"), F.col("code")).alias("hash"))
    current = hashed.groupBy("chunk_id").agg(F.max("hash").alias("hash"))
    gone = stored.join(current, "chunk_id", "left_anti")
    return diffing.upsert(stored, current.where("hash is not null"), "chunk_id", gone)


@R.add(f"""
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC) AS r FROM (SELECT DISTINCT id, file_path, category, start_line, received_at FROM findings)),
sig AS (SELECT id, {SIGNATURE} AS signature, row_number() OVER (PARTITION BY {SIGNATURE} ORDER BY received_at, id) AS r2 FROM latest WHERE r = 1)
SELECT id, signature FROM sig WHERE r2 = 1
""")
def finding_dedup(spark: SparkSession, d: str) -> DataFrame:
    """WIN6: of each id the row received last, then of each signature the finding received first."""
    rows = table(spark, d, "findings").select("id", F.concat("file_path", F.lit("::"), "category", F.lit("::"), F.col("start_line").cast("string")).alias("signature"), "received_at").distinct()
    latest = diffing.first_of(rows, ["id"], [F.col("received_at").desc(), "signature"])
    return diffing.first_of(latest, ["signature"], ["received_at", "id"]).select("id", "signature")


@R.add("""
SELECT count(*) AS edges, count(DISTINCT (src, dst)) AS pairs, sum((src = dst)::int)::BIGINT AS self_edges, sum((dst IS NULL)::int)::BIGINT AS unresolved FROM imports
""")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    """JOI5: what the edge table holds."""
    rows = table(spark, d, "imports")
    pairs = rows.select(F.struct("src", "dst").alias("pair"), "src", "dst")
    return pairs.agg(F.count("*").alias("edges"), F.countDistinct("pair").alias("pairs"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("self_edges"), F.sum(F.col("dst").isNull().cast("long")).alias("unresolved"))


@R.add("""
WITH deps AS (SELECT DISTINCT id, file_path, unnest(resolved_deps) AS dep FROM chunks)
SELECT dep, count(DISTINCT id) AS chunks, count(DISTINCT file_path) AS files FROM deps WHERE dep IS NOT NULL GROUP BY dep
""")
def most_imported(spark: SparkSession, d: str) -> DataFrame:
    """AGG2: for each dependency the chunks and the files that import it."""
    deps = table(spark, d, "chunks").select("id", "file_path", F.explode("resolved_deps").alias("dep")).where("dep is not null")
    return deps.groupBy("dep").agg(F.countDistinct("id").alias("chunks"), F.countDistinct("file_path").alias("files"))


@R.add(f"SELECT file, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT src AS file, 1 AS o, 0 AS i FROM {EDGES} UNION ALL SELECT dst, 0, 1 FROM {EDGES}) GROUP BY file")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    """AGG4, JOI5: fan-out and fan-in of every file."""
    return graph.degrees(imports(spark, d))


@R.add(f"""
WITH o AS (SELECT src, count(*) AS outgoing FROM {EDGES} GROUP BY src HAVING count(*) >= 3), s AS (SELECT file_path, count(*) AS chunks, sum(cyclomatic_complexity)::BIGINT AS complexity FROM {ONE} GROUP BY file_path)
SELECT src AS file_path, outgoing, coalesce(chunks, 0) AS chunks, coalesce(complexity, 0) AS complexity FROM o LEFT JOIN s ON src = file_path
""")
def god_files(spark: SparkSession, d: str) -> DataFrame:
    """AGG5, GRV3: files with three or more outgoing edges."""
    return graph.god_files(imports(spark, d), chunk_files(spark, d), 3)


@R.add(f"""
WITH e AS {EDGES}, n AS (SELECT src, count(*) AS n FROM e GROUP BY src),
shared AS (SELECT x.src AS a, y.src AS b, count(*) AS shared FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2),
direct AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS direct FROM e WHERE dst IN (SELECT src FROM n) GROUP BY 1, 2),
pairs AS (SELECT coalesce(s.a, d.a) AS a, coalesce(s.b, d.b) AS b, coalesce(shared, 0) AS shared, coalesce(direct, 0) AS direct FROM shared s FULL JOIN direct d ON s.a = d.a AND s.b = d.b)
SELECT a, b, shared, round(least(1.0, 0.3 * direct + 0.4 * shared / (x.n + y.n - shared)::DOUBLE), 3)::DOUBLE AS score FROM pairs JOIN n x ON a = x.src JOIN n y ON b = y.src WHERE round(least(1.0, 0.3 * direct + 0.4 * shared / (x.n + y.n - shared)::DOUBLE), 3) > 0
""")
def coupling(spark: SparkSession, d: str) -> DataFrame:
    """JOI6-7, GRV4: coupling of all pairs of files that share a target or an edge."""
    return graph.coupling(imports(spark, d))


@R.add(f"SELECT a, b, score FROM ({R.entries['coupling'][1]}) ORDER BY score DESC, a, b LIMIT 10")
def coupling_top(spark: SparkSession, d: str) -> DataFrame:
    """JOI7: the ten most coupled pairs."""
    return coupling(spark, d).orderBy(F.col("score").desc(), "a", "b").limit(10).select("a", "b", "score")


SEEDS = "(SELECT DISTINCT file_path AS file FROM findings WHERE upper(severity) = 'CRITICAL' AND file_path IS NOT NULL)"
AROUND = f"(SELECT src AS file, dst AS next FROM {EDGES} UNION SELECT dst, src FROM {EDGES})"


@R.add(f"""
WITH s AS {SEEDS}, n AS {AROUND}, h1 AS (SELECT DISTINCT next AS file FROM s JOIN n USING (file) WHERE next NOT IN (SELECT file FROM s)),
h2 AS (SELECT DISTINCT next AS file FROM h1 JOIN n USING (file) WHERE next NOT IN (SELECT file FROM s) AND next NOT IN (SELECT file FROM h1))
SELECT file, 1::BIGINT AS hops FROM h1 UNION ALL SELECT file, 2 FROM h2
""")
def neighbours_2hop(spark: SparkSession, d: str) -> DataFrame:
    """JOI2: files within two hops of those with critical findings."""
    seeds = table(spark, d, "findings").where("upper(severity) = 'CRITICAL' and file_path is not null").select(F.col("file_path").alias("file"))
    return graph.neighbours(imports(spark, d), seeds, 2)


@R.add(f"WITH s AS (SELECT file_path, count(*) AS n FROM {ONE} WHERE file_path IS NOT NULL GROUP BY 1) SELECT src, dst, a.n * b.n AS calls FROM {EDGES} JOIN s a ON src = a.file_path JOIN s b ON dst = b.file_path")
def file_level_calls(spark: SparkSession, d: str) -> DataFrame:
    """JOI3: chunk pairs behind every import edge, as a number."""
    return graph.file_calls(imports(spark, d), chunk_files(spark, d))


@R.add(f"""
WITH RECURSIVE e AS {EDGES}, p AS (SELECT src AS first, dst AS tip, [src, dst] AS path FROM e WHERE src < dst
  UNION ALL SELECT first, dst, list_append(path, dst) FROM p JOIN e ON tip = src WHERE dst > first AND NOT list_contains(path, dst) AND len(path) < 4)
SELECT array_to_string(path, ' > ') AS cycle, len(path)::BIGINT AS length FROM p JOIN e ON tip = src AND dst = first
""")
def cycles_bounded(spark: SparkSession, d: str) -> DataFrame:
    """GRV1-2, GRV10: import cycles of up to four files; ``cycle_components`` has the files of all cycles."""
    return graph.cycles(imports(spark, d), 4)


COMPONENTS = f"""
WITH RECURSIVE e AS {EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
m AS (SELECT a.src AS file, min(a.dst) AS component, count(*) AS files FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
i AS (SELECT x.component, count(*) AS edges FROM e JOIN m x ON src = x.file JOIN m y ON dst = y.file WHERE x.component = y.component GROUP BY 1)
SELECT file, component, files, edges FROM m JOIN i USING (component)
"""


@R.add(COMPONENTS)
def cycle_components(spark: SparkSession, d: str) -> DataFrame:
    """GRV1-2, GRV10: every file that lies on an import cycle of any length, with its component."""
    return graph.components(imports(spark, d))


def _layer(column: str) -> str:
    slashed = f"replace({column}, chr(92), '/')"
    return "CASE " + " ".join(f"WHEN contains({slashed}, '/{x}/') THEN '{x}'" for x in reversed(graph.LAYERS)) + " END"


@R.add(f"""
SELECT src, dst, from_layer, to_layer FROM (SELECT src, dst, {_layer('src')} AS from_layer, {_layer('dst')} AS to_layer FROM {EDGES})
WHERE from_layer <> to_layer AND from_layer || '->' || to_layer NOT IN ({", ".join(literal(f"{a}->{b}") for a, b in ALLOWED)})
""")
def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    """JOI8-9: edges between layers that no rule allows."""
    return graph.layer_violations(imports(spark, d), ALLOWED)


@R.add(f"""
WITH l AS (SELECT coalesce({_layer('file_path')}, 'none') AS layer, file_path FROM {ONE} WHERE file_path IS NOT NULL) SELECT layer, count(DISTINCT file_path) AS files, count(*) AS chunks FROM l GROUP BY layer
""")
def layers_found(spark: SparkSession, d: str) -> DataFrame:
    """JOI9: files and chunks in each layer."""
    rows = chunk_files(spark, d).where("file_path is not null").select(F.coalesce(graph.layer_of(F.col("file_path")), F.lit("none")).alias("layer"), "file_path")
    return rows.groupBy("layer").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


@R.add(f"""
WITH c AS (SELECT count(*) AS n FROM ({R.entries['cycles_bounded'][1]})), g AS (SELECT count(*) AS n FROM (SELECT src FROM {EDGES} GROUP BY src HAVING count(*) >= 5)), v AS (SELECT count(*) AS n FROM ({R.entries['layer_violations'][1]}))
SELECT c.n AS cycles, g.n AS god_files, v.n AS violations, CASE WHEN v.n = 0 AND g.n = 0 THEN 'Clean Modular' WHEN g.n >= 3 THEN 'Monolith' WHEN c.n >= 2 THEN 'Spaghetti' ELSE 'Layered' END AS pattern FROM c, g, v
""")
def architecture_report(spark: SparkSession, d: str) -> DataFrame:
    """RUL12, GRV5: counts of the graph's problems and a word for the whole, by cycles of up to four files; ``architecture_whole`` has no bound."""
    edge = imports(spark, d)
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    god = edge.groupBy("src").count().where("count >= 5")
    joined = one(cycles_bounded(spark, d), "cycles").join(one(god, "god_files"), "k").join(one(layer_violations(spark, d), "violations"), "k")
    return joined.select("cycles", "god_files", "violations", graph.pattern_label(F.col("cycles"), F.col("god_files"), F.col("violations")).alias("pattern"))


@R.add(f"""
WITH k AS ({COMPONENTS}), c AS (SELECT count(DISTINCT component) AS components, count(*) AS cyclic_files, (SELECT coalesce(sum(edges - files + 1), 0)::BIGINT FROM (SELECT DISTINCT component, files, edges FROM k)) AS independent_cycles FROM k),
g AS (SELECT count(*) AS n FROM (SELECT src FROM {EDGES} GROUP BY src HAVING count(*) >= 5)), v AS (SELECT count(*) AS n FROM ({R.entries['layer_violations'][1]}))
SELECT components, cyclic_files, independent_cycles, g.n AS god_files, v.n AS violations,
  CASE WHEN v.n = 0 AND g.n = 0 THEN 'Clean Modular' WHEN g.n >= 3 THEN 'Monolith' WHEN independent_cycles >= 2 THEN 'Spaghetti' ELSE 'Layered' END AS pattern FROM c, g, v
""")
def architecture_whole(spark: SparkSession, d: str) -> DataFrame:
    """RUL12, GRV5 over cycles of any length.

    The cycles of a component of E edges and F files are too many to list, but E - F + 1 of them are
    independent, and that is two or more exactly where the component has two or more cycles.
    """
    edge = imports(spark, d)
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    parts = cycle_components(spark, d).select("component", "files", "edges").distinct()
    cyclic = parts.agg(F.count("*").alias("components"), F.coalesce(F.sum("files"), F.lit(0)).alias("cyclic_files"), F.coalesce(F.sum(F.expr("edges - files + 1")), F.lit(0)).alias("independent_cycles"))
    god = edge.groupBy("src").count().where("count >= 5")
    joined = cyclic.withColumn("k", F.lit(1)).join(one(god, "god_files"), "k").join(one(layer_violations(spark, d), "violations"), "k")
    label = graph.pattern_label(F.col("independent_cycles"), F.col("god_files"), F.col("violations"))
    return joined.select("components", "cyclic_files", "independent_cycles", "god_files", "violations", label.alias("pattern"))


@R.add(f"""
WITH e AS {EDGES}, f AS (SELECT src AS file FROM e UNION SELECT dst FROM e UNION SELECT file_path FROM chunks WHERE file_path IS NOT NULL)
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(DISTINCT src) FROM e) AS files_with_deps, (SELECT count(*) FROM e) AS edges
""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG17: files, files with dependencies, edges."""
    edge = imports(spark, d)
    files = edge.select("src").unionAll(edge.select("dst")).unionAll(table(spark, d, "chunks").where("file_path is not null").select("file_path")).distinct()
    a = files.agg(F.count("*").alias("files"), F.lit(1).alias("k"))
    b = edge.agg(F.countDistinct("src").alias("files_with_deps"), F.count("*").alias("edges"), F.lit(1).alias("k"))
    return a.join(b, "k").select("files", "files_with_deps", "edges")


TEST = "(contains(lower({0}), '.test.') OR contains(lower({0}), '.spec.') OR contains(lower({0}), '__tests__') OR contains(lower({0}), '_test.') OR contains(lower({0}), '_spec.') OR regexp_matches(lower({0}), '(^|[/' || chr(92) || chr(92) || '])tests?[/' || chr(92) || chr(92) || ']'))"


#: The tables' jobs hold hardly any tests, so importers are renamed to what tests are called, by their names' lengths.
RENAMED = f"(SELECT DISTINCT CASE length(src) % 5 WHEN 0 THEN regexp_replace(src, '[.]([^.]*)$', '.test.\\1') WHEN 1 THEN regexp_replace(src, '[.]([^.]*)$', '_spec.\\1') WHEN 2 THEN regexp_replace(src, '/([^/]*)$', '/tests/\\1') ELSE src END AS src, dst FROM {EDGES})"


@R.add(f"SELECT dst AS source, count(*) AS tests, string_agg(src, ' ' ORDER BY src) AS test_files FROM {RENAMED} WHERE {TEST.format('src')} AND NOT {TEST.format('dst')} GROUP BY dst")
def test_mapping(spark: SparkSession, d: str) -> DataFrame:
    """JOI10: the test files that import each source file."""
    from codelode.operators.coverage import test_edges

    size = F.length("src") % 5
    named = F.when(size == 0, F.regexp_replace("src", "[.]([^.]*)$", ".test.$1")).when(size == 1, F.regexp_replace("src", "[.]([^.]*)$", "_spec.$1")).when(size == 2, F.regexp_replace("src", "/([^/]*)$", "/tests/$1")).otherwise(F.col("src"))
    mapped = test_edges(imports(spark, d).withColumn("src", named).distinct())
    return mapped.groupBy("source").agg(F.count("*").alias("tests"), F.array_join(F.array_sort(F.collect_list("test")), " ").alias("test_files"))
