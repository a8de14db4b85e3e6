"""Queries of vector search and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.operators import graph, vectors
from codelode.plans.graphs import AROUND, imports
from codelode.plans.registry import Registry
from codelode.session import cut
from codelode.sources.tables import table

R = Registry()
COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@R.add(f"""
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, {COSINE} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) <= 10
""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """GRV6: the ten nearest vectors of every twentieth vector."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_k(rows, rows.where("id % 20 = 0"))


@R.add(f"""
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, {COSINE} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query, id, similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) <= 5
""")
def similar_patterns(spark: SparkSession, d: str) -> DataFrame:
    """GRV7: up to five other vectors with a similarity of 0.3 or more."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vectors.top_k(rows, rows.where("id % 20 = 0"), k=6).where("query <> id")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("place", place).where("place <= 5").select("query", "id", "similarity")


STORED = "(SELECT chunk_id AS id, any_value(file_path) AS file_path, any_value(repo_id) AS repo_id, max(cyclomatic_complexity) AS complexity, max(smell_count) AS smells, min_by(embedding, embedding) AS embedding FROM vectors WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id)"


@R.add(f"""
WITH v AS {STORED}, q AS (SELECT * FROM v ORDER BY id LIMIT 1),
p AS (SELECT b.id, b.file_path, b.smells, row_number() OVER (ORDER BY {COSINE} DESC, b.id) AS place FROM q a, v b WHERE {COSINE} >= 0.3 QUALIFY row_number() OVER (ORDER BY {COSINE} DESC, b.id) <= 10),
n AS {AROUND}, h1 AS (SELECT DISTINCT next AS file FROM p JOIN n ON p.file_path = n.file), h2 AS (SELECT file FROM h1 UNION SELECT next FROM h1 JOIN n USING (file)),
r AS (SELECT file FROM h2 WHERE file NOT IN (SELECT file_path FROM p WHERE file_path IS NOT NULL))
SELECT id, 'primary' AS kind, round(1.0 - (place - 1) / (SELECT count(*) FROM p) + CASE WHEN smells > 0 THEN 0.1 ELSE 0 END, 6) AS score FROM p
UNION ALL SELECT id, 'neighbour', round(0.5 + least(coalesce(complexity, 0) / 20, 0.3) + CASE WHEN smells > 0 THEN 0.1 ELSE 0 END, 6) FROM v JOIN r ON v.file_path = r.file WHERE id NOT IN (SELECT id FROM p)
""")
def hybrid_ranked(spark: SparkSession, d: str) -> DataFrame:
    """JOI4, WIN2: the matches of one vector and the chunks of files up to two imports away, ranked; ``hybrid_ranked_all`` takes one vector in twenty."""
    rows = _stored(spark, d)
    return _hybrid(spark, d, rows, rows.select("id", "embedding").orderBy("id").limit(1)).drop("query")


#: One id in twenty, by a hash of the id.
ASKED = "('0x' || md5(id)[1:8])::BIGINT % 20 = 0"
#: Queries of the hybrid search sent at once; similarities of so many to a batch of 10,000 rows take 80 MB.
HYBRID_AT_ONCE = 1024


@R.add(f"""
WITH v AS {STORED}, q AS (SELECT * FROM v WHERE {ASKED}),
p AS (SELECT a.id AS query, b.id, b.file_path, b.smells, row_number() OVER (PARTITION BY a.id ORDER BY {COSINE} DESC, b.id) AS place FROM q a, v b WHERE {COSINE} >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {COSINE} DESC, b.id) <= 10),
c AS (SELECT query, count(*) AS n FROM p GROUP BY query),
n AS {AROUND}, h1 AS (SELECT DISTINCT query, next AS file FROM p JOIN n ON p.file_path = n.file), h2 AS (SELECT query, file FROM h1 UNION SELECT query, next FROM h1 JOIN n USING (file)),
r AS (SELECT query, file FROM h2 WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query = h2.query AND p.file_path = h2.file))
SELECT query, id, 'primary' AS kind, round(1.0 - (place - 1) / n + CASE WHEN smells > 0 THEN 0.1 ELSE 0 END, 6) AS score FROM p JOIN c USING (query)
UNION ALL SELECT query, id, 'neighbour', round(0.5 + least(coalesce(complexity, 0) / 20, 0.3) + CASE WHEN smells > 0 THEN 0.1 ELSE 0 END, 6) FROM v JOIN r ON v.file_path = r.file WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query = r.query AND p.id = v.id)
""")
def hybrid_ranked_all(spark: SparkSession, d: str) -> DataFrame:
    """JOI4, WIN2: the matches of one vector in twenty, by a hash of its id, and the chunks of files up to two imports from them, ranked for each."""
    rows = _stored(spark, d)
    return _hybrid(spark, d, rows, rows.where("cast(conv(substring(md5(id), 1, 8), 16, 10) as bigint) % 20 = 0").select("id", "embedding"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "vectors").where("embedding is not null and chunk_id is not null")
    return stored.groupBy(F.col("chunk_id").alias("id")).agg(F.max("file_path").alias("file_path"), F.max("cyclomatic_complexity").alias("complexity"), F.max("smell_count").alias("smells"), F.min("embedding").alias("embedding"))


def _hybrid(spark: SparkSession, d: str, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, kind, score) of the stored rows for each query (id, embedding)."""
    smelly = (F.coalesce("smells", F.lit(0)) > 0).alias("smelly")
    top = cut(vectors.top_k(rows.select("id", "embedding"), queries, at_once=HYBRID_AT_ONCE).select("query", "id", "place"))
    hits = top.join(rows.select("id", "file_path", smelly), "id")
    near = graph.neighbours(imports(spark, d), hits.where("file_path is not null").select("query", F.col("file_path").alias("file")), 2, ("query",))
    around = rows.select("id", "file_path", "complexity", smelly).join(near.select("query", F.col("file").alias("file_path")), "file_path").join(top.select("query", "id"), ["query", "id"], "left_anti")
    return vectors.rank(hits.select("query", "id", "place", "smelly"), around.select("query", "id", "complexity", "smelly"), ("query",))


@R.add("""
WITH c AS (SELECT DISTINCT id AS chunk_id FROM chunks) SELECT repo_id, count(*) AS stored, count(embedding) AS embedded, sum((chunk_id IN (SELECT chunk_id FROM c))::int)::BIGINT AS current
FROM (SELECT DISTINCT repo_id, chunk_id, hash, embedding FROM vectors WHERE chunk_id IS NOT NULL) GROUP BY repo_id
""")
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """SRC11-13: what is stored for every repository, and how much of it is of current chunks."""
    rows = table(spark, d, "vectors").where("chunk_id is not null").select("repo_id", "chunk_id", "hash", "embedding").distinct()
    current = table(spark, d, "chunks").select(F.col("id").alias("chunk_id")).distinct().withColumn("current", F.lit(1))
    return rows.join(current, "chunk_id", "left").groupBy("repo_id").agg(F.count("*").alias("stored"), F.count("embedding").alias("embedded"), F.count("current").alias("current"))
