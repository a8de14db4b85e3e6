"""Queries over the test tables and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import look_alikes, provenance
from codelode.llm.credentials import find_credentials, redact
from codelode.llm.encoding import encode_corpus
from codelode.llm.leakage import leaked_items
from codelode.llm.near_copies import near_copy_classes, near_copy_pairs
from codelode.llm.splitting import split_oversized
from codelode.llm.top_n import top_n_per_group
from codelode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The up to 5 most complex chunks of every file."""
    return top_n_per_group(table(spark, directory, "chunks"), "file_path", "cyclomatic_complexity", "id", 5, "start_line")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of chunks and vectors where a credential starts."""
    chunks = find_credentials(table(spark, directory, "chunks"), "id").withColumn("src_table", F.lit("chunks"))
    vectors = find_credentials(table(spark, directory, "vectors"), "chunk_id").withColumn("src_table", F.lit("vectors"))
    return chunks.unionByName(vectors).select("src_table", "chunk_id", "line_no")


def p2_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """The code of every chunk and vector with its credentials masked, as a digest, and how many characters are masked.

    Rows with a null id stay; a null code holds nothing to mask and gives no row. Repeats are dropped
    as results, so no text is exchanged.
    """
    stars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("*")))

    def of(name: str, key: str) -> DataFrame:
        given = table(spark, directory, name).where("code is not null").select(F.lit(name).alias("src_table"), F.col(key).alias("id"), "code", F.col("code").alias("before"))
        digest = (F.md5("code").alias("code_md5"), (F.length("code") == F.length("before")).alias("same_length"), (stars(F.col("code")) - stars(F.col("before"))).alias("masked"))
        return redact(given).select("src_table", "id", *digest)

    return of("chunks", "id").unionByName(of("vectors", "chunk_id")).distinct()


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every chunk of more than 100 lines."""
    return split_oversized(table(spark, directory, "chunks"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of chunks whose runs of three tokens are at least 0.7 similar."""
    return near_copy_pairs(table(spark, directory, "chunks"))


def p4_classes(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each chunk of 40 tokens or more: its class of equal sets and its number of similar classes."""
    return near_copy_classes(table(spark, directory, "chunks"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return provenance.not_hand_written(table(spark, directory, "chunks"))


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    """The ids of every document under byte_bpe_50k."""
    return encode_corpus(table(spark, directory, "documents"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that hold 12 consecutive words of an evaluation item's passage."""
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of documents that look the same but differ as strings."""
    return look_alikes.look_alike_pairs(table(spark, directory, "documents"))


def p8_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that look like another, different text, with the canonical member of their class."""
    return look_alikes.look_alike_classes(table(spark, directory, "documents")).select("doc_id", "canonical")


P1_SQL = """
SELECT file_path, id FROM (
  SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY c DESC, s ASC NULLS LAST, id) AS place
  FROM (SELECT file_path, id, max(cyclomatic_complexity) AS c, min(start_line) AS s FROM chunks
        WHERE file_path IS NOT NULL AND id IS NOT NULL AND cyclomatic_complexity IS NOT NULL GROUP BY file_path, id))
WHERE place <= 5
"""

P3_SQL = """
WITH RECURSIVE texts AS (SELECT DISTINCT id, code, coalesce(start_line, 1) AS start FROM chunks WHERE code IS NOT NULL),
cut AS (SELECT id, code, start, CASE WHEN ends_with(code, chr(10)) THEN string_split(code[:-2], chr(10)) ELSE string_split(code, chr(10)) END AS l FROM texts),
c AS (SELECT id, code, start, len(l) AS n, list_transform(l, lambda x: CASE WHEN regexp_full_match(x, '\\s*') THEN 2 WHEN regexp_matches(x, '^\\s*[}]') THEN 1 ELSE 0 END) AS kinds FROM cut WHERE len(l) > 100),
p AS (SELECT id, code, start, n, kinds, 1 AS piece, 0 AS first, 59 + list_max(list_transform(range(0, 41), lambda k: kinds[60 + k] * 1000 + k)) % 1000 AS last FROM c
  UNION ALL SELECT id, code, start, n, kinds, piece + 1, last - 4, CASE WHEN n - (last - 4) <= 100 THEN n - 1 ELSE last - 4 + 59 + list_max(list_transform(range(0, 41), lambda k: kinds[last - 4 + 60 + k] * 1000 + k)) % 1000 END FROM p WHERE last < n - 1)
SELECT DISTINCT id, piece::INTEGER AS piece_no, (start + first)::INTEGER AS first_line, (start + last)::INTEGER AS last_line FROM p
"""
P4_SQL = """
WITH ids AS (SELECT DISTINCT id, code FROM chunks WHERE id IS NOT NULL AND code IS NOT NULL),
tokens AS (SELECT id, list_transform(regexp_extract_all(code, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM ids),
grams AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM tokens WHERE len(t) >= 40),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM common JOIN sizes a ON id_a = a.id JOIN sizes b ON id_b = b.id WHERE c * 10 >= 7 * (a.n + b.n - c)
"""
P4_CLASSES_SQL = P4_SQL.replace("SELECT id_a, id_b FROM common", ", pairs AS (SELECT id_a, id_b, c = a.n AND c = b.n AS equal FROM common").replace("- c)\n", """- c)),
keys AS (SELECT s.id, least(s.id, min(CASE WHEN p.id_a = s.id THEN p.id_b ELSE p.id_a END)) AS class_key FROM sizes s LEFT JOIN pairs p ON equal AND (p.id_a = s.id OR p.id_b = s.id) GROUP BY s.id),
ends AS (SELECT id_a AS x, id_b AS y FROM pairs WHERE NOT equal UNION ALL SELECT id_b, id_a FROM pairs WHERE NOT equal)
SELECT k.id, k.class_key, count(DISTINCT o.class_key) AS links FROM keys k LEFT JOIN ends ON x = k.id LEFT JOIN keys o ON o.id = y GROUP BY k.id, k.class_key
""")


def p5_sql() -> str:
    """The same patterns and thresholds over the files' sums."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    lost = lambda text, pattern: f"length({text}) - length(regexp_replace({text}, {q(pattern)}, '', 'g'))"
    hit = lambda text, pattern: f"regexp_matches({text}, {q(pattern)})"
    banner = " + ".join(f"{hit('head', p)}::int" for p in provenance.BANNER)

    def rule(t: provenance.Layout) -> str:
        bare = "greatest(chars - encoded, 1)"
        return f"""({bare} / lines > {t.mean_line} AND longest > {t.longest_line} AND spaces / {bare} < {t.spaces} AND alnum / {bare} < {t.letters_and_digits})
          OR (numbers / {bare} > {t.numbers} AND numbers >= {t.least_numbers}) OR encoded / greatest(chars, 1) > {t.encoded}"""

    layout = "CASE " + " ".join(f"WHEN extension = {q(name)} THEN {rule(t)}" for name, t in provenance.LAYOUTS.items()) + f" ELSE {rule(provenance.Layout())} END"
    configuration = ", ".join(q(x) for x in provenance.CONFIGURATION)
    return f"""
WITH ids AS (SELECT DISTINCT file_path, id, code FROM chunks WHERE file_path IS NOT NULL),
bare AS (SELECT *, regexp_replace(code, {q(provenance.ENCODED)}, '', 'g') AS bare, array_to_string(list_slice(string_split(code, chr(10)), 1, {provenance.HEAD_LINES}), chr(10)) AS head FROM ids),
stats AS (SELECT file_path, length(code) AS chars, length(code) - length(bare) AS encoded, length(code) - length(replace(code, chr(10), '')) + 1 AS lines,
  list_max(list_transform(string_split(bare, chr(10)), lambda x: length(x))) AS longest, {lost('bare', '[ ' + chr(9) + chr(13) + chr(10) + ']')} AS spaces, {lost('bare', '[A-Za-z0-9]')} AS alnum,
  {lost('bare', provenance.NUMBER)} AS numbers, ({hit('head', provenance.TOOL)} OR {hit('head', provenance.COPY)} OR ({banner}) >= 2) AS notice FROM bare),
files AS (SELECT file_path, replace(file_path, chr(92), '/') AS slashed, lower(regexp_extract(replace(file_path, chr(92), '/'), '[.]([^./]*)$', 1)) AS extension,
  sum(chars) AS chars, sum(encoded) AS encoded, sum(lines) AS lines, sum(spaces) AS spaces, sum(alnum) AS alnum, sum(numbers) AS numbers, max(longest) AS longest, bool_or(notice) AS notice
  FROM stats GROUP BY file_path)
SELECT file_path FROM files WHERE extension NOT IN ({configuration})
  AND ({hit('slashed', provenance.FOLDER)} OR {hit('slashed', provenance.NAME)} OR coalesce(notice, false) OR coalesce({layout}, false))
"""


def _mapped_sql(table: dict[str, str], text: str) -> str:
    """A text with every character of the table replaced."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    one = {k: v for k, v in table.items() if len(v) == 1}
    made = f"translate({text}, {quoted(''.join([*one, *(k for k, v in table.items() if not v)]))}, {quoted(''.join(one.values()))})"
    for k, v in table.items():
        if len(v) > 1:
            made = f"replace({made}, '{k}', '{v}')"
    return made


def p7_sql() -> str:
    """Equal runs of twelve words, by the same character tables."""
    small = {chr(k): v for k, v in look_alikes.caseless().items() if chr(k) not in look_alikes.folding()}

    def words(text: str) -> str:
        lower = f"lower(nfc_normalize({_mapped_sql(look_alikes.folding(), text)}))"
        return f"regexp_extract_all({_mapped_sql(small, lower)}, '[\\p{{L}}\\p{{N}}]+')"

    grams = "unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' ')))"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, {words('passage')} AS w FROM eval_items WHERE passage IS NOT NULL AND item_id IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {grams} AS g FROM d) JOIN (SELECT DISTINCT item_id, {grams} AS g FROM i) USING (g)
"""


def _forms_sql() -> str:
    """Documents' forms by the same character table and DuckDB's canonical composition."""
    text = _mapped_sql(look_alikes.folding(), "text")
    return f"""
WITH forms AS (SELECT doc_id, text, nfc_normalize({text}) AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
seen AS (SELECT * FROM forms WHERE regexp_matches(form, '[^\\s]'))
"""


def p8_sql() -> str:
    """Look-alike pairs of equal forms."""
    return _forms_sql() + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM seen a JOIN seen b ON a.form = b.form WHERE a.doc_id < b.doc_id AND a.text <> b.text"


def p8_classes_sql() -> str:
    """The members of forms that more than one text has."""
    return _forms_sql() + "SELECT doc_id, canonical FROM seen JOIN (SELECT form, min(doc_id) AS canonical FROM seen GROUP BY form HAVING count(DISTINCT text) > 1) USING (form)"


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_classes": p8_classes}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": p5_sql(), "p7_found": p7_sql(), "p8_found": p8_sql(), "p8_classes": p8_classes_sql(), "p4_classes": P4_CLASSES_SQL}
