import math

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as X


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, v {kind}")
    return [r.x for r in df.select("k", function(F.col("v")).alias("x")).orderBy("k").collect()]


def test_entropy(spark):
    assert values(spark, X.entropy, ["aaaa", "abcd", "", None, "aab"]) == pytest.approx([0.0, 2.0, 0.0, None, -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))], nan_ok=True)


def test_paths(spark):
    given = ["./A/b/../C.ts", "/a//b", "a\\b\\.\\c", "../x", "", None]
    assert values(spark, X.normal_path, given) == ["a/c.ts", "a//b", "a/b/c", "x", "", None]
    roots = ["/data/scans/51ed270b/src/a.ts", "D:\\scans\\ab12\\src\\a.ts", "/tmp/review/job-00fb/work/src/a.ts", "src/a.ts", None]
    assert values(spark, X.relative_path, roots) == ["src/a.ts", "src/a.ts", "src/a.ts", "src/a.ts", None]
    assert values(spark, X.job_of, roots) == ["51ed270b", "ab12", "00fb", None, None]
    assert values(spark, X.language, ["a.TSX", "b.py", "c", None]) == ["typescript", "python", "typescript", None]


def test_labels(spark):
    assert values(spark, X.normal_severity, ["high", "MODERATE", None, "", "Critical"]) == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "CRITICAL"]
    assert values(spark, X.normal_verdict, [" confirmed ", None, "x", "DISPUTED"]) == ["CONFIRMED", "PLAUSIBLE", "PLAUSIBLE", "DISPUTED"]
    assert values(spark, X.node_name, ["phase:council:start", "agent:security:start", "error", None, "a:"]) == ["Council", "Security Agent", None, None, None]
    assert values(spark, X.active_node, ["phase:triage:start", "nothing"]) == ["triage", None]
    assert values(spark, X.strip_quotes, ['"a"', "'a\"", "`b`", '"', "", None]) == ["a", "'a\"", "b", '"', "", None]
    assert values(spark, lambda c: X.truncated(c, 3), ["abcd", "abc", None]) == ["abc…", "abc", None]
    assert values(spark, X.is_local_ip, ["127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.0.9"]) == [True, True, False, True]
    assert values(spark, X.percent, [0.1234, 1.0], "double") == ["12.3%", "100.0%"]
    assert values(spark, lambda c: X.round_half_up(c, 4), [0.00005, 0.33333], "double") == [0.0001, 0.3333]


def test_answers(spark):
    given = ["x <fixed_code> a \n</fixed_code>", "t\n```ts\nlet a;\n```", "plain", "[]", "", None]
    assert values(spark, X.fenced_code, given) == ["a", "let a;", "plain", None, None, None]


def test_hash(spark):
    assert values(spark, X.java_hash, ["hello", "", "polygenelubricants"]) == [99162322, 0, -2147483648]
    (vector,) = values(spark, lambda c: X.hash_embedding(c, 8), ["hello"])
    assert sum(v * v for v in vector) == pytest.approx(1.0)


def test_windows(spark):
    code = "\n".join(str(k) for k in range(1, 21))
    df = spark.createDataFrame([(code, 11, 13, 14), (code, 1, 1, 99), (code, 1, 500, 501)], "code string, s int, a int, b int")
    rows = df.select(*(c.alias(n) for c, n in zip(X.window(F.col("code"), F.col("s"), F.col("a"), F.col("b"), 2), ("t", "x", "y")))).collect()
    assert (rows[0].t, rows[0].x, rows[0].y) == ("1\n2\n3\n4\n5\n6", 11, 16)
    assert (rows[1].x, rows[1].y) == (1, 20)
    found = df.limit(1).select(X.first_match(F.col("code"), "^1[0-9]$").alias("m"), X.around_match(F.col("code"), "^5$", 1).alias("r"), X.around_match(F.col("code"), "none", 1).alias("none")).first()
    assert (found.m, found.r, found.none) == (9, "4\n5\n6", "1\n2\n3")


def test_embedding_text(spark):
    df = spark.sql("select 'a.ts' p, 1 s, 2 e, 3 c, 1.5D v, array(named_struct('type', 'X', 'message', 'm', 'line', 1)) k, 'code' t")
    made = df.select(X.embedding_text(*(F.col(x) for x in "psecvkt")).alias("x")).first().x
    assert made == "File: a.ts\nLines 1-2\nComplexity: 3, Halstead: 1.5\nCode smells: X.\n\ncode"


def test_entropy_of_every_document(spark):
    from collections import Counter
    from math import log2

    from codelode.plans import scalars

    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect() if r.text}
    want = {k: -sum(n / len(t) * log2(n / len(t)) for n in Counter(t).values()) for k, t in texts.items()}
    found = {r.doc_id: r.bits for r in scalars.document_entropy(spark, at).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=2e-6) for k in want)
