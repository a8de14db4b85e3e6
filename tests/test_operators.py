import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from codelode.operators import coverage, diffing, evaluation, folds, graph, rules, vectors, verify


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edges(spark, *pairs):
    return graph.edges(spark.createDataFrame(list(pairs), "src string, dst string"))


def test_four_way_diff(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3"), (None, "9")], "id string, h string")
    stored = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "id string, h string")
    assert rows(diffing.diff(current, stored, "id", "h")) == [("a", "unchanged"), ("b", "updated"), ("c", "new"), ("d", "deleted")]
    assert rows(diffing.diff(current.limit(0), stored, "id", "h")) == [("a", "deleted"), ("b", "deleted"), ("d", "deleted")]


def test_reports_and_upsert(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "s string")
    b = spark.createDataFrame([("y",), ("z",)], "s string")
    assert rows(diffing.compare_reports(a, b, "s")) == [("x", "resolved"), ("y", "persisting"), ("z", "new")]
    stored = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    changed = spark.createDataFrame([("b", 9), ("d", 4)], "k string, v int")
    assert rows(diffing.upsert(stored, changed, "k", stored.where("k = 'c'"))) == [("a", 1), ("b", 9), ("d", 4)]


def test_coupling(spark):
    e = edges(spark, ("A", "x"), ("A", "y"), ("A", "B"), ("B", "x"), ("B", "y"), ("C", "p"), ("D", "q"), ("A", "A"), ("A", None))
    assert rows(graph.coupling(e)) == [("A", "B", 2, 0.567)]
    assert rows(graph.coupling(e, most_shared=1)) == [("A", "B", 2, 0.567)]


def test_coupling_is_whole_under_salting(spark):
    rng = random.Random(1)
    e = edges(spark, *{(f"f{rng.randrange(30)}", f"d{rng.randrange(6)}") for _ in range(120)})
    assert rows(graph.coupling(e, most_shared=4)) == rows(graph.coupling(e))
    assert all(0 < r[3] <= 1 for r in rows(graph.coupling(e)))


def test_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("b", "a"), ("x", "a"), ("c", "y"))
    assert rows(graph.cycles(e)) == [("a > b > c", 3), ("a > b", 2)]
    assert graph.cycles(e.limit(0)).count() == 0


def test_components_of_cycles_of_any_length(spark):
    ring = [(f"r{k:02}", f"r{(k + 1) % 19:02}") for k in range(19)]
    e = edges(spark, *ring, ("r03", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("z", "r05"), ("y", "y"), ("y", None))
    assert graph.cycles(e, 4).count() == 1
    assert rows(graph.components(e)) == [("a", "a", 2, 2), ("b", "a", 2, 2), *((f"r{k:02}", "r00", 19, 19) for k in range(19))]
    assert graph.components(e.limit(0)).count() == 0


def test_components_are_mutual_reachability(spark):
    rng = random.Random(5)
    pairs = {(f"f{rng.randrange(60):02}", f"f{rng.randrange(60):02}") for _ in range(75)}
    after = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            new = {d for s, d in pairs if s == x and s != d} - seen
            seen |= new
            todo += new
        after[a] = seen
    groups = {a: frozenset(b for b in after[a] if a in after[b]) for a in after}
    inside = lambda g: sum(s in g and d in g and s != d for s, d in pairs)
    want = sorted((a, min(g), len(g), inside(g)) for a, g in groups.items() if g)
    assert want and rows(graph.components(edges(spark, *pairs))) == want


def test_neighbours(spark):
    e = edges(spark, ("x", "y"), ("y", "z"), ("z", "w"))
    seeds = spark.createDataFrame([("x",)], "file string")
    assert rows(graph.neighbours(e, seeds, 2)) == [("y", 1), ("z", 2)]


def test_god_files_and_calls(spark):
    e = edges(spark, *(("f", f"d{k}") for k in range(5)), *(("g", f"d{k}") for k in range(4)))
    chunks = spark.createDataFrame([("1", "f", 3), ("2", "f", None), ("3", "d0", 1)], "id string, file_path string, cyclomatic_complexity int")
    assert rows(graph.god_files(e, chunks)) == [("f", 5, 2, 3)]
    assert rows(graph.file_calls(e, chunks)) == [("f", "d0", 2)]


def test_layers(spark):
    e = edges(spark, ("/r/controllers/a", "/r/models/b"), ("/r/controllers/a", "/r/services/c"), ("/r/x/a", "/r/models/b"))
    assert rows(graph.layer_violations(e, [("controllers", "services")])) == [("/r/controllers/a", "/r/models/b", "controllers", "models")]
    assert rows(graph.layer_violations(e, [])) == []


def test_rank(spark):
    primary = spark.createDataFrame([("p1", 1, False), ("p2", 2, False)], "id string, place long, smelly boolean")
    near = spark.createDataFrame([("n", 10, False)], "id string, complexity int, smelly boolean")
    assert rows(vectors.rank(primary, near)) == [("n", "neighbour", 0.8), ("p1", "primary", 1.0), ("p2", "primary", 0.5)]


def test_top_k_with_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [0.0, 1.0]), (7, [float("nan"), 1.0]), (8, [2.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    found = [(r.query, r.id, r.place) for r in vectors.top_k(df, df.where("id in (1, 3)"), k=2).orderBy("place").collect()]
    assert found == [(1, 1, 1), (1, 8, 2)]
    assert vectors.top_k(df.limit(0), df.limit(0)).count() == 0
    many = vectors.top_k(df, df.where("id in (1, 2, 6, 8)"), k=3, at_once=1)
    assert rows(many) == rows(vectors.top_k(df, df.where("id in (1, 2, 6, 8)"), k=3))


def test_secret_kinds(spark):
    texts = ['"api_key = ABCDEFGHIJKLMNOPQRST 8.8.8.8"', '"https://u:p@h"', '"127.0.0.1"', '"10.1.2.3"', '"172.16.0.1"', '"127.0.0.1 and 8.8.8.8"', '"aZ3kQ9xWv7TnR4mYb2LdQe1Hs"', '"aaaaaaaaaaaaaaaaaaaaaaaa"', "''"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.k for r in df.select(rules.secret_kind(F.col("t")).alias("k")).collect()] == ["assignment", "url", None, None, "address", "address", "entropy", None, None]


def test_taint(spark):
    code = "const a = req.body;\nconst b = 1;\ndb.query(a);\ndb.query(b);\nconst c = 2;\nsend(c)\nrun(c);\nc = process.env.X;"
    df = spark.createDataFrame([("1", code), ("2", None)], "id string, code string")
    found = {r.variable: (r.sources, r.sinks, r.dangerous, r.risk) for r in rules.taint(df).collect()}
    assert found == {"a": (1, 1, 1, "HIGH"), "b": (0, 1, 0, "LOW"), "c": (1, 1, 0, "MEDIUM")}


def test_scan_chunks_keeps_the_first(spark):
    df = spark.createDataFrame([("2", "p", 10, 12, "x\neval(a)"), ("1", "p", 10, 12, "y\neval(b)"), ("3", None, 1, 2, "eval(c)"), ("4", "q", None, None, None)], "id string, file_path string, start_line int, end_line int, code string")
    assert rows(rules.scan_chunks(df, rules.CHUNK_RULES)) == [("1", "p", "code-injection", "CRITICAL", 11, 12)]


def test_verify(spark):
    chunks = spark.createDataFrame([("c", 10, "let total = 1;\n  sum(total);\n")], "id string, start_line int, code string")
    findings = spark.createDataFrame(
        [("ok", ["c"], 10, 11, "sum(total);", "sum total"), ("lines", ["c"], 99, 99, None, "sum"), ("gone", ["x"], 1, 1, None, ""), ("mixed", ["c"], 10, 99, "nothing of it here", "total")],
        "id string, chunk_ids array<string>, start_line int, end_line int, code_snippet string, claim string",
    )
    found = {r.id: (r.agree, r.disagree, r.verdict) for r in verify.verify(findings, chunks).collect()}
    assert found == {"ok": (4, 0, "CONFIRMED"), "lines": (1, 2, "DISPUTED"), "gone": (0, 0, "DISPUTED"), "mixed": (2, 2, "PLAUSIBLE")}


def test_coverage(spark):
    e = edges(spark, ("src/a.test.ts", "src/a.ts"), ("src/latest/x.ts", "src/b.ts"), ("tests/t.ts", "src/c.ts"))
    assert rows(coverage.test_edges(e)) == [("src/a.ts", "src/a.test.ts"), ("src/c.ts", "tests/t.ts")]
    chunks = spark.createDataFrame([("1", "src/a.ts", 20), ("2", "src/b.ts", 11), ("3", "src/d.ts", 6), ("4", "src/d.ts", 5)], "id string, file_path string, cyclomatic_complexity int")
    vulnerable = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), (None,)], "file_path string")
    assert [(r[0], r[5]) for r in rows(coverage.coverage_gaps(chunks, coverage.test_edges(e), vulnerable))] == [("1", 3), ("2", 1), ("3", 2)]


def plain_match(findings, truth, tolerance=3):
    left, found = list(range(len(truth))), []
    for place, (sig, line) in enumerate(findings):
        options = [(abs(line - truth[t][1]), t) for t in left if truth[t][0] == sig and abs(line - truth[t][1]) <= tolerance]
        if options:
            delta, t = min(options)
            left.remove(t)
            found.append((place, t, delta))
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_match(spark, seed):
    rng = random.Random(seed)
    findings = [(f"s{rng.randrange(3)}", rng.randrange(60)) for _ in range(60)]
    truth = [(f"s{rng.randrange(3)}", rng.randrange(60)) for _ in range(40)]
    f = spark.createDataFrame([(k, s, l, k) for k, (s, l) in enumerate(findings)], "finding long, signature string, line long, place long").repartition(3)
    t = spark.createDataFrame([(k, s, l) for k, (s, l) in enumerate(truth)], "vulnerability long, signature string, line long").repartition(3)
    found = evaluation.match(f, t).collect()
    tp = sorted((r.finding, r.vulnerability, r.delta) for r in found if r["class"] == "TP")
    assert tp == plain_match(findings, truth)
    count = lambda c: sum(r["class"] == c for r in found)
    assert count("TP") + count("FP") == len(findings) and count("TP") + count("FN") == len(truth)


def test_scores(spark):
    df = spark.createDataFrame([("a", 1, 1, 0), ("b", 0, 0, 0), ("c", 0, 2, 3)], "agent string, tp long, fp long, fn long")
    assert rows(evaluation.scores(df)) == [("a", 1, 1, 0, 0.5, 1.0, 0.6667), ("b", 0, 0, 0, 0.0, 0.0, 0.0), ("c", 0, 2, 3, 0.0, 0.0, 0.0)]


def test_regressions_at_the_threshold(spark):
    df = spark.createDataFrame([("a", 1, 0.85), ("a", 2, 0.80), ("a", 3, 0.74), ("a", 4, 0.5)], "g string, o int, v double")
    assert [(r.o, r.level) for r in evaluation.regressions(df, "g", "o", "v").orderBy("o").collect()] == [(3, "WARNING"), (4, "CRITICAL")]


NESTED = ["for (a) {", "  for (b) {", "    x();", "  }", "}", "for (c) {", "}"]


def test_nesting():
    assert folds.nesting(NESTED) == (2, 3, 0)
    assert folds.nesting(["for (a) {", "}", "for (b) {", "}", "for (c) {", "}"]) == (1, 3, 0)
    assert folds.nesting(["for (a) {", "}", "for (b) {", "}", "for (c) {", "}"], compat=True)[0] == 3
    assert folds.nesting(["a.map(x => x);", "if (a) {", "}"]) == (1, 1, 1)
    assert folds.complexity_class("function f(n) { return f(n - 1) + f(n - 2); }")[0] == "O(2^n)"
    assert folds.complexity_class("\n".join(NESTED))[0] == "O(n²)"
    assert folds.complexity_class("a.sort(b)")[0] == "O(n log n)"
    assert folds.complexity_class("")[0] == "O(1)"


def test_windows():
    assert folds.windows(["x"] * 160) == [(0, 99), (100, 159)]
    assert folds.windows(["x"] * 100) == [(0, 99)]
    assert folds.windows(["{"] * 400) == [(0, 149), (150, 299), (300, 399)]
    for n in (101, 150, 151, 299, 700):
        parts = folds.windows(["{", "}", "a"] * (n // 3) + ["b"] * (n % 3))
        assert parts[0][0] == 0 and parts[-1][1] == n - 1 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
        assert all(b - a < 150 for a, b in parts)


def test_split_frame(spark):
    code = "\n".join(["x"] * 160)
    df = spark.createDataFrame([("a", code, 5, 16, "p"), ("b", "short", 1, 1, "p"), ("c", None, 1, 1, "p")], "id string, code string, start_line int, cyclomatic_complexity int, file_path string")
    assert [(r.part, r.first_line, r.last_line, r.complexity) for r in folds.split_chunks(df).orderBy("part").collect()] == [(1, 5, 104, 10), (2, 105, 164, 6)]


def test_rank_and_neighbours_of_each_query(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    seeds = spark.createDataFrame([("q", "a"), ("r", "d"), ("r", "c")], "query string, file string")
    assert rows(graph.neighbours(e, seeds, 2, ("query",))) == [("q", "b", 1), ("q", "c", 2), ("r", "a", 2), ("r", "b", 1)]
    hits = spark.createDataFrame([("q", "x", 1, False), ("q", "y", 2, True), ("r", "x", 1, False)], "query string, id string, place long, smelly boolean")
    near = spark.createDataFrame([("r", "z", 4, False)], "query string, id string, complexity int, smelly boolean")
    assert rows(vectors.rank(hits, near, ("query",))) == [("q", "x", "primary", 1.0), ("q", "y", "primary", 0.6), ("r", "x", "primary", 1.0), ("r", "z", "neighbour", 0.7)]


def test_hybrid_search_asks_one_vector_in_twenty(spark):
    from codelode.plans import searches

    at = "/root/testdata/sf0.001"
    asked = {r.query for r in searches.hybrid_ranked_all(spark, at).collect()}
    ids = {r.id for r in searches._stored(spark, at).select("id").collect()}
    assert len(asked) > 1 and asked == {x for x in ids if int(md5(x.encode()).hexdigest()[:8], 16) % 20 == 0}


def test_pairs_within_blocks(spark):
    from codelode.operators.pairs import pairs_within

    rows = [("hot", n) for n in range(60)] + [("cold", 1), ("cold", 2), ("alone", 3), (None, 1), (None, 2), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, m int")
    want = sorted([("hot", a, b) for a in range(60) for b in range(a + 1, 60)] + [("cold", 1, 2)])
    for block in (7, 2000):
        assert sorted(map(tuple, pairs_within(df, ["k"], "m", block).collect())) == want
    assert pairs_within(df.limit(0), ["k"], "m").collect() == []


def test_rule_labels_are_the_expected_ones():
    assert [r.name for r in rules.LINE_RULES] == ["sql-injection", "code-injection", "xss", "command-injection", "hardcoded-secret", "weak-random", "path-traversal", "code-injection", "open-redirect"]
    assert [r.name for r in rules.CHUNK_RULES] == ["code-injection", "input-validation", "hardcoded-secret", "sql-injection", "xss", "command-injection", "info-leak", "code-quality", "code-injection", "path-traversal"]
    assert [r.severity for r in rules.CHUNK_RULES] == ["CRITICAL", "HIGH", "HIGH", "CRITICAL", "HIGH", "HIGH", "LOW", "INFO", "HIGH", "HIGH"]
    assert [k for k, _ in rules.SOURCE_KINDS] == ["http-input", "environment", "file-read", "user-input", "external-data", "parsed-input"]
    assert [k for k, _ in rules.SINK_KINDS] == ["database-query", "eval", "dom-manipulation", "command-execution", "response-output", "redirect", "file-write", "dynamic-function"]


def test_findings_of_one_category_and_line_are_one(spark):
    df = spark.createDataFrame([("2", "p", 1, 9, "x\nnew Function(eval(s))"), ("2", "p", 1, 9, "x\nnew Function(eval(s))"), ("1", "p", 1, 9, "x\nnew Function(s)"), ("3", None, 1, 9, "eval(x)"), ("4", "q", 1, 9, None)], "id string, file_path string, start_line int, end_line int, code string")
    assert rows(rules.scan_chunks(df, rules.CHUNK_RULES)) == [("1", "p", "code-injection", "HIGH", 2, 5)]
    assert rows(rules.scan_chunks(df.where("id = '2'"), rules.CHUNK_RULES)) == [("2", "p", "code-injection", "CRITICAL", 2, 5)]
    assert rows(rules.scan_lines(df)) == [("1", 2, "code-injection", "HIGH"), ("2", 2, "code-injection", "HIGH"), ("3", 1, "code-injection", "HIGH")]


def test_taint_kinds(spark):
    code = "const a = req.body;\nconst b = a.x;\ndb.query(a);\nres.send(b); eval(b)\nlet c = JSON.parse(process.env.X)"
    df = spark.createDataFrame([("1", code, 1), ("1", code, 2)], "id string, code string, row int")
    found = {r.variable: (r.sources, r.sinks, r.dangerous, r.from_kinds, r.to_kinds, r.harmed_by, r.passed_to, r.risk) for r in rules.taint(df).collect()}
    assert found["a"] == (1, 1, 1, "http-input", "database-query", "database-query", "b", "HIGH")
    assert found["b"] == (0, 2, 0, "", "eval response-output", "", "", "LOW")
    assert found["c"] == (2, 0, 0, "environment parsed-input", "", "", "", "MEDIUM")
    assert rules.taint(df).count() == 3 and rules.taint(df.limit(0)).count() == 0


def test_vectors_of_every_length_are_answered(spark):
    given = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [0.9, 0.1, 0.0])]
    df = spark.createDataFrame(given, "id long, embedding array<double>")
    every = [rows(vectors.top_k(df, df, k=3, at_once=n).select("query", "id", "place")) for n in (1, 2, 100)]
    assert every[0] == every[1] == every[2] and {q for q, _, _ in every[0]} == {1, 2, 3, 4, 5}
    assert (4, 5, 2) in every[0] and (5, 4, 2) in every[0]


def test_a_ring_of_five(spark):
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("e", "f")]
    df = spark.createDataFrame(ring, "src string, dst string")
    assert rows(graph.components(df)) == [(x, "a", 5, 5) for x in "abcde"]
    assert [r.length for r in graph.cycles(df, 5).collect()] == [5]


def test_parts_of_other_sizes(spark):
    df = spark.createDataFrame([("1", "\n".join(["x"] * 25), 3, 4, "p")], "id string, code string, start_line int, cyclomatic_complexity int, file_path string")
    assert rows(folds.split_chunks(df, 10).select("part", "first_line", "last_line")) == [(1, 3, 12), (2, 13, 22), (3, 23, 27)]
