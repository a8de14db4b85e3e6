import pytest
from pyspark.sql import functions as F

from codelode.functions import answers
from codelode.operators import cards, graph, knowledge
from codelode.sources.store import Store, repeated, summary


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_array():
    assert answers.first_array('x ```json\n[{"a": "]"}]\n``` [2]') == '[{"a": "]"}]'
    assert answers.first_array("[not json] then [1, 2]") == "[1, 2]"
    assert answers.first_array('["open') is None and answers.first_array("") is None and answers.first_array(None) is None


def test_findings_in_answers(spark):
    df = spark.createDataFrame([(1, 'Here: [{"id": "f", "title": "t", "startLine": 3}, {"severity": "LOW"}]'), (2, "nothing"), (3, None)], "k int, text string")
    found = [(r.k, r.id, r.title, r.severity, r.confidence, r.startLine, r.chunkIds) for r in answers.findings_in(df, "text", "k").collect()]
    assert found == [(1, "f", "t", "MEDIUM", "LOW", 3, []), (1, None, "", "LOW", "LOW", 0, [])]


def test_verdicts_and_reports(spark):
    df = spark.createDataFrame([('[{"findingId": "a", "verdict": "disputed"}, {"findingId": "a", "verdict": "Confirmed", "reason": "r"}, {"findingId": "b", "verdict": "?"}, {}]',)], "text string")
    assert rows(answers.verdicts_in(df, "text")) == [("a", "CONFIRMED", "r"), ("b", "PLAUSIBLE", "")]
    reports = spark.createDataFrame([('{"gaps": [], "mappedTests": 2}',), ('{"summary": "no gaps"}',), ("x",)], "text string")
    made = [r.r for r in reports.select(answers.report_in(F.col("text")).alias("r")).collect()]
    assert (made[0].mappedTests, made[0].totalTestFiles, made[0].summary, made[1], made[2]) == (2, 0, "", None, None)


def test_cards(spark):
    findings = spark.createDataFrame([("a", "xss", "T", "HIGH", "p", 3), ("b", "xss", None, None, "p", None), ("c", "xss", "T", "LOW", "p", 1)], "id string, category string, title string, severity string, file_path string, start_line int")
    verdicts = spark.createDataFrame([("a", "CONFIRMED", "r"), ("c", "DISPUTED", "no"), ("z", "CONFIRMED", "")], "finding string, verdict string, reason string")
    judged = cards.with_verdicts(findings, verdicts)
    assert [(r.id, r.verdict) for r in judged.orderBy("id").collect()] == [("a", "CONFIRMED"), ("b", "PLAUSIBLE"), ("c", "DISPUTED")]
    made = spark.createDataFrame([("a", "why", "fix"), ("zz", "x", "y")], "id string, explanation string, fixed_code string")
    assert rows(cards.cards(judged, made)) == [("a", "why", "fix", False), ("b", " (xss, MEDIUM) at p", "", True)]


def test_strategy(spark):
    df = spark.createDataFrame([(101, 1, "xss"), (60, 1, "god-class"), (60, 30, "xss"), (60, 31, "xss"), (61, 31, "xss")], "lines int, span int, category string")
    made = df.select(cards.strategy(F.col("lines"), F.col("span"), F.col("category"), F.lit("")).alias("s")).collect()
    assert [r.s for r in made] == ["bypass", "architectural", "windowed", "full", "truncated"]
    assert "responsibility" in df.where("category = 'god-class'").select(cards.advice(F.col("category"), F.lit(None).cast("string")).alias("a")).first().a


def test_targets(spark):
    findings = spark.createDataFrame([("s", ["1", "2"], "DISPUTED"), ("p", ["3"], "CONFIRMED")], "agent string, chunk_ids array<string>, verdict string")
    plan = spark.createDataFrame([("s", "9", 1), ("p", "7", 1), ("p", "8", 4)], "agent string, chunk string, place int")
    assert rows(cards.targets(findings, plan)) == [("p", "7"), ("s", "1"), ("s", "2")]


def test_property_graph(spark):
    chunks = spark.createDataFrame([("1", "a", 3), ("2", "a", 1), ("3", None, 1)], "id string, file_path string, cyclomatic_complexity int")
    edge = graph.edges(spark.createDataFrame([("a", "b"), ("a", "b")], "src string, dst string"))
    g = knowledge.property_graph(chunks, edge)
    assert rows(g.files) == [("a",), ("b",)] and rows(g.contains) == [("a", "1"), ("a", "2")]
    left = knowledge.without_chunks(g, spark.createDataFrame([("1",)], "id string"))
    assert rows(left.contains) == [("a", "2")] and left.chunks.count() == 2
    assert repeated(spark.createDataFrame([("1",), ("1",), ("2",)], "id string"), "id").collect()[0].n == 2


def test_context(spark):
    chunks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "id string, file_path string")
    edge = graph.edges(spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string"))
    wanted = spark.createDataFrame([("1",), ("x",)], "id string")
    assert rows(knowledge.context(chunks, edge, wanted)) == [("1", "2", 1, 2), ("1", "3", 2, 2)]
    assert rows(knowledge.context(chunks, edge, wanted, most=1)) == [("1", "2", 1, 2)]


def test_sync(spark):
    stored = spark.createDataFrame([("a", "1", "old"), ("b", "2", "old"), ("c", "3", "old")], "id string, hash string, vector string")
    current = spark.createDataFrame([("a", "1", "new"), ("b", "9", "new"), ("d", "4", "new")], "id string, hash string, vector string")
    after, changes = knowledge.sync(stored, current)
    assert rows(after) == [("a", "1", "old"), ("b", "9", "new"), ("d", "4", "new")]
    assert rows(changes) == [("a", "unchanged"), ("b", "updated"), ("c", "deleted"), ("d", "new")]


def test_knowledge_graph(spark):
    chunks = spark.createDataFrame([("1", "a", 9, ["x"]), ("2", "b", 9, None), ("3", "b", None, [])], "id string, file_path string, cyclomatic_complexity int, smells array<string>")
    k = knowledge.KnowledgeGraph(chunks, graph.edges(spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")))
    assert [r.id for r in k.query("high_complexity_chunks", 1).collect()] == ["1"]
    assert rows(k.query("most_imported_files")) == [("b", 2)] and rows(k.query("files_with_smells")) == [("a", 1)]
    assert all(k.query(name).count() > 0 for name in k.names)
    with pytest.raises(KeyError, match="chunk_stats"):
        k.query("none")


def test_plan_and_pairs(spark):
    chunks = spark.createDataFrame([("1", "src/auth/a", 2, None), ("2", "src/b", 9, []), ("3", "src/c", 1, ["x"])], "id string, file_path string, cyclomatic_complexity int, smells array<string>")
    assert rows(knowledge.plan(chunks)) == [("performance", "2", 1), ("security", "1", 1), ("security", "3", 2)]
    assert rows(knowledge.plan(chunks.where("id = '1'"))) == [("performance", "1", 1), ("security", "1", 1)]
    edge = graph.edges(spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x")], "src string, dst string"))
    assert rows(graph.coupling_of(edge, "B", "A")) == [("A", "B", 1, 0.4)]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), "repo")
    assert not s.exists()
    s.replace(spark.createDataFrame([("a", 1), ("b", 2)], "repo string, v int"))
    s.replace(s.read("b").select("repo", (F.col("v") + 10).cast("int").alias("v")))  # from the table itself
    s.append(spark.createDataFrame([("c", 3)], "repo string, v int"))
    s.append(spark.createDataFrame([], "repo string, v int"))
    assert rows(s.read().select("repo", "v")) == [("a", 1), ("b", 12), ("c", 3)]
    s.drop("a")
    s.drop("nothing")
    assert rows(s.read().select("repo", "v")) == [("b", 12), ("c", 3)]
    s.drop_all()
    assert not s.exists()


def test_summary(spark):
    df = spark.createDataFrame([("a", 1, 1, 0, 0.5, 1.0, 0.6667)], "agent string, tp int, fp int, fn int, precision double, recall double, f1 double")
    assert rows(summary(df)) == [("a", 1, 1, 0, "50.0%", "100.0%", "66.7%")]


def test_first_array_in_prose():
    from codelode.functions.answers import first_array

    assert first_array('see [x] and "[2", then [1, "a]b", {"c": [2]}] end') == '[1, "a]b", {"c": [2]}]'
    assert first_array('[bad, [1]]') == "[1]" and first_array("[[[") is None and first_array("") is None and first_array(None) is None
    assert first_array("[" * 200_000) is None
    assert first_array("```json\n[]\n```") == "[]"


def test_plan_looks_at_sensitive_paths(spark):
    paths = {"1": "src/crypto/a.ts", "2": "src/db/b.ts", "3": "src/admin/c.ts", "4": "x/Middleware.ts"}
    df = spark.createDataFrame([(k, p, 7, []) for k, p in paths.items()], "id string, file_path string, cyclomatic_complexity int, smells array<string>")
    assert sorted(r.chunk for r in knowledge.plan(df).where("agent = 'security'").collect()) == ["1", "2", "4"]
    assert knowledge.tests_wanted(df.selectExpr("file_path as path")).first().tests is False
    assert knowledge.tests_wanted(spark.createDataFrame([("a.Test.ts",)], "path string")).first().tests is True


def test_failed_deliveries_are_kept(spark, tmp_path):
    from codelode.sources import store

    failed = store.Store(spark, str(tmp_path / "failed"), "batch")
    df = spark.range(25).repartition(2)

    def send(rows):
        assert len(rows) <= 10
        if any(r["id"] == 7 for r in rows):
            raise OSError("no")

    store.deliver(send, failed, tries=2, at_once=10, pause=0.0)(df, 3)
    kept = failed.read()
    assert 0 < kept.count() <= 10 and kept.where("id = 7 and batch = 3").count() == 1
    store.deliver(send, None, tries=1, at_once=10, pause=0.0)(df, 4)


def test_a_table_is_made_once(spark, tmp_path):
    from codelode.sources import store

    at = store.Store(spark, str(tmp_path / "t"), "part")
    df = spark.createDataFrame([(1, "a")], "x int, part string")
    at.ensure(df)
    assert at.exists() and at.read().count() == 0
    at.append(df)
    at.ensure(df)
    assert at.read().count() == 1
