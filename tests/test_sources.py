import json

import pytest
from pyspark.sql import functions as F

from codelode.plans.analysis import analyze, evaluate
from codelode.sources import javascript as J
from codelode.sources import repository as P
from codelode.streaming import progress as S


def test_tokens():
    kinds = [(t.kind, t.text) for t in J.tokens("a = b / c / d; x = /[/]\\/a/g.test(`t${`n${1}`}`); // no\n'it\\'s'")]
    assert ("regex", "/[/]\\/a/g") in kinds and ("template", "`t${`n${1}`}`") in kinds and ("string", "'it\\'s'") in kinds
    assert sum(k == "regex" for k, _ in kinds) == 1


def only(code):
    ts = J.tokens(code)
    return ts, J.functions(code, ts)


def test_complexity_is_defined_by_its_parts():
    assert J.complexity(J.tokens("if(a){} else if(b){} else {}")) == 5
    assert J.complexity(J.tokens("a && b || c ?? d ? e : f")) == 5
    assert J.complexity(J.tokens("do { x?.y } while (a); switch (b) { case 1: case 2: }")) == 5
    assert J.complexity(J.tokens("function f(a?: number) {}")) == 1


def test_arrow_with_a_long_return_type():
    fields = "; ".join(f"field{k}: Map<string>[] | null" for k in range(12))
    code = f"\nconst made = (a, b): {{ {fields} }} => {{\n  return a;\n}};\nconst other = wide ? (call(a)) : list.map(x => x + {' + '.join('y' * 60)});\n"
    ts, found = only(code)
    assert [(f.name, f.params) for f in found] == [("made", 2), ("<anonymous>", 1)]
    assert ts[found[0].first].text == "(" and code.count("\n", 0, code.index("(a, b)")) == 1


def test_functions():
    code = "const f = async ({a, b}, c) => { g(function h() {}); };\nclass K { static m(x): Map<string, number> { return x; } }\nif (a) { b(); }"
    ts, found = only(code)
    assert [(f.name, f.params, len(f.inner)) for f in found] == [("f", 2, 1), ("h", 0, 0), ("m", 1, 0)]
    assert J.callback_depth(found[0]) == 1
    assert "/* h */" in J.without_inner(code, ts, found[0])


def test_unreachable():
    check = lambda code: J.unreachable(J.tokens(code))
    assert check("{ return 1; a(); }") and not check("{ return 1; /* done */ }") and not check("switch (a) { case 1: return 2; case 3: b(); }")
    assert not check("{ if (a) return 1; b(); }")


def test_halstead():
    assert J.halstead(J.tokens("")) == (0, 0, 0, 0, 0.0)
    assert J.halstead(J.tokens("a = b + a")) == (2, 2, 2, 3, 10.0)


def test_imports():
    assert J.imported(J.tokens("import a from './a'; export * from \"b\"; require('c'); import('d'); import './a'; x('no')")) == ["./a", "b", "c", "d"]


def test_components():
    ts = J.tokens("const a = () => <b>x</b>;")
    assert J.component("a", ts, "x.tsx") and not J.component("a", ts, "x.ts") and J.component("App", [], "x.jsx")
    assert not J.has_jsx(J.tokens("if (a < b && c > d) { e<f>(g); }"))


def test_parse_frame(spark):
    df = spark.createDataFrame([("a.ts", "function f() {\n  return 1;\n}"), ("b.py", "def f(): pass"), ("c.js", ""), ("d.js", None), ("e.js", "}}}((`")], "path string, code string")
    found = [(r.path, r.name, r.start_line, r.end_line, r.error) for r in J.parse(df).collect()]
    assert found == [("a.ts", "f", 1, 3, None)]


def test_resolve(spark):
    files = spark.createDataFrame([("r/a.ts",), ("r/b/index.js",), ("r/a.js",), ("r/c.json",)], "path string")
    imports = spark.createDataFrame([("r/x/y.ts", "../a"), ("r/z.ts", "./b"), ("r/z.ts", "node:fs"), ("r/z.ts", "./c.json"), ("r/z.ts", "./none")], "path string, spec string")
    assert sorted(map(tuple, J.resolve(imports, files).collect())) == [("r/x/y.ts", "r/a.ts"), ("r/z.ts", "r/b/index.js"), ("r/z.ts", "r/c.json")]


def test_ignore_rules(spark):
    paths = ["a/node_modules/x.js", "dist/a.js", "a/distance/b.js", "x.min.js", ".env", ".env.local", "a.d.ts", "keep/dist/a.js", "src/a.ts", "docs/a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = [r.path for r in df.where(~P.ignored(F.col("path"), [*P.IGNORED, "!keep/**", "/docs/*.txt"])).collect()]
    assert kept == ["a/distance/b.js", "keep/dist/a.js", "src/a.ts"]


def test_scanner_and_truth(spark, tmp_path):
    scan = {"results": [{"packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [{"id": "C1", "summary": "s", "database_specific": {"severity": "high"}}, {"id": "C2"}]}, {"package": {"name": "q", "version": "2"}, "vulnerabilities": []}]}]}
    df = spark.createDataFrame([(json.dumps(scan),), ("{broken",), (None,)], "value string")
    assert sorted(map(tuple, P.dependency_risks(df).collect()), key=repr) == [("p", "1", "C1", "HIGH", "s"), ("p", "1", "C2", "MEDIUM", None)]
    good = [{"name": "n", "repoUrl": "u", "commitHash": "HEAD", "vulnerabilities": [{"filePath": "a.js", "ruleId": "XSS", "line": 3, "severity": "HIGH"}]}]
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert [(r.file_path, r.expected_agent) for r in P.ground_truths(spark, str(tmp_path / "good.json")).collect()] == [("a.js", "security")]
    (tmp_path / "bad.json").write_text(json.dumps([{"name": "n"}]))
    with pytest.raises(Exception, match="lacks"):
        P.ground_truths(spark, str(tmp_path / "bad.json")).collect()


def test_advisories(spark):
    packages = spark.createDataFrame([("p",), ("p",), ("q",)], "package string")
    database = spark.createDataFrame([("p", f"C{k:02}", None, "s", ["1", "2", "3", "4"]) for k in range(12)], "package string, cve string, severity string, summary string, links array<string>")
    found = P.advisories(packages, database).collect()
    assert len(found) == 10 and all(len(r.links) == 3 and r.severity == "MEDIUM" for r in found)


def test_analysis_of_a_repository(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "node_modules" / "x" / "i.js").write_text("function no() { eval(a); }")
    (root / "src" / "a.ts").write_text("import { b } from './b';\nexport function a(req) {\n  return eval(req.body['x']);\n}\n")
    (root / "src" / "b.ts").write_text("export const b = () => {\n  console.log(1);\n};\n")
    (root / "src" / "a.test.ts").write_text("import { a } from './a';\nfunction t() { a(1); }\n")
    (root / "big.ts").write_text("x" * (P.MOST_BYTES + 1))
    found = analyze(spark, str(root))
    assert sorted(r.path for r in found.files.collect()) == ["src/a.test.ts", "src/a.ts", "src/b.ts"]
    assert sorted(map(tuple, found.imports.collect())) == [("src/a.test.ts", "src/a.ts"), ("src/a.ts", "src/b.ts")]
    assert {(r.category, r.file_path, r.start_line) for r in found.findings.collect()} == {("code-injection", "src/a.ts", 3), ("input-validation", "src/a.ts", 3), ("info-leak", "src/b.ts", 2)}
    assert {r.verdict for r in found.verdicts.collect()} == {"CONFIRMED"}
    report = found.report.first()
    assert (report.findings, report.critical, report.health) == (3, 1, 100 - 15 - 8 - 1)
    assert found.errors.count() == 0 and found.languages.count() == 1


def test_evaluation(spark):
    truth = P.smoke_truth(spark)
    findings = spark.createDataFrame(
        [("1", "security", "SQL_INJECTION", "./src/login.js", 13), ("2", "security", "xss", "src/view.js", 99), ("3", "performance", "nested-loops", "src/a.js", 1)], "id string, agent_id string, category string, file_path string, start_line int"
    )
    scored, mean = evaluate(findings, truth)
    assert sorted((r.agent, r.tp, r.fp, r.fn) for r in scored.collect()) == [("performance", 0, 1, 0), ("security", 1, 1, 2)]
    assert mean.first().precision == 0.25


def events(spark, *rows):
    return spark.createDataFrame([(j, t, e, None, None, t) for j, t, e in rows], "job_id string, ts string, event string, message string, data string, received_at string").select(
        "job_id", F.to_timestamp("ts").alias("ts"), "event", "message", "data", F.to_timestamp("received_at").alias("received_at")
    )


ROWS = [
    ("j", "2031-01-01 00:00:01", "phase:ingest:start"), ("j", "2031-01-01 00:00:03", "phase:triage:start"), ("j", "2031-01-01 00:00:02", "phase:ingest:complete"),
    ("j", "2031-01-01 00:00:03", "phase:triage:start"), ("k", "2031-01-01 00:00:01", "phase:ingest:start"), ("k", "2031-01-01 00:00:02", "error"), (None, "2031-01-01 00:00:02", "error"),
]


def test_latest_state(spark):
    found = {r.job_id: (r.active, r.completed, r.events, r.finished, r.failed) for r in S.latest_state(events(spark, *ROWS)).collect()}
    assert found == {"j": ("triage", "ingest", 3, False, False), "k": ("ingest", "", 2, True, True)}


def test_stream_equals_batch(spark, tmp_path):
    for k in range(3):  # three files, so that state lives across batches
        events(spark, *ROWS[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = {}

    def keep(batch, number):
        out.update({r.job_id: (r.active, r.completed, r.events, r.finished, r.failed) for r in batch.collect()})

    stream = S.follow(S.read_stream(spark, str(tmp_path / "in"), 1), "30 days")
    stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    batch = {r.job_id: (r.active, r.completed, r.events, r.finished, r.failed) for r in S.latest_state(events(spark, *ROWS)).collect()}
    assert out == batch


def test_generic_functions():
    from codelode.sources.javascript import functions

    of = lambda code: [(f.name, f.params) for f in functions(code)]
    assert of("class A { m<T>(a: T): T { return a; } n(a) { return a; } }") == [("m", 1), ("n", 1)]
    assert of("const h = async <T>(x: T): Promise<T> => { return x; }") == [("h", 1)]
    assert of("const g = <K extends string, V>(x: Map<K, Array<V>>): Map<K, V> => x;") == [("g", 1)] or of("const g = <K extends string, V>(x: Map<K, Array<V>>): Map<K, V> => x;") == [("g", 2)]
    assert of("if (a < b && c > (d)) { x(); } for (let i = 0; i < n; i++) { f(i); }") == []
    assert of("const q = (a: { " + "x: number; " * 30 + "}): Map<string, number> => { return a }") == [("q", 1)]


def test_disputed_findings_are_looked_at_again(spark, tmp_path, monkeypatch):
    from codelode.plans import analysis

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("export function f(s) {\n  return eval(s);\n}\n")
    asked = []
    verified = analysis._verified

    def disputing(findings, chunks):
        asked.append(sorted(r.category for r in findings.collect()))
        found = verified(findings, chunks)
        return found.withColumn("verdict", F.lit("DISPUTED")) if len(asked) < 3 else found

    from pyspark.sql import functions as F

    monkeypatch.setattr(analysis, "_verified", disputing)
    found = analysis.analyze(spark, str(tmp_path))
    assert asked == [["code-injection"]] * 3 and found.findings.count() == 1
