import random

from codelode.llm import catalog
from codelode.llm.provenance import decided_files, not_hand_written

from .oracle import rows_of, sql_rows

SCHEMA = "file_path string, id string, code string, lines int, path string"
HAND = "function add(a, b) {\n  // adds two numbers for the caller\n  return a + b;\n}\n" * 8


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(r.file_path for r in not_hand_written(df).collect())


def test_cases(spark):
    rng = random.Random(3)
    blob = "".join(rng.choices("ABCDEFabcdef0123456789+/", k=3000))
    cases = {
        "a/node_modules/x/i.js": HAND,
        "a\\vendor\\x\\i.js": HAND,
        "a/app.min.js": HAND,
        "a/tool1.ts": "// Code generated by maker v1. DO NOT EDIT.\n" + HAND,
        "a/tool3.ts": "// Diese Datei wurde von maker erzeugt. Nicht von Hand bearbeiten.\n" + HAND,
        "a/tool4.ts": "/* tslint:disable */\n/* produced by maker: changes here are overwritten on the next build */\n" + HAND,
        "a/tool5.ts": "// DO NOT EDIT\n" + HAND,
        "a/tool6.ts": "// Fichier généré par maker, ne pas modifier\n" + HAND,
        "a/tool2.ts": "/**\n * @generated\n */\n" + HAND,
        "a/copy1.ts": "/*\n * thing\n * Version: 1.2.3\n * Licensed under MIT\n */\n" + HAND,
        "a/copy2.ts": "/*! thing v1.2.3 | (c) 2011 thing contributors | MIT */\n" + HAND,
        "a/minified.js": "var a=b(1),c=!0;function d(e,f){return e^f<<3};" * 40,
        "a/data.ts": "export const a = [\n" + "  1.25, 2.5, 3.75, 10.5,\n" * 60 + "];",
        "a/blob.ts": f'export const a = "{blob}";',
    }
    others = {
        "a/hand.ts": HAND,
        "src/vendors/a.ts": HAND,
        "src/distance/a.ts": HAND,
        "tools/codegen/emit.ts": "// writes the generated files; edit this template, not its output\n" + HAND,
        "a/own.ts": "// Copyright 2020 some team. Internal use only.\n// do not edit the order of these calls\n// returns an auto generated id\n" + HAND,
        "a/long.ts": HAND * 60,
        "a/one_long_line.ts": HAND + f'const icon = "{blob[:600]}";\n' + HAND,
        "a/long_list.ts": "function f(a) {\n  return words.test(a);\n}\nconst words = /^" + "|".join(f"someword{chr(97 + k % 26)}{chr(97 + k % 7)}" for k in range(70)) + "$/;\n",
        "a/small_table.ts": "function f(a) {\n  return sizes[a];\n}\nconst sizes = [43, 94, 7.921, 0.714, 29, 41, 9.480, 2.943, 7.422, 76];\n",
        "a/config.json": '{"a": 1, "b": [1, 2, 3, 4, 5, 6, 7, 8, 9]}',
        "a/empty.ts": "",
        "a/null.ts": None,
    }
    rows = [(p, f"i{n}", c) for n, (p, c) in enumerate({**cases, **others}.items())]
    assert found(spark, rows + rows[:4] + [(None, "z", HAND)]) == sorted(cases)
    assert found(spark, []) == []


STUB = "".join(f'  get f{k}() {{ return this.rpc.call("/a.v1.B/C{k}", req, {k * 37}); }}\n' for k in range(40))


def test_layout_decides_first(spark):
    cases = {
        "a/stub.ts": ("layout", STUB),
        "a/node_modules/stub.ts": ("layout", STUB),
        "a/stub.jsx": ("layout", STUB),
        "a/again.ts": ("layout", "registerTheHandlerOfEvents(applicationContext);\ncloseTheHandlerOfEvents(applicationContext);\n" * 20),
        "a/node_modules/hand.ts": ("path", HAND),
        "a/hand_made.ts": ("notice", "// Code generated by maker\n" + HAND),
    }
    others = {"a/short_stub.ts": STUB[: len(STUB) // 5], "a/stub.css": STUB, "a/hand.ts": HAND, "a/stub.yml": STUB}
    rows = [(p, f"i{n}", c, 1, "x") for n, (p, c) in enumerate([*((p, c) for p, (_, c) in cases.items()), *others.items()])]
    assert {r.file_path: r.by for r in decided_files(spark.createDataFrame(rows, SCHEMA)).collect()} == {p: by for p, (by, _) in cases.items()}


def test_all_chunks_of_a_file_count(spark):
    rows = [("f.ts", "1", HAND), ("f.ts", "2", "// Code generated by maker\n" + HAND), ("g.ts", None, HAND)]
    assert found(spark, rows) == ["f.ts"]


def test_notices_after_a_long_header(spark):
    licence = "".join(f"// licence line {k}\n" for k in range(15))
    block = "/*\n" + "".join(f"   licence line {k}\r\n" for k in range(15))
    cases = {
        "a/lines.ts": licence + "\n// Code generated by maker v1. DO NOT EDIT.\n" + HAND,
        "a/block.ts": block + "*/\n// Code generated by maker v1. DO NOT EDIT.\n" + HAND,
        "a/inside.ts": block + " * produced by maker\n */\n" + HAND,
        "a/spanning.ts": "// Licensed under MIT\n" + licence + "// Version: 1.2.3\n" + HAND,
        "a/page.htm": "<!--\n" + "licence\n" * 15 + "-->\n<!-- generated by maker -->\n<p>a</p>\n",
        "a/after_code.ts": '"use strict";\n/*\n * @generated\n */\n' + HAND,
    }
    others = {
        "a/hand.ts": licence + HAND + HAND + "// Code generated by maker v1. DO NOT EDIT.\n",
        "a/ended.ts": block + "*/\nrun();\n// Code generated by maker v1. DO NOT EDIT.\n" + HAND,
    }
    rows = [(p, f"i{n}", c) for n, (p, c) in enumerate({**cases, **others}.items())]
    assert found(spark, rows) == sorted(cases)


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    rows = rows_of(catalog.p5_found(spark, at))
    assert rows and rows == sql_rows(at, catalog.p5_sql(), ["file_path"])
