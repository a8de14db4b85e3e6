import random

from codelode.llm.leakage import leaked_items, words_of

DOCS = "doc_id long, text string, item_id long, passage string"
ITEMS = "item_id long, passage string, doc string, text string"


def brute(docs, items, least=12):
    grams = {}
    for item, passage in items:
        if item is not None and passage:
            w = words_of(passage)
            for k in range(len(w) - least + 1):
                grams.setdefault(tuple(w[k : k + least]), set()).add(item)
    found = set()
    for doc, text in docs:
        if doc is not None and text:
            w = words_of(text)
            for k in range(len(w) - least + 1):
                found |= {(doc, item) for item in grams.get(tuple(w[k : k + least]), ())}
    return sorted(found)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, "x", "y") for r in items], ITEMS)
    return sorted(map(tuple, leaked_items(d, i, **kw).collect()))


def test_words():
    assert words_of("It's Ｆｕｌｌ_wi­dth été сat x2") == ["it", "s", "full", "width", "été", "cat", "x2"]
    assert words_of("ВОДА") == words_of("вода")


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(6)] + ["été", "Stop"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 11, 12, 40])))) for k in range(25)]
    items += [(3, items[5][1]), (None, items[6][1]), (40, None), (41, ""), items[0]]
    docs = []
    for k in range(300):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            passage = words_of(rng.choice(items[:25])[1])
            a = rng.randrange(len(passage))
            words[rng.randrange(len(words) + 1) :] = passage[a : a + rng.choice([11, 12, 13, 30])]
        docs.append((k if k % 50 else None, rng.choice([" ", ", ", "\n"]).join(words).upper() if k % 3 else " - ".join(words)))
    docs += [(900, None), (901, ""), (902, "w1 " * 30_000), docs[1]]
    want = brute(docs, items)
    assert want
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_words=100) == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f g h i j k l m")]) == []
    assert run(spark, [(1, "a b c d e f g h i j k l m")], []) == []


def test_query_equals_brute_force(spark):
    from codelode.llm import catalog

    at = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{at}/eval_items.parquet").collect()]
    found = sorted(map(tuple, catalog.p7_found(spark, at).collect()))
    assert found and found == brute(docs, items)


def test_query_equals_sql(spark):
    from codelode.llm import catalog

    from .oracle import rows_of, sql_rows

    at = "/root/testdata/sf0.01"
    assert rows_of(catalog.p7_found(spark, at).select("doc_id", "item_id")) == sql_rows(at, catalog.p7_sql(), ["doc_id", "item_id"])
