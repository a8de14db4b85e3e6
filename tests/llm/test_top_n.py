import random

from hypothesis import given
from hypothesis import strategies as st

from codelode.llm import catalog
from codelode.llm.loser_tree import LoserTree
from codelode.llm.top_n import top_n_per_group

from .oracle import rows_of, sql_rows

SCHEMA = "file_path string, cyclomatic_complexity int, id string, start_line int, g string, run int, code string"


@given(st.lists(st.lists(st.integers(0, 20))))
def test_loser_tree_merges_sorted_runs(runs):
    runs = [sorted(run) for run in runs]
    merged = [(x, r, k) for r, run in enumerate(runs) for k, x in enumerate(run)]
    found = [(key, *value) for key, value in LoserTree([[(x, (r, k)) for k, x in enumerate(run)] for r, run in enumerate(runs)])]
    assert found == sorted(merged)


def brute(rows, n):
    best = {}
    for g, s, i, t, *_ in rows:
        if g is not None and s is not None and i is not None:
            key = (-s, t is None, t or 0, i)
            best.setdefault(g, {})
            best[g][i] = min(best[g].get(i, key), key)
    return sorted(((g, i) for g, items in best.items() for i in sorted(items, key=items.get)[:n]), key=repr)


def test_matches_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(900):
        item = rng.randrange(120)
        g = rng.choice([None, "", "hot", "hot", "hot", f"f{item % 7}"])
        rows.append((g, rng.choice([None, 1, 2, 3, 9]), rng.choice([None, f"i{item}"]) if rng.random() < 0.1 else f"i{item}", item % 5 if item % 3 else None, "clash", 3, "x" * 50))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert rows_of(top_n_per_group(df, "file_path", "cyclomatic_complexity", "id", 5, "start_line")) == brute(rows, 5)
    assert rows_of(top_n_per_group(df, "file_path", "cyclomatic_complexity", "id", 2, "start_line", fan_in=2)) == brute(rows, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n_per_group(df, "file_path", "cyclomatic_complexity", "id", 5, "start_line").collect() == []


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    assert rows_of(catalog.p1_found(spark, at).select("file_path", "id")) == sql_rows(at, catalog.P1_SQL, ["file_path", "id"])
