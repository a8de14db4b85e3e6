import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from codelode.llm import catalog, near_copies
from codelode.llm.near_copies import Rule, near_copy_pairs
from codelode.llm.parity import sets_of, tokens_of

from .oracle import rows_of, sql_rows

SCHEMA = "id string, code string, x long, class long"


def grams(text):
    t = tokens_of(text or "")
    return set(zip(t, t[1:], t[2:])) if len(t) >= 40 else set()


def brute(rows, similarity=Fraction(7, 10)):
    sets = {i: grams(c) for i, c in rows if i is not None and grams(c)}
    ids = sorted(sets)
    found = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c >= similarity * (len(sets[a]) + len(sets[b]) - c):
                found.append((a, b))
    return sorted(found, key=repr)


def family(rng, n, words, vocabulary=5000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(0, max(2, words // 12))):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(0, 3)] = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 3))]
        yield " ".join(copy)


def records(seed, boilerplate=""):
    rng = random.Random(seed)
    texts = [t for words in (42, 45, 60, 100, 300, 900) for _ in range(4) for t in family(rng, 6, words)]
    texts += [" ".join(["aa bb cc"] * 30), " ".join(["AA-bb  cc"] * 30), " ".join(["aa bb cc dd"] * 30), texts[0], texts[0].upper().replace(" ", "\r\n")]
    return [(f"id{k}", boilerplate + t) for k, t in enumerate(texts)]


def run(spark, rows, rule=None):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)
    return rows_of(near_copy_pairs(df, rule=rule))


def test_sets():
    s = sets_of(["a B_1 c; a b_1 C d", "x y", ""], 3, 3)
    assert s.sizes.tolist() == [5 - 1, 0, 0]
    assert sets_of([chr(0x212A) + " a b c"], 3, 3).sizes.tolist() == [1]  # the Kelvin sign is no token
    two = sets_of(["a b c d e", "d e a b c", "a b c d e"], 3, 3)
    f = two.fingerprints()
    assert f[0] == f[2] != f[1]


def test_sketch_distance_is_a_lower_bound():
    rng = random.Random(2)
    texts = list(family(rng, 30, 200))
    s = sets_of(texts, 3, 40)
    sk = s.sketches(4)
    for a in range(10):
        for b in range(10, 30):
            hamming = sum(int(x).bit_count() for x in sk[a] ^ sk[b])
            assert hamming <= len(grams(texts[a]) ^ grams(texts[b]))


def test_equals_brute_force(spark):
    rows = records(1)
    want = brute(rows)
    assert len(want) > 100
    extra = [("null", None), ("empty", ""), (None, rows[0][1]), ("short", "a b c"), rows[3], ("long", "v " * 100_000)]
    assert run(spark, rows + extra) == want


@pytest.mark.parametrize("few,many,depth", [(2, 8192, 1), (2, 30, 3), (8, 40, 2), (1, 1000, 3)])
def test_hot_keys_are_refined_without_loss(spark, few, many, depth):
    rows = records(3, "shared header words that come first in all of the files ")
    assert run(spark, rows, Rule(few=few, many=many, depth=depth)) == brute(rows)


def test_blocks_of_a_key(spark):
    """At the last depth a key of many classes is dealt to tasks in pairs of blocks."""
    rows = records(4, "shared header words that come first in all of the files ")[:90]
    assert run(spark, rows, Rule(few=2, many=7, depth=1)) == brute(rows)


@pytest.mark.parametrize("exact", [False, True])
def test_similar_sets_share_more_keys_than_they_can_spare(exact):
    rule, rng = Rule(exact=exact), random.Random(11)
    texts = [t for words in (40, 45, 60, 100, 150, 200, 300, 900, 3000) for k in range(4) for t in family(rng, 8, words, 30 if k == 0 else 5000)]
    s = sets_of(texts, 3, 40)
    spare = {(o, k): n for o, k, n in zip(*(x.tolist() for x in near_copies.spare(s, rule)))}
    owner, key = near_copies.sign(s, rule)
    keys = [set(key[owner == k].tolist()) for k in range(len(texts))]
    held = 0
    for a in range(len(texts)):
        for b in range(a + 1, min(a + 32, len(texts))):
            ga, gb = grams(texts[a]), grams(texts[b])
            if len(ga & gb) >= Fraction(7, 10) * len(ga | gb):
                level = int(rule.level(np.int64(len(ga) + len(gb))))
                both = sum(k & 31 == level for k in keys[a] & keys[b])
                most = max(spare.get((a, level), 0), spare.get((b, level), 0))
                assert both > most or not both and not most
                held += most > 0
    assert held > 100


def test_a_key_of_many_is_not_refined_for_sets_that_can_spare_it(spark, monkeypatch):
    """Whole sets are dealt and exchanged anew only for classes that need one of their keys of many classes."""
    rng, depths, signer = random.Random(12), [], near_copies._signer
    header = " ".join(f"header{k}" for k in range(12))
    rows = [(f"id{k}", header + " " + t) for k, t in enumerate(t for _ in range(60) for t in family(rng, 2, 150, 10**6))]
    shared = np.unique(near_copies.sign(sets_of([t for _, t in rows], 3, 40), Rule())[1], return_counts=True)[1].max()
    assert shared > 8
    monkeypatch.setattr(near_copies, "_signer", lambda rule, depth=1: (depths.append(depth), signer(rule, depth))[1])
    assert run(spark, rows, Rule(few=2, many=8)) == brute(rows)
    assert depths == [1]


def test_sets_of_few_classes_to_refine_are_not_exchanged(spark, monkeypatch):
    plans, met = [], near_copies._met
    monkeypatch.setattr(near_copies, "_met", lambda rows, f: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), met(rows, f))[1])
    rows = records(3, "shared header words that come first in all of the files ")
    assert run(spark, rows, Rule(few=2, many=12, depth=3)) == brute(rows)
    refined = [p for p in plans if "Join" in p]
    assert refined and all(p.count("Join") == p.count("strategy=broadcast") for p in refined)


def test_one_key_of_many_classes_is_dealt_to_several_tasks(spark):
    classes, words = 3000, 4
    rule = Rule(many=500, depth=1)
    rng = np.random.default_rng(1)
    members = pd.DataFrame({"key": np.int64(33), "class": np.arange(classes, dtype=np.int64) << near_copies.SIZE_BITS | 40})
    sketches = pd.DataFrame({"class": members["class"], "level": 1, "sketch": [rng.integers(0, 2**63, words, dtype=np.uint64).tobytes() for _ in range(classes)]})
    sketches.loc[7, "sketch"] = sketches.loc[2900, "sketch"]
    m, k = spark.createDataFrame(members), spark.createDataFrame(sketches, "class long, level int, sketch binary")
    large = spark.createDataFrame([(33, classes)], "key long, n long")
    near = near_copies._near_by_sketch(m, large, k, rule)
    assert [tuple(r) for r in near.collect()] == [(members["class"][7], members["class"][2900])]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "part" in plan


def test_pairer_gives_members_of_runs_over_batches():
    rows = [(k, c) for k, n in ((1, 2), (2, 9), (3, 1), (4, 3), (5, 4)) for c in range(n) for _ in range(1 + c % 2)]
    for step in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] << 5 for r in rows[at : at + step]], pa.int64()), pa.array([r[1] << near_copies.SIZE_BITS | 40 for r in rows[at : at + step]], pa.int64())], names=["key", "class"]) for at in range(0, len(rows), step)]
        out = pa.Table.from_batches(list(near_copies._pairer(Rule(), 3)(iter(batches)))).to_pylist()
        assert sorted((r["x"] >> 5, r["y"] >> near_copies.SIZE_BITS) for r in out if r["hot"]) == [(2, c) for c in range(9)] + [(5, c) for c in range(4)]


def test_size_codes_bound_their_sizes():
    sizes = np.unique(np.concatenate([np.arange(0, 20_000), np.random.default_rng(2).integers(1, 2**31, 20_000)]))
    code = near_copies.size_code(sizes)
    low, high = near_copies.size_bounds(code)
    assert (low <= sizes).all() and (sizes <= high).all() and (np.diff(code) >= 0).all() and code.max() <= near_copies.SIZE_MASK
    assert ((high - low) * near_copies.STEPS <= sizes).all()


def test_exact_and_large_sets(spark):
    rng = random.Random(9)
    big = [f"w{rng.randrange(10**6)}" for _ in range(12_000)]
    half = big[:9_000] + [f"v{k}" for k in range(9_000)]
    texts = {"a": big, "b": big[:11_000] + ["x"] * 500, "c": half, "d": big[:6_000]}
    rows = [(k, " ".join(v)) for k, v in texts.items()] + records(2)[:40]
    want = brute(rows)
    assert ("a", "b") in want
    assert run(spark, rows) == want == run(spark, rows, Rule(exact=True))


def test_small_sets_keep_their_links(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        cycle = [f"t{rng.randrange(4)}" for _ in range(rng.randrange(3, 12))]
        rows.append((f"s{k}", " ".join((cycle * 20)[:60])))
    want = brute(rows)
    assert want and run(spark, rows, Rule(few=2, many=4, depth=3)) == want == run(spark, rows)


def test_other_similarity_and_empty(spark):
    rows = records(6)[:80]
    assert run(spark, rows, Rule(similarity=Fraction(9, 10))) == brute(rows, Fraction(9, 10))
    assert run(spark, []) == []


def test_levels_of_a_pair_are_levels_of_both():
    rule = Rule()
    sizes = np.arange(1, 3000)
    low, high = rule.levels(sizes)
    for s in range(1, 3000, 7):
        t = np.arange(int(np.ceil(0.7 * s)), int(s / 0.7) + 1)
        level = rule.level(s + t)
        assert (low[s - 1] <= level).all() and (level <= high[s - 1]).all()
        for k in np.unique(level):
            if rule.parts(int(k)):
                assert rule.difference((s + t)[level == k]).max() < rule.parts(int(k))


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    rows = rows_of(catalog.p4_found(spark, at).select("id_a", "id_b"))
    assert rows and rows == sql_rows(at, catalog.P4_SQL, ["id_a", "id_b"])


def test_classes_equal_sql(spark):
    at, columns = "/root/testdata/sf0.01", ["id", "class_key", "links"]
    rows = rows_of(catalog.p4_classes(spark, at).select(columns))
    assert rows and rows == sql_rows(at, catalog.P4_CLASSES_SQL, columns)


def test_a_large_group_of_copies_stays_one_class(spark):
    rng = random.Random(8)
    base, other = list(family(rng, 1, 80))[0], list(family(rng, 1, 80))[0]
    rows = [(f"c{k:04}", base) for k in range(400)] + [("d", base + " more"), ("e", other)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(4)
    found = {r.id: (r.class_key, r.links) for r in near_copies.near_copy_classes(df).collect()}
    assert len(found) == 402 and found["c0399"] == ("c0000", 1) and found["d"] == ("d", 1) and found["e"] == ("e", 0)
