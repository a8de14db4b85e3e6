import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import catalog
from codelode.llm.look_alikes import fold, folding, look_alike_classes, look_alike_pairs, looks, rough

from .oracle import rows_of, sql_rows

SCHEMA = "doc_id long, text string, canonical int, looks string"


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return rows_of(look_alike_pairs(df))


def test_table_is_stable():
    for k, v in folding().items():
        assert len(k) == 1 and v != k
        assert fold(fold(k)) == fold(k)
        assert unicodedata.normalize("NFC", fold("a" + v)) == fold("a" + k)


SAME = [
    ["Résumé ok", "Résumé ok", "Ｒésumé ok", "Ré​sumé ok", "Résumé ok", "Résumé ok﻿"],
    ["office", "oﬃce", "оffice", "off­ice"],
    ["ёж", "ёж", "ëж"],
    ["50 K", "50 " + chr(0x212A), "５０ K"],
    ["日本 語", "日本　語"],
    ["한글", unicodedata.normalize("NFD", "한글")],
    ["fill er", "fi\u3164ll er", "fi\uffa0ll er", "fi" + chr(0xE0100) + "ll er", "fi\u2062ll er", "fi" + chr(0xE0001) + "ll er"],
    ["\U0001d400bc script", "\U0001d49c\U0001d4b7c script", "\uff21bc \U0001d601cript".replace("\U0001d601", "s"), "Abc script"],
    ["part \u2163", "part IV"],
    ["d\u01c6", "dd\u017e", "ddz\u030c"],
    ["\u043aappa", "\u03baappa", "kappa"],
    ["\ua4e0\ua4f2SU", "\ua4e0\ua4f2\ua4e2\ua4f4", "NISU"],
    ["q" + chr(0x323) + chr(0x301), "q" + chr(0x301) + chr(0x323)],
]
DIFFERENT = [["a", "A"], ["é", "e"], ["x²", "x2"], ["①", "1"], ["ß", "ss"], ["a-b", "a–b"], ["a\nb", "a\r\nb"], ["a b", "a  b"], ["a\x07", "a"], ["a\x07", "a\x1b"], ["0", "O"], ["a\tb", "a b"], ["\u0131", "i"], ["l1", "I1"], ["a?", "a!"], ["?", "!"], ["5 \u0660", "5 \u06f0"], ["\u2776!", "\u2460!"], ["(x)", "x"], ["\U0001d7d8", "0"], ["x\u0378y", "xy"]]


def test_same_and_different(spark):
    texts = [t for group in SAME for t in group] + [t for group in DIFFERENT for t in group]
    want, at = [], 0
    for group in SAME:
        want += [(at + i, at + j) for i in range(len(group)) for j in range(i + 1, len(group))]
        at += len(group)
    assert pairs(spark, texts) == sorted(want, key=repr)


def test_the_rough_hash_is_shared():
    """Case, accents, spaces, punctuation and composition have no part in it; digits and signs have."""
    for c in [*range(0x20, 0xD800), *range(0xF900, 0xFFFE), *range(0x10000, 0x20000)]:
        f = looks(f"a{chr(c)}b")
        if f is not None:
            assert {rough(unicodedata.normalize(form, f)) for form in ("NFC", "NFD")} == {rough(f)}, hex(c)
    assert rough("Ab-c, 1") == rough("abc1") == rough("äb\u0301C\u20001") != rough("abc2")
    assert len({rough(x) for x in ("a0", "a\u0660", "a\u06f0", "a\u2460", "a\u2776", "a")}) == 6


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abé 1-ßжё\u0301한"), min_size=3, max_size=12), st.integers(0, 12), st.sampled_from(["\u200b", "\u3164", "\u180b", "\U000e0100", "\ufeff"]))
def test_unseen_changes_keep_form_and_hash(text, at, unseen):
    base = looks(text)
    for changed in (text[:at] + unseen + text[at:], text.replace(" ", "\u2003"), text.replace("a", "\u0430"), text.replace("b", "\uff42")):
        assert looks(changed) == base or looks(unicodedata.normalize("NFC", changed)) == base
    assert base is None or rough(looks(unicodedata.normalize("NFD", text))) == rough(base)


def test_nulls_blanks_and_copies(spark):
    assert pairs(spark, [None, None, "", "​", " ", " ", "copy", "copy", "сору", "c" * 50_000]) == sorted([(6, 8), (7, 8)], key=repr)
    assert pairs(spark, []) == []


def test_canonical_member(spark):
    df = spark.createDataFrame([(5, "a b", 1, "x"), (3, "a b", 1, "x"), (3, "a b", 1, "x"), (None, "a b", 1, "x")], SCHEMA)
    assert sorted((r.doc_id, r.canonical) for r in look_alike_classes(df).collect()) == [(3, 3), (5, 3)]


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    found = rows_of(catalog.p8_found(spark, at).select("doc_a", "doc_b"))
    assert found and found == sql_rows(at, catalog.p8_sql(), ["doc_a", "doc_b"])


def test_classes_equal_sql(spark):
    at, columns = "/root/testdata/sf0.01", ["doc_id", "canonical"]
    rows = rows_of(catalog.p8_classes(spark, at).select(columns))
    assert rows and rows == sql_rows(at, catalog.p8_classes_sql(), columns)
