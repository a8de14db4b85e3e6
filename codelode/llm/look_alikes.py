"""Problem 8: bringing visually identical texts to one form.

Method: every character is mapped to the plain one it looks like, in Arrow batches; the mapped texts are
grouped under the accent-sensitive collation UNICODE in SQL, which decides what is equal; the smallest
document of a class is its canonical member and is joined back. Only documents that may have a companion
are exchanged for that: a rough hash, of letters and digits without case and accents, is shared by all
texts that look the same, and texts without another string under it stay behind. Digits of other scripts
and ringed digits, which the collation holds equal to others although the difference is seen, count in the hash.
(With the mapping as a JVM ``translate`` the query took 42.9 s over 10,000 documents instead of 2.4 s.)
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.pairs import pairs_within
from codelode.session import cut, sent_if_small, spread

# Letters of other scripts and the letters that they look like, as in the public list of
# confusable characters, within one case. Others may be given as a parameter.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀѴаеорсухѕіјһԁԛԝӏѵгүҽѡꙇћӕк", "ABESIJKMHOPCTYXYGQWIVaeopcyxsijhdqwlvryewiħæk")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϒϜϺϳοανιρυκϲγσϱϸβϐ", "ABEZHIKMNOPTYXCJYFMjoavipukcyopþßß")
ARMENIAN = ("ՍՏԼՕօսհոցզագռք", "USLOouhngqwqnf")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴᎩᎬᎽᏒᏔᏕᏳꭵꮁꮃꮓꮩꮪꮯ", "DRTAJWMHGZSVLCPKBYEYRWSGirwzvsc")
COPTIC = ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⳐⲅⲟⲣⲥ", "HIKMNOPCTYXLropc")
LISU = ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU")
# Where joined letters and Roman numeral signs stand; what they consist of is Unicode's.
JOINED = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
# Single characters that are the same as another one by name only.
SAME = {"\u212a": "K", "\u212b": "\u00c5", "\u2126": "\u03a9", "\u00b5": "\u03bc"}


def _all(pattern: str) -> list[str]:
    """The characters that have a Unicode property."""
    return regex.findall(pattern, "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))


def _fonts() -> dict[str, str]:
    """Letters that are another one in a typeface of their own (mathematical ones)."""
    shapes = {c: unicodedata.normalize("NFKC", c) for c in _all(r"\p{L}") if unicodedata.decomposition(c).startswith("<font>")}
    return {c: plain for c, plain in shapes.items() if len(plain) == 1}


def _letters() -> dict[str, str]:
    return {a: b for others, plain in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU) for a, b in zip(others, plain, strict=True)}


@cache
def folding() -> dict[str, str]:
    """What each character becomes: one form for all that look the same.

    Line breaks, tabs and letter case stay, as do accents, digits, superscripts and punctuation.
    """
    letters = _letters()
    table = dict.fromkeys(_all(r"\p{Default_Ignorable_Code_Point}"), "")
    table |= {chr(c): " " for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs"}
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | SAME | letters
    table |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in JOINED for c in range(a, b + 1)}
    table |= {c: letters.get(plain, plain) for c, plain in _fonts().items()}
    for c in [*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)]:
        whole = unicodedata.normalize("NFD", chr(c))
        if chr(c) not in table and whole != chr(c) and whole[0] in letters:
            table[chr(c)] = unicodedata.normalize("NFC", letters[whole[0]] + whole[1:])
    return table


def fold(text: str) -> str:
    """The mapped text with composed accents, for use outside SQL."""
    if text.isascii():
        return text
    if _search(False)(text):
        text = text.translate(_translation())
    return unicodedata.normalize("NFC", text)


@cache
def _translation() -> dict[int, str]:
    return {ord(k): v for k, v in folding().items()}


@cache
def caseless() -> dict[int, str]:
    """For lower-cased text: small letters also take the plain form of their capital, unless they have their own."""
    letters = _letters()
    small = {a.lower(): b.lower() for a, b in letters.items() if a.lower() not in letters and len(a.lower()) == 1}
    return _translation() | {ord(k): v for k, v in small.items()}


@cache
def _search(small: bool) -> Callable[[str], re.Match | None]:
    """Finds whether anything in a text may be mapped; most texts are spared the slower mapping.

    Characters beyond the basic plane are rare and all count, as a class of many spans is slow to search.
    """
    spans: list[list[int]] = [[0x10000, 0x10FFFF]]
    for c in sorted(c for c in (caseless() if small else _translation()) if c < 0x10000):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]").search


def fold_case(text: str) -> str:
    """The mapped text in one case."""
    if text.isascii():
        return text.lower()
    small = unicodedata.normalize("NFD", fold(text).lower())
    if _search(True)(small):
        small = small.translate(caseless())
    return unicodedata.normalize("NFC", small)


#: Control characters, which the collation would ignore, become private-use ones and so stay different.
_CONTROLS = {c: chr(0xE000 + c) for c in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0)]}
_HAS_CONTROL = re.compile("[" + "".join(map(re.escape, map(chr, _CONTROLS))) + "]")
_SEEN = re.compile("[^\\s\ue000-\ue09f]")
#: All but letters, ASCII digits and what stands for controls; how the rest counts is the collation's matter,
_UNSEEN = regex.compile(r"[^\p{L}0-9\ue000-\ue09f]+")
_ASCII_UNSEEN = bytes(c for c in range(128) if not chr(c).isalnum())
#: except for what it holds equal although it is seen: digits of other scripts, ringed ones, signs that enclose digits.
_SEEN_APART = regex.compile(r"[[\p{N}\p{S}\p{Cf}]--[\p{Default_Ignorable_Code_Point}\x00-\x7f]]", regex.V1)


def looks(text: str) -> str | None:
    """The mapped text with composed accents; None if there is nothing to see."""
    found = fold(text)
    if _HAS_CONTROL.search(found):
        found = found.translate(_CONTROLS)
    return found if _SEEN.search(found) else None


def rough(text: str) -> int:
    """A hash shared by all texts that look the same: letters and digits without case, and signs apart."""
    if text.isascii():
        return xxhash.xxh3_64_intdigest(text.lower().encode().translate(None, _ASCII_UNSEEN))
    plain = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    plain = _UNSEEN.sub("", unicodedata.normalize("NFKD", plain.casefold()))
    apart = _SEEN_APART.findall(unicodedata.normalize("NFD", text))
    return xxhash.xxh3_64_intdigest(plain + "\0" + "".join(apart) if apart else plain)


def _mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (k, text): (k, looks, rough, h)."""
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    for batch in batches:
        texts = batch.column(1).to_pylist()
        forms = [looks(t) for t in texts]
        kept = [k for k, f in enumerate(forms) if f is not None]
        shown = [forms[k] for k in kept]
        own = [xxhash.xxh3_64_intdigest(texts[k]) for k in kept]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(shown, pa.string()), signed([rough(f) for f in shown]), signed(own)], names=["k", "looks", "rough", "h"])


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, canonical, text_hash) of every document whose text looks like another, different one.

    ``canonical`` is the smallest key of the class, ``text_hash`` tells different strings apart. Null,
    empty and blank texts, also those of invisible characters only, belong to no class, and neither do
    texts whose only companions are the same string. Rows with a null key are left out; repeated rows
    count once; other columns are never read. An empty table gives an empty result.
    """
    narrow = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).where("k is not null and text is not null")
    kind = narrow.schema["k"].dataType.simpleString()
    keyed = spread(narrow).mapInArrow(_mapper, f"k {kind}, looks string, rough long, h long")
    mixed = keyed.groupBy("rough").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("rough")
    found = cut(keyed.join(sent_if_small(mixed), "rough", "left_semi").select("k", "h", "looks").distinct())
    cand = found.select("k", "h", F.expr("looks collate UNICODE").alias("looks"))
    spark = df.sparkSession
    return spark.sql(
        f"""
        WITH canon AS (SELECT looks, min(k) AS canonical FROM {{cand}} GROUP BY looks HAVING min(h) <> max(h))
        SELECT c.k AS `{key}`, n.canonical, c.h AS text_hash FROM {{cand}} c JOIN canon n ON c.looks = n.looks
        """,
        cand=cand,
    )


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents that look the same but are not the same string.

    Different strings of a class are paired first and documents joined to them, so copies of one string
    are never held against each other.
    """
    classes = cut(look_alike_classes(df, key, text).select(F.col(f"`{key}`").alias("k"), "canonical", "text_hash"))
    different = pairs_within(classes.select("canonical", "text_hash").distinct(), ["canonical"], "text_hash").withColumnsRenamed({"x": "ha", "y": "hb"})
    left = classes.select("canonical", F.col("text_hash").alias("ha"), F.col("k").alias("x"))
    right = classes.select("canonical", F.col("text_hash").alias("hb"), F.col("k").alias("y"))
    pairs = different.join(left, ["canonical", "ha"]).join(right, ["canonical", "hb"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
