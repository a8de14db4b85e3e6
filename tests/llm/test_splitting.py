from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm.splitting import Limits, agglomerate, boundary, lines_of, merged_pieces, pieces, split_oversized

LINES = st.lists(st.sampled_from(["a", "", "  ", "}", "  });", "b }"]), max_size=420)


def plain(lines, limits):
    """The rule word by word."""
    found, s = [], 0
    while True:
        if len(lines) - s <= limits.most:
            return [*found, (s, len(lines) - 1)]
        window = list(range(s + limits.least - 1, s + limits.most))
        blank = [k for k in window if not lines[k].strip()]
        brace = [k for k in window if lines[k].strip().startswith("}")]
        end = max(blank) if blank else max(brace) if brace else window[-1]
        found.append((s, end))
        s = end + 1 - limits.overlap


@settings(max_examples=200, deadline=None)
@given(LINES)
def test_pieces_follow_the_rule(lines):
    lines = lines or ["x"]
    assert pieces(lines, Limits()) == plain(lines, Limits())


@settings(max_examples=200, deadline=None)
@given(LINES, st.integers(1, 30), st.integers(0, 30), st.integers(0, 8))
def test_other_limits_follow_the_rule(lines, least, more, overlap):
    limits = Limits(least + more + overlap + 1, least + overlap, overlap)
    assert pieces(lines or ["x"], limits) == plain(lines or ["x"], limits)


def naive(sizes, strengths, most, overlap, first):
    """The merging with every pair looked at again before each merge."""
    segments = [[k] for k in range(len(sizes))]
    refused = set()
    while True:
        open_ = []
        for k in range(len(segments) - 1):
            left, right = segments[k], segments[k + 1]
            size = sum(sizes[x] for x in left + right)
            if size + (0 if k == 0 and first else overlap) <= most:
                open_.append((strengths[left[-1]], size, left[0], k))
        if not open_:
            return [x[-1] for x in segments]
        k = min(open_)[-1]
        segments[k : k + 2] = [segments[k] + segments[k + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 2)), min_size=1, max_size=40), st.integers(4, 20), st.integers(0, 3), st.booleans())
def test_merging_equals_the_naive_form(atoms, most, overlap, first):
    sizes, strengths = [a for a, _ in atoms], [(b,) for _, b in atoms]
    assert agglomerate(sizes, strengths, most, overlap, first) == naive(sizes, strengths, most, overlap, first)


def test_merges_are_refused_by_size():
    # the weakest boundary stays where its neighbours are full, although stronger ones are merged
    assert agglomerate([3, 3, 1, 1], [(0,), (1,), (2,), (9,)], 5) == [0, 3]
    assert agglomerate([3, 3, 1, 1], [(0,), (1,), (2,), (9,)], 5, overlap=1) == [0, 2, 3]
    assert agglomerate([9, 1, 1], [(0,), (0,), (0,)], 5) == [0, 2]
    assert agglomerate([], [], 5) == [] and agglomerate([1], [(0,)], 5) == [0]


@settings(max_examples=100, deadline=None)
@given(LINES)
def test_merged_pieces_fit_cover_and_overlap(lines):
    limits = Limits()
    found = merged_pieces(lines, limits)
    assert all(b - a < limits.most for a, b in found)
    assert [b for _, b in found][-1:] == ([len(lines) - 1] if lines else [])
    assert all(y[0] == max(0, x[1] + 1 - limits.overlap) for x, y in zip(found, found[1:]))


def test_merged_pieces_end_at_natural_boundaries(spark):
    lines = (["x"] * 30 + ["}"] + ["y"] * 30 + [""]) * 5 + ["z"]
    ends = [b for _, b in merged_pieces(lines, Limits())]
    assert all(boundary(lines[b]) for b in ends[:-1])
    df = spark.createDataFrame([("a", "\n".join(lines), 1)], "id string, code string, start_line int")
    assert [r.last_line - 1 for r in sorted(split_oversized(df, anchored=False).collect(), key=lambda r: r.piece_no)] == ends


def test_lines():
    assert lines_of("a\nb\n") == ["a", "b"]
    assert lines_of("a\r\nb") == ["a\r", "b"]
    assert lines_of("a\n\n") == ["a", ""]


def test_split_frame(spark):
    long = "\n".join(["x"] * 200) + "\n"
    exact = "\n".join(["x"] * 100) + "\n"
    rows = [("a", long, 11), ("a", long, 11), ("b", exact, 1), ("c", None, 1), ("d", "", None), (None, long, None), ("e", "y" * 300_000, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, code string, start_line int, piece_no int")
    found = sorted(map(tuple, split_oversized(df).collect()), key=repr)
    one = [(1, 0, 99), (2, 95, 194), (3, 190, 199)]
    assert found == sorted([("a", n, 11 + a, 11 + b) for n, a, b in one] + [(None, n, 1 + a, 1 + b) for n, a, b in one], key=repr)
    assert split_oversized(df.limit(0)).collect() == []


def test_query_equals_sql(spark):
    from codelode.llm import catalog

    from .oracle import rows_of, sql_rows

    at, columns = "/root/testdata/sf0.01", ["id", "piece_no", "first_line", "last_line"]
    rows = rows_of(catalog.p3_found(spark, at).select(columns))
    assert rows and rows == sql_rows(at, catalog.P3_SQL, columns)
