"""Problem 4: records that share most of their content, by a parity-sketch join.

Method: a text is the set of its runs of three tokens. If two sets are similar enough, their symmetric
difference is at most d, which follows from their sizes. Elements are dealt to more than d parts by their
hash, and the XOR of each part's element hashes is the parity sketch of that part: at most d parts
can differ, so at least one agrees (pigeonhole), and equal (part, sketch) keys are joined. Sizes fall
into bands (levels) with their own number of parts. Candidates are held against short whole-set parity
sketches, whose Hamming distance is a lower bound of the symmetric difference, and those that are left
are verified with the sets themselves.

Equal sets are one class from the start, so copies are never joined with each other. A key that more than
``few`` classes share says little (a part that holds nothing but boilerplate, or a large family): its
members are joined to their sketches and only pairs whose sketches are near enough are ever written.
Of these keys each set first leaves out the most frequent that it can spare: of its parts that are not empty
at most d differ from a similar set's, so with n of them such a set shares n - d keys or more, and the rarest of
these is still there when both have left out up to n - d - 1, the most frequent first.
Above ``many`` members the key is refined before that by the keys of the other parts under a second
dealing, which is again a pigeonhole argument. At the last depth a key of more members is cut into blocks,
and pairs of blocks are dealt to tasks. Hot keys are a table all the time; none is sent to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.parity import Sets, mixed, sets_of
from codelode.operators.pairs import pairs_within
from codelode.session import SMALL_ROWS, cut, sent_if_small, spread

#: Bits of a class number that hold its set's size: exact below EXACT, then STEPS steps for every doubling.
SIZE_BITS = 13
SIZE_MASK = (1 << SIZE_BITS) - 1
EXACT, STEPS = 4096, 128
#: Bits of a key that hold its level.
LEVEL_BITS = 5
LAST_LEVEL = (1 << LEVEL_BITS) - 1
#: Parts of the smallest sets: enough that a difference and all common elements never share them.
LEAST_PARTS = 256
_LOW = np.uint64(LAST_LEVEL)


def size_code(size: np.ndarray) -> np.ndarray:
    """Sizes as ``SIZE_BITS`` bits, in their order."""
    e = np.maximum(np.floor(np.log2(np.maximum(size, 1) / EXACT)), 0).astype(np.int64)
    e -= (EXACT << e) > np.maximum(size, EXACT)
    base = EXACT << e
    return np.where(size < EXACT, size, EXACT + e * STEPS + (size - base) * STEPS // base)


def size_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest size that has a code."""
    k = np.maximum(code - EXACT, 0)
    base = np.int64(EXACT) << (k // STEPS)
    low = base + k % STEPS * (base // STEPS)
    exact = code < EXACT
    return np.where(exact, code, low), np.where(exact, code, low + base // STEPS - 1)


@dataclass(frozen=True)
class Rule:
    """What counts as similar, and how keys are cut and refined."""

    run: int = 3
    least_tokens: int = 40
    similarity: Fraction = Fraction(7, 10)
    few: int = 6
    many: int = 8192
    depth: int = 3
    exact: bool = False

    @property
    def share(self) -> float:
        """The largest symmetric difference as a share of both sizes together."""
        return float((1 - self.similarity) / (1 + self.similarity))

    def difference(self, total: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of similar sets whose sizes make this total."""
        return np.floor(total * self.share + 1e-9).astype(np.int64)

    def level(self, total: np.ndarray) -> np.ndarray:
        """The band of a pair: 0 up to a difference of 8, then one for every doubling."""
        d = np.maximum(self.difference(total), 1)
        return np.where(d <= 8, 0, np.minimum(np.maximum(np.ceil(np.log2(d) - 3), 1), LAST_LEVEL)).astype(np.int64)

    def parts(self, level: int) -> int:
        """Parts at a level, a fifth more than its largest difference; 0: every element is a part (``exact``)."""
        return 0 if self.exact else max(int(1.2 * 8 * 2**level) + 1, LEAST_PARTS if level == 0 else 0)

    def words(self, level: int) -> int:
        """64-bit words of a whole-set sketch: about two bits for an element of the level's sets, at most 16384 bits."""
        return 2 ** min(max(level - 1, 2), 8)

    def levels(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest band of pairs that a set of each size can be in."""
        near = float(self.similarity)
        return self.level(sizes + np.ceil(near * sizes - 1e-9)), self.level(sizes + np.floor(sizes / near + 1e-9))

    def most_differing(self, sizes: np.ndarray, level: int) -> np.ndarray:
        """The largest symmetric difference of sets of these sizes and any that are similar to them, at one level."""
        most = self.difference(sizes + sizes * self.similarity.denominator // self.similarity.numerator)
        return most if level == LAST_LEVEL else np.minimum(most, 8 * 2**level)


def _salt(depth: int, level: int) -> int:
    return 1000 * depth + 10 * level


def _keys(sets: Sets, rule: Rule, depth: int, level: np.ndarray | None, parent: np.ndarray | None) -> Iterator[tuple[int, object]]:
    """(level, parts) of all sets at one depth; with ``level`` given, each set only at its own."""
    low, high = rule.levels(sets.sizes) if level is None else (level, level)
    if not len(low):
        return
    for k in range(int(low.min()), int(high.max()) + 1):
        which = (low <= k) & (k <= high) & (sets.sizes > 0)
        if which.any():
            found = sets.part_keys(which, rule.parts(k), _salt(depth, k))
            if parent is not None:
                found.key = mixed(found.key ^ parent[found.owner], depth)
            found.key = (found.key & ~_LOW) | np.uint64(k)
            yield k, found


def _own(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Keys as those of one set only."""
    return key ^ mixed(number.astype(np.uint64), 77)


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def sign(sets: Sets, rule: Rule, hot: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) at the depth after the last of ``hot``, the keys to refine of each depth, as ``_own`` gives them, sorted."""
    origin = np.arange(len(sets.begins) - 1)
    level = parent = None
    for depth, keys in enumerate(hot, 1):
        owners, parents, levels, rests = [], [], [], []
        for k, found in _keys(sets, rule, depth, level, parent):
            hit = _in(keys, _own(found.key, origin[found.owner]))
            owner = found.owner[hit]
            if k == 0 and depth > 1:  # small sets must not run out of elements: the key itself goes on
                rest = Sets(found.key[hit], np.arange(len(owner) + 1))
            else:
                rest = sets.without(owner, found.part[hit], rule.parts(k), _salt(depth, k))
            owners.append(origin[owner])
            parents.append(found.key[hit])
            levels.append(np.full(len(owner), k))
            rests.append(rest)
        if not owners:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        sizes = np.concatenate([r.sizes for r in rests])
        sets = Sets(np.concatenate([r.elements for r in rests]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        origin, parent, level = np.concatenate(owners), np.concatenate(parents), np.concatenate(levels)
    found = [(origin[p.owner], p.key) for _, p in _keys(sets, rule, len(hot) + 1, level, parent)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([o for o, _ in found]), np.concatenate([k for _, k in found])


def class_numbers(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set, equal for equal sets: 51 bits of a hash with the size, and 64 of another hash."""
    high = (sets.fingerprints() >> np.uint64(SIZE_BITS)) << np.uint64(SIZE_BITS)
    return (high | size_code(sets.sizes).astype(np.uint64)).view(np.int64), sets.fingerprints(3).view(np.int64)


def _sets(column: pa.ListArray) -> Sets:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return Sets(values.astype(np.int64).view(np.uint64), (offsets - offsets[0]).astype(np.int64))


def _reader(rule: Rule, at_once: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                sets = sets_of(batch.column(1).to_pylist(), rule.run, rule.least_tokens)
                some = np.flatnonzero(sets.sizes)
                lists = pa.ListArray.from_arrays(pa.array(sets.begins[np.append(some, len(sets.begins) - 1)].astype(np.int32)), pa.array(sets.elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *(pa.array(x[some]) for x in class_numbers(sets)), lists], names=["id", "class", "check", "elements"])

    return read


def _level_sketches(sets: Sets, rule: Rule, owner: np.ndarray, level: np.ndarray) -> pa.Array:
    """The sketch of each (set, level) as bytes."""
    found: list[bytes | None] = [None] * len(owner)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        used, back = np.unique(owner[at], return_inverse=True)
        part = sets.only(used)
        rows = [r.tobytes() for r in part.sketches(rule.words(k))]
        for i, r in zip(at.tolist(), back.tolist()):
            found[i] = rows[r]
    return pa.array(found, pa.binary())


def _signer(rule: Rule, depth: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (class, elements, the keys to refine of each depth before): (key, class) at a depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            lists = [batch.column(k) for k in range(2, 1 + depth)]
            hot = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in lists]
            hot = [np.sort(_own(keys, np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())))) for keys, x in zip(hot, lists)]
            if all(map(len, hot)):
                owner, key = sign(_sets(batch.column(1)), rule, hot)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(number[owner])], names=["key", "class"])

    return run


def _sketcher(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(class, level, sketch) for all levels of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            sets = _sets(batch.column(1))
            low, high = rule.levels(sets.sizes)
            owner = np.repeat(np.arange(len(low)), high - low + 1)
            level = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(number[owner]), pa.array(level.astype(np.int32)), _level_sketches(sets, rule, owner, level)], names=["class", "level", "sketch"])

    return run


def spare(sets: Sets, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, level, how many of its keys at the first depth the set can leave out), where there are any."""
    low, high = rule.levels(sets.sizes)
    found = [(np.empty(0, np.int64),) * 3]
    for k in range(int(low.min()), int(high.max()) + 1) if len(low) else ():
        which = (low <= k) & (k <= high) & (sets.sizes > 0)
        n = sets.parts_hit(which, rule.parts(k), _salt(1, k)) - rule.most_differing(sets.sizes[which], k) - 1
        found.append((np.flatnonzero(which)[n > 0], np.full(int((n > 0).sum()), k), n[n > 0]))
    owner, level, number = (np.concatenate(x) for x in zip(*found))
    return owner, level, number


def _sparer(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(class, level, spare) of every set that can leave out keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, level, number = spare(_sets(batch.column(1)), rule)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(level.astype(np.int32)), pa.array(number.astype(np.int32))], names=["class", "level", "spare"])

    return run


def _similar_sizes(a: np.ndarray, b: np.ndarray, level: np.ndarray, rule: Rule) -> np.ndarray:
    """Pairs whose sizes allow the similarity and may belong to the level they met at."""
    (a_low, a_high), (b_low, b_high) = size_bounds(a & SIZE_MASK), size_bounds(b & SIZE_MASK)
    ratio = np.minimum(a_high, b_high) * rule.similarity.denominator >= np.maximum(a_low, b_low) * rule.similarity.numerator
    return ratio & (rule.level(a_low + b_low) <= level) & (level <= rule.level(a_high + b_high))


def _largest_difference(a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    return rule.difference(size_bounds(a & SIZE_MASK)[1] + size_bounds(b & SIZE_MASK)[1])


def _batch(hot: bool, x: np.ndarray, y: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(x), hot)), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(level, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["hot", "x", "y", "level"])


def _pairer(rule: Rule, few: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, class), ordered: the pairs of keys that up to ``few`` classes share, and the members of other keys.

    Members are given as they come; only up to ``few`` of them are ever held for the key that is open.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, spilling = np.empty(0, np.int64), np.empty(0, np.int64), False
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if not len(new[0]):
                    continue
                if spilling and new[0][0] != keys[-1]:
                    keys, classes, spilling = keys[:0], classes[:0], False
                keys, classes = np.concatenate([keys, new[0]]), np.concatenate([classes, new[1]])
                keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])])
                keys, classes = keys[keep], classes[keep]
            if not len(keys):
                continue
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(begins[1:], len(keys))
            size = ends - begins
            closed = np.full(len(begins), True)
            closed[-1] = batch is None
            hot = size > few
            if spilling:  # the first run is known to be hot, and its one held member has been given
                hot[0] = True
            given = np.repeat(hot, size)
            if spilling:
                given[:1] = False
            if given.any():
                yield _batch(True, keys[given], classes[given], np.zeros(int(given.sum()), np.int32))
            a, b, at = [], [], []
            some = closed & ~hot & (size > 1)
            for n in np.unique(size[some]).tolist():
                left, right = np.triu_indices(n, 1)
                start = begins[some & (size == n)][:, None]
                a.append(classes[start + left].ravel())
                b.append(classes[start + right].ravel())
                at.append(np.repeat(keys[start[:, 0]], len(left)))
            if a:
                x, y, key = np.concatenate(a), np.concatenate(b), np.concatenate(at)
                fits = _similar_sizes(x, y, key & LAST_LEVEL, rule)
                pairs = np.unique(np.stack([x[fits], y[fits], key[fits] & LAST_LEVEL], axis=1), axis=0)
                yield _batch(False, *pairs.T)
            if batch is not None:
                spilling = bool(hot[-1])
                from_ = len(keys) - 1 if spilling else begins[-1]
                keys, classes = keys[from_:], classes[from_:]

    return pair


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each (key, part) together, from rows in that order."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            here = (key[begin], part[begin])
            if held and here != mark:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            mark = here
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _comparer(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, part, side, class, sketch): pairs under one part of a key whose sketches are near enough.

    Side 0 is held against itself, side 1 against side 2.
    """

    def near(level: int, classes: list[np.ndarray], sketches: list[np.ndarray], same: bool) -> Iterator[pa.RecordBatch]:
        order = [np.argsort(c & SIZE_MASK, kind="stable") for c in classes]
        (a, b), (sa, sb) = ([c[o] for c, o in zip(x, order)] for x in (classes, sketches))
        low, high = size_bounds(b & SIZE_MASK)
        for at in range(0, len(a), 128):
            mine = a[at : at + 128]
            least, most = size_bounds(mine & SIZE_MASK)
            # members come by size, so partners of these are a span of the others
            begin = at if same else int(np.searchsorted(high, math.ceil(int(least[0]) * rule.similarity), side="left"))
            stop = int(np.searchsorted(low, math.floor(int(most[-1]) / rule.similarity), side="right"))
            for to in range(begin, stop, 4096):
                theirs = b[to : min(to + 4096, stop)]
                distance = np.zeros((len(mine), len(theirs)), np.int64)
                for word in range(sa.shape[1]):
                    distance += np.bitwise_count(sa[at : at + 128, None, word] ^ sb[None, to : to + len(theirs), word])
                fits = distance <= np.floor((most[:, None] + high[None, to : to + len(theirs)]) * rule.share + 1e-9)
                if same:
                    fits &= np.arange(at, at + len(mine))[:, None] < np.arange(to, to + len(theirs))[None, :]
                i, j = np.nonzero(fits)
                x, y = np.minimum(mine[i], theirs[j]), np.maximum(mine[i], theirs[j])
                right = (x != y) & _similar_sizes(x, y, np.int64(level), rule)
                if right.any():
                    yield _batch(False, x[right], y[right], np.full(int(right.sum()), level))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            key = group.column(0)[0].as_py()
            side, classes = (group.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            words = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint64).reshape(group.num_rows, -1)
            same = side[0] == 0
            of = [np.full(len(side), True)] * 2 if same else [side == 1, side == 2]
            yield from near(key & LAST_LEVEL, [classes[x] for x in of], [words[x] for x in of], same)

    return compare


def _filter(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (x, y, sketch of x, sketch of y): the pairs whose sketches are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            bits = np.frombuffer(b"".join(a), np.uint64) ^ np.frombuffer(b"".join(b), np.uint64)
            ends = np.cumsum([len(v) // 8 for v in a])
            total = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            distance = np.diff(total[np.concatenate([[0], ends]).astype(np.int64)])
            fits = distance <= _largest_difference(x, y, rule)
            yield pa.RecordBatch.from_arrays([pa.array(x[fits]), pa.array(y[fits])], names=["x", "y"])

    return run


def _met(rows: DataFrame, function) -> DataFrame:
    ordered = rows.repartition("key").sortWithinPartitions("key", "class")
    return cut(ordered.mapInArrow(function, "hot boolean, x long, y long, level int"))


def _members(met: DataFrame) -> DataFrame:
    return met.where("hot").select(F.col("x").alias("key"), F.col("y").alias("class"))


def _thinned(members: DataFrame, spares: DataFrame) -> DataFrame:
    """(key, class) without the most frequent keys that a class can spare at each level; no pair is lost.

    The order (frequency, then key) is the same for all classes, so two that share more keys than either leaves out
    still share the rarest of them. Keys that are no members' are rarer than all of these.
    """
    often = sent_if_small(members.groupBy("key").agg(F.count("*").alias("n")))
    levelled = members.join(often, "key").withColumn("level", F.col("key").bitwiseAND(F.lit(LAST_LEVEL)).cast("int"))
    order = Window.partitionBy("class", "level").orderBy(F.col("n").desc(), "key")
    ranked = levelled.join(spares, ["class", "level"], "left").withColumn("rank", F.rank().over(order))
    return cut(ranked.where(F.col("rank") > F.coalesce("spare", F.lit(0))).select("key", "class"))


def _near_by_sketch(members: DataFrame, large: DataFrame | None, sketches: DataFrame, rule: Rule) -> DataFrame:
    """(x, y): classes with a key in common whose sketches are near; keys in ``large`` (key, n) come in blocks."""
    dealt = members.select("key", "class", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"))
    if large is not None:
        blocked = members.join(sent_if_small(large), "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / F.lit(rule.many)), F.lit(1)).cast("long"))
        own = blocked.withColumn("own", F.pmod(F.xxhash64("class"), "blocks"))
        both = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        dealt = both.select("key", "class", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"), side.alias("side"))
    levelled = dealt.withColumn("level", F.col("key").bitwiseAND(F.lit(LAST_LEVEL)).cast("int"))
    rows = levelled.join(sketches, ["class", "level"]).select("key", "part", "side", "class", "sketch")
    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(_comparer(rule), "hot boolean, x long, y long, level int").select("x", "y")


def _candidates(contents: DataFrame, sketches: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(x, y), x < y: pairs of classes with a key in common: those not compared yet (with level), and those near by sketch."""
    schema = "key long, class long"
    met = _met(contents.select("class", "elements").mapInArrow(_signer(rule), schema), _pairer(rule, rule.few))
    pairs, near = met.where("not hot").select("x", "y", "level").distinct(), met.where("false").select("x", "y")
    members, chain = _thinned(_members(met), contents.select("class", "elements").mapInArrow(_sparer(rule), "class long, level int, spare int")), []
    for depth in range(1, rule.depth + 1):
        large = cut(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > rule.many))
        if large.isEmpty():
            return pairs, near.unionAll(_near_by_sketch(members, None, sketches, rule))
        if depth == rule.depth:
            return pairs, near.unionAll(_near_by_sketch(members, large, sketches, rule))
        keys = sent_if_small(large.select("key"))
        near = near.unionAll(_near_by_sketch(members.join(keys, "key", "left_anti"), None, sketches, rule))
        # the keys to refine of each class, not more than its set has parts
        refined = cut(members.join(keys, "key", "left_semi").groupBy("class").agg(F.collect_set("key").alias(f"keys{depth}")))
        held = refined.agg(F.sum(F.size(f"keys{depth}"))).first()[0] or 0
        chain.append(F.broadcast(refined) if held <= SMALL_ROWS // 2 else refined)  # else the sets would be exchanged
        rows = reduce(lambda left, right: left.join(right, "class"), reversed(chain), contents)
        rows = rows.select("class", "elements", *(f"keys{k}" for k in range(1, depth + 1)))
        members = _members(_met(rows.mapInArrow(_signer(rule, depth + 1), schema), _pairer(rule, 1)))
    return pairs, near


def near_copies(df: DataFrame, key: str = "id", text: str = "code", rule: Rule | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between different contents, and which records hold which content.

    The first result is (class_a, check_a, class_b, check_b), class_a < class_b: the classes whose sets are
    at least ``rule.similarity`` similar (size of the intersection over that of the union). The second is
    (key, class, check), once for each record with a set. Equal sets are one class. Null texts and texts of fewer than
    ``rule.least_tokens`` tokens have no set; rows with a null key are left out; repeated rows count once;
    other columns are never read; an empty table gives empty results.

    A class is two numbers with 115 bits of hashes. A link is missed only if all common elements fall into
    parts with a difference, less than once in 10^6 links at the threshold and never well above it; with
    ``rule.exact`` every element is a part, no link is missed, and more is exchanged.
    """
    rule = rule or Rule()
    code = F.col(f"`{text}`")
    rows = df.select(F.col(f"`{key}`").alias("id"), code.alias("code")).where(F.col("id").isNotNull() & (F.length(code) >= 2 * rule.least_tokens - 1))
    kind = rows.schema["id"].dataType.simpleString()
    sets = cut(spread(rows).mapInArrow(_reader(rule), f"id {kind}, class long, check long, elements array<long>").withColumn("row", F.monotonically_increasing_id()))
    # one record stands for each class; only classes of several records are looked up
    several = sets.groupBy("class", "check").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "check", "first")
    contents = sets.select("class", "check", "row", "elements").join(sent_if_small(several), ["class", "check"], "left").where("first is null or first = row").select("class", "check", "elements")
    sketches = contents.select("class", "elements").mapInArrow(_sketcher(rule), "class long, level int, sketch binary")
    pairs, near = _candidates(contents, sketches, rule)

    a = sketches.select(F.col("class").alias("x"), "level", F.col("sketch").alias("a"))
    b = sketches.select(F.col("class").alias("y"), "level", F.col("sketch").alias("b"))
    compared = pairs.join(a, ["x", "level"]).join(b, ["y", "level"]).select("x", "y", "a", "b").mapInArrow(_filter(rule), "x long, y long")
    near = cut(compared.unionAll(near).distinct())

    wanted = sent_if_small(near.select(F.explode(F.array("x", "y")).alias("class")).distinct())
    held = contents.join(wanted, "class", "left_semi")
    left = held.select(F.col("class").alias("class_a"), F.col("check").alias("check_a"), F.col("elements").alias("ea"))
    right = held.select(F.col("class").alias("class_b"), F.col("check").alias("check_b"), F.col("elements").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    similar = common * rule.similarity.denominator >= (F.size("ea") + F.size("eb") - common) * rule.similarity.numerator
    links = near.toDF("class_a", "class_b").join(left, "class_a").join(right, "class_b").where(similar).select("class_a", "check_a", "class_b", "check_b")
    members = sets.select(F.col("id").alias(key), "class", "check").distinct()
    return links, members


def near_copy_pairs(df: DataFrame, key: str = "id", text: str = "code", rule: Rule | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different keys whose texts are similar, copies among them.

    As ``near_copies``, with classes written out. The size of the result is that of the pairs asked for.
    """
    links, members = near_copies(df, key, text, rule)
    links, members = cut(links), members.select(F.col(f"`{key}`").alias("id"), "class", "check")
    a = members.toDF("a", "class_a", "check_a")
    b = members.toDF("b", "class_b", "check_b")
    between = links.join(a, ["class_a", "check_a"]).join(b, ["class_b", "check_b"]).select("a", "b").where("a <> b")
    inside = pairs_within(members, ["class", "check"], "id").select("x", "y")
    pairs = between.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).unionAll(inside.toDF("id_a", "id_b"))
    return pairs.distinct()


def near_copy_classes(df: DataFrame, key: str = "id", text: str = "code", rule: Rule | None = None) -> DataFrame:
    """(key, class_key, links): one row for each record with a set: the smallest key of its class of equal sets, and how many other classes are similar to it.

    As ``near_copies``; nothing is expanded into pairs, so a large group of copies stays one row a record.
    """
    links, members = near_copies(df, key, text, rule)
    ends = links.select(F.explode(F.array(F.struct(F.col("class_a").alias("class"), F.col("check_a").alias("check")), F.struct(F.col("class_b").alias("class"), F.col("check_b").alias("check")))).alias("end"))
    ends = ends.select("end.class", "end.check").groupBy("class", "check").agg(F.count("*").alias("links"))
    of_class = members.groupBy("class", "check").agg(F.min(F.col(f"`{key}`")).alias("class_key")).join(ends, ["class", "check"], "left")
    return members.join(of_class, ["class", "check"]).select(F.col(f"`{key}`"), "class_key", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
