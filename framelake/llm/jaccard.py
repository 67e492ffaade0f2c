"""N-gram Jaccard join: size-aware, with light and heavy sets.

A document's set holds the 64-bit hashes of its distinct 5-word shingles.
Documents whose sets have equal 128-bit names and sizes form one class, of
which one set takes part. Shingles are ordered by how often they repeat (a
bounded list of the most frequent, counted over all documents: shingles
sampled by hash first, then those beside frequent ones) and then by hash. If
sets of n and m shingles are alike enough they have at least
o = ceil(0.75 (n + m) / 1.75) in common, and their first common shingle comes
among the first n - o + 1 of one and m - o + 1 of the other; two common ones
do with one place more. Hence:

* light sets (at most ``boundary`` shingles) enumerate the 2-subsets of their
  first shingles, as many as any partner may ask for, and meet in equal subsets;
* heavy sets post their first shingles to inverted lists, as do light sets
  that are large enough to be like a heavy one.

The boundary is the size at which the number of subsets plus the number of
postings, each weighted by the sets that it meets (measured on the sampled
shingles), is least.

Lists are scanned in two rounds. First every set is held against the pivot of
each of its lists, the set whose place there is the first (as many pairs as
postings); the links found are closed to components. Lists whose sets are then
in different components are scanned in blocks of about ``BLOCK`` sets, two
blocks at a time, for pairs in different components. In both rounds sizes and
places in the list, and then parity sketches of the sets (`_sketch`), rule out
pairs that can't be alike enough; all the rest are compared. Comparisons count
equal 64-bit shingles of the whole sets. So no link that would join two
components is lost. Shingles are carried once for each set and compared in
streams: one set of a pivot stands before its partners, ``PARTNERS`` at most.

Those links span the components. No link leads out of a component, so the rest
are found inside each: a component of two sets has its one link, and of a larger
one all sets are held against one another, two blocks of about ``BLOCK`` at a
time. Where a component has more than ``FEW`` sets and its lists hold far fewer
pairs than it has, its lists are scanned instead. Both ways find all. Links are
counted as they are found, with copies, so that a group of near copies makes no
row for each pair: `Join.counts` has each document's number of links. A run that
is asked for them also lists every link between classes' representatives.

Defined results: null texts, empty ones and those of white space have no
shingles and link with nothing. A row whose doc_id is null has a null
component. Repeated rows are in their own document's component; rows that share
a doc_id but not the text are documents of their own. Columns other than
doc_id and text are left out (`join`) or passed on (`clean`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._arrow import LOWER, NOT_SPACE, mix, slices, span_hashes, utf8, window_hashes, window_starts, words
from framelake.llm._components import components
from framelake.llm._scratch import Scratch, Table
from framelake.llm._sketch import apart, sketches

WORDS = 5
PERCENT = 75
#: Entries of the list of frequent shingles, and of the sampled ones that lead to them, at most; the list orders shingles and decides nothing.
FREQUENT = 1_000_000
SAMPLED = 500_000
#: Documents that make a shingle frequent.
OFTEN = 24
#: Sets of a block of a list, and partners that one copy of a pivot's set is compared with, about.
BLOCK = 128
PARTNERS = 128
_SAMPLE_BITS = 3
_REACH = 16
_RUN = 1_000_000
_LIGHT_MOST = 64
#: Sets of a component that are held against one another without asking how many pairs its lists hold, and what a pair of a list costs of one such.
FEW = 512
LIST_COST = 4
#: Shingles of a block of a component, about, and columns of the matrix by which common ones are counted.
_BLOCK_SHINGLES = 1 << 18
_COLUMNS = 1 << 12
_FILTER_BITS = 22
_PAIRS = 1 << 18


def _in_order(low: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle as it comes."""
    w = words(low, offsets, NOT_SPACE)
    one = span_hashes(low, w.start, w.end)
    at = window_hashes(one, n)
    keep = window_starts(w.first, n)[: len(at)]
    row, found = w.row[: len(at)][keep], at[keep]
    for size in range(1, n):  # a whole text of fewer words
        short = np.flatnonzero(w.count == size)
        if len(short):
            row = np.concatenate((row, short))
            found = np.concatenate((found, window_hashes(one, size)[w.first[short]]))
    return found, row


def _by_row(found: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by row and then hash; rows are few enough to be sorted as 16-bit numbers."""
    order = np.argsort(found)
    return order[np.argsort(row[order].astype(np.uint16), kind="stable")]


def _distinct(found: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    order = _by_row(found, row)
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[new], found[new]
    return found, np.searchsorted(row, np.arange(rows + 1))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row of a slice, ascending, and the rows' offsets in them."""
    return _distinct(*_in_order(LOWER[data], offsets, n), len(offsets) - 1)


def set_keys(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each row's set, in two parts."""
    out = []
    for seed in (7, 17):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(found, seed))))
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64), seed + 1).view(np.int64))
    return out[0], out[1]


@dataclass
class Order:
    """Frequent shingles (sorted) and the level of each; others have level 0."""

    hashes: np.ndarray
    level: np.ndarray
    seen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def __getstate__(self):
        return self.hashes, self.level

    def __setstate__(self, state) -> None:
        self.hashes, self.level = state
        self.__post_init__()

    def levels(self, found: np.ndarray) -> np.ndarray:
        """0 to 63, by how often a shingle is."""
        out = np.zeros(len(found), np.uint8)
        near = np.flatnonzero(self.seen[found >> np.uint64(64 - _FILTER_BITS)])
        if len(near):
            at = np.searchsorted(self.hashes, found[near])
            at[at == len(self.hashes)] = 0
            same = self.hashes[at] == found[near]
            out[near[same]] = self.level[at[same]]
        return out


def least_common(n, percent: int = PERCENT):
    """Shingles that a set of n has in common with any that is alike enough."""
    return -(-(percent * n) // 100)


def boundary(sizes: dict[int, int], weight: float, percent: int = PERCENT) -> int:
    """The size up to which sets are light, by cost: subsets, and weighted postings."""
    n = np.array(sorted(sizes))
    many = np.array([sizes[k] for k in n.tolist()], float)
    room = n - least_common(n, percent)
    subsets, postings = many * (room + 2) * (room + 1) / 2, many * (room + 1) * (1 + weight)
    cost = [subsets[n <= x].sum() + postings[n * 100 >= percent * (x + 1)].sum() for x in range(1, _LIGHT_MOST + 1)]
    return int(np.argmin(cost)) + 1 if len(n) else 1


class _Counter:
    """Counts of hashes, handed on a run at a time."""

    def __init__(self) -> None:
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, found: np.ndarray) -> bool:
        self.found.append(found)
        self.held += len(found)
        return self.held > _RUN

    def told(self) -> tuple[pa.Array, pa.Array]:
        value, count = np.unique(np.concatenate(self.found or [np.zeros(0, np.uint64)]), return_counts=True)
        self.found, self.held = [], 0
        return pa.array(value.view(np.int64)), pa.array(count)


_SURVEY = "kind int, doc_id long, text_key long, n long, k1 long, k2 long, sketch binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set (kind 0), and counts of the sampled shingles (kind 1, the shingle being k1)."""
    names = [x.split()[0] for x in _SURVEY.split(", ")]
    sampled = _Counter()

    def told() -> pa.RecordBatch:
        value, count = sampled.told()
        none = pa.nulls(len(value), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(value), np.int32)), none, none, count, value, none, pa.nulls(len(value), pa.binary())], names
        )

    for batch in batches:
        for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
            found, bounds = shingles(data, offsets)
            k1, k2 = set_keys(found, bounds)
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(hi - lo, np.int32)), own.column("doc_id"), own.column("text_key"),
                    pa.array(np.diff(bounds)), pa.array(k1), pa.array(k2), pa.array(sketches(found, bounds), pa.binary())
                ],
                names,
            )
            if sampled.add(found[found >> np.uint64(64 - _SAMPLE_BITS) == 0]):
                yield told()
    if sampled.held:
        yield told()


def _beside(batches: Iterator[pa.RecordBatch], often: Order) -> Iterator[pa.RecordBatch]:
    """(value, n): how many documents have the shingles at most ``_REACH`` from a frequent sampled one."""
    near_ones = _Counter()
    for batch in batches:
        for _, _, data, offsets in slices(*utf8(batch.column("text"))):
            h, row = _in_order(LOWER[data], offsets, WORDS)
            at = np.flatnonzero(often.levels(h))
            if not len(at):
                continue
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, np.maximum(at - _REACH, np.searchsorted(row, row[at])), 1)
            np.add.at(edge, np.minimum(at + _REACH + 1, np.searchsorted(row, row[at], "right")), -1)
            near = np.cumsum(edge)[:-1] > 0
            if near_ones.add(_distinct(h[near], row[near], len(offsets) - 1)[0]):
                yield pa.RecordBatch.from_arrays(list(near_ones.told()), ["value", "n"])
    if near_ones.held:
        yield pa.RecordBatch.from_arrays(list(near_ones.told()), ["value", "n"])


def _posts(batches: Iterator[pa.RecordBatch], order: Order, light: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(sig, k1, at): signatures by which sets meet; at is how many shingles come
    before (one less for a subset's second) << 32 | the size of the set."""
    for batch in batches:
        known: set[tuple[int, int]] = set()
        for _, _, data, offsets in slices(*utf8(batch.column("text"))):
            found, bounds = shingles(data, offsets)
            k1, k2 = set_keys(found, bounds)
            size = np.diff(bounds)
            row = np.repeat(np.arange(len(size)), size)
            level = order.levels(found)
            if level.any():  # by level, then as they are, by hash
                found = found[np.argsort((row << 6 | level).astype(np.uint16), kind="stable")]
            fresh = np.zeros(len(size), bool)
            for r, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):  # a set once for each batch
                if key not in known:
                    known.add(key)
                    fresh[r] = size[r] > 1
            room = size - least_common(size, percent)
            length = np.where(fresh & (size * 100 >= percent * (light + 1)), room + 1, 0)
            within = np.arange(len(found)) - np.repeat(bounds[:-1], size)
            take = within < length[row]
            sig, owner, place = [mix(found[take], 5) | np.uint64(1)], [row[take]], [within[take]]
            for r in np.flatnonzero(fresh & (size <= light)).tolist():
                own = found[bounds[r] : bounds[r] + min(room[r] + 2, size[r])]
                i, j = np.triu_indices(len(own), 1)
                sig.append(mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j], 6) & ~np.uint64(1))
                owner.append(np.full(len(i), r))
                place.append(np.maximum(j - 1, 0))
            own = np.concatenate(owner)
            at = np.concatenate(place).astype(np.int64) << 32 | size[own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(k1[own]), pa.array(at)], ["sig", "k1", "at"])


def _near_enough(n: np.ndarray, m: np.ndarray, different: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles that differ in so many or more can be alike enough."""
    twice = n + m - different
    return 100 * twice >= percent * (2 * (n + m) - twice)


def _may(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m can be alike enough if this is where they first meet."""
    need = -(-percent * (n + m) // (100 + percent))
    return (np.minimum(n, m) >= need) & (n - place >= need) & (m - other >= need)


def _sketched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that their sketches leave."""
    for batch in batches:
        every = np.arange(batch.num_rows)
        different = apart(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), every, every)
        keep = _near_enough(np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")), different, percent)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _scanned(batches: Iterator[pa.RecordBatch], percent: int, inside: bool = False) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (sig, i, j), two blocks of a list: pairs (a, b) that may be alike, of different components or ``inside`` one."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        sig, i, j, side, set_id, component, at = (t.column(c).to_numpy() for c in ("sig", "i", "j", "side", "set_id", "component", "at"))
        n, place = at & 0xFFFFFFFF, at >> 32
        new = np.flatnonzero((sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        end = np.repeat(np.append(new, len(sig)), np.diff(np.concatenate(([0], new, [len(sig)]))))
        many = end - np.arange(len(sig)) - 1
        total = np.concatenate(([0], np.cumsum(many)))
        maps = t.column("sketch").to_pylist()
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(sig):
            hi = min(len(sig), max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, "right")) - 1))
            x = np.repeat(np.arange(lo, hi), many[lo:hi])
            y = x + 1 + np.arange(len(x)) - np.repeat(total[lo:hi] - total[lo], many[lo:hi])
            lo = hi
            apart_or_one = (component[x] == component[y]) & (set_id[x] != set_id[y]) if inside else component[x] != component[y]
            keep = apart_or_one & ((i[x] == j[x]) | (side[x] != side[y])) & _may(n[x], place[x], n[y], place[y], percent)
            x, y = x[keep], y[keep]
            keep = _near_enough(n[x], n[y], apart(maps, maps, x, y), percent)
            out.append(np.stack((set_id[x[keep]], set_id[y[keep]])))
        found = np.sort(np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64), axis=0)
        found = np.unique(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch]).combine_chunks()
        held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
        last = [held.column(c)[-1].as_py() for c in ("sig", "i", "j")]
        same = np.ones(held.num_rows, bool)
        for c, v in zip(("sig", "i", "j"), last, strict=True):
            same &= held.column(c).to_numpy() == v
        cut = int(np.flatnonzero(same)[0])  # the last group may go on in the next batch
        if cut:
            yield pairs(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield pairs(held)


_LINK = "a long, b long, n_a long, n_b long, common long"


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links among pairs that come as the set of a (b is null) and then the sets of its partners."""
    own, pivot = np.zeros(0, np.uint64), None
    for batch in batches:
        out = []
        for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("found"), strict=True):
            found = np.frombuffer(raw.as_buffer(), np.uint64)
            if b is None:
                own, pivot = found.copy(), a
                continue
            if a != pivot:
                raise ValueError("a pivot's set must come before its partners")
            small, large = (own, found) if len(own) < len(found) else (found, own)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            common = int((large[at] == small).sum())
            if 100 * common >= percent * (len(own) + len(found) - common):
                out.append((a, b, len(own), len(found), common))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], ["a", "b", "n_a", "n_b", "common"]
        )


def _common(found: list[np.ndarray], cut: int) -> np.ndarray:
    """How many hashes each of the first ``cut`` sets shares with each of the others (where there are none, each with each)."""
    value = np.concatenate(found)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], np.repeat(np.arange(len(found)), [len(x) for x in found])[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    shared = np.diff(np.append(np.flatnonzero(new), len(value))) > 1  # a hash of one set alone is common to none
    keep = np.repeat(shared, np.diff(np.append(np.flatnonzero(new), len(value))))
    owner, number = owner[keep], np.cumsum(new[keep]) - 1
    rest = 0 if cut == len(found) else cut
    out = np.zeros((cut, len(found) - rest))
    for lo in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(number, (lo, lo + _COLUMNS))
        has = np.zeros((len(found), int(number[b - 1]) + 1 - lo), np.float32)
        has[owner[a:b], number[a:b] - lo] = 1
        out += has[:cut] @ has[rest:].T
    return out.astype(np.int64)


def _inside(batches: Iterator[pa.RecordBatch], percent: int, listed: bool) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (component, i, j, side, set_id), two blocks of a component: all links, or (set_id, linked), how many documents each set meets there."""
    ids: list[int] = []
    copies: list[int] = []
    found: list[np.ndarray] = []
    sides: list[int] = []
    held = None

    def told() -> pa.RecordBatch:
        cut = len(sides) - sum(sides)
        n = np.array([len(x) for x in found])
        whole = held[1] == held[2]
        common = _common(found, cut) if whole or 0 < cut < len(found) else np.zeros((0, 0), np.int64)
        rest = 0 if whole else cut
        union = n[:cut, None] + n[None, rest:] - common if common.size else common
        linked = (100 * common >= percent * union) & (np.triu(np.ones(common.shape, bool), 1) if whole else True)
        x, y = np.nonzero(linked)
        number, c = np.array(ids), common[x, y]
        y = y + rest
        if not listed:
            weight = np.array(copies)
            total = np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids))
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(number[some], pa.int64()), pa.array(total[some].astype(np.int64))], ["set_id", "linked"])
        turned = number[x] > number[y]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (number[x], number[y], n[x], n[y], c)], ["a", "b", "n_a", "n_b", "common"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j")), strict=True)
        own = (batch.column(c).to_pylist() for c in ("side", "set_id", "copies"))
        for key, side, set_id, many, raw in zip(keys, *own, batch.column("found"), strict=True):
            if key != held:
                if len(ids) > 1:
                    yield told()
                ids, copies, found, sides, held = [], [], [], [], key
            if not ids or ids[-1] != set_id:  # repeated rows give a set twice
                ids.append(set_id)
                copies.append(many)
                sides.append(side)
                found.append(np.frombuffer(raw.as_buffer(), np.uint64))
    if len(ids) > 1:
        yield told()


class Join:
    """One run over ``docs``.

    ``documents`` has each row's set (doc_id, text_key, n, k1, k2), ``sets`` a row
    for each class (set_id, k1, k2, n, the least doc_id and its text_key),
    ``spanning`` links that span the components, ``near`` each linked set's
    component. Unless ``every`` is False, ``linked`` has how many documents of other
    classes each such set links with; ``links`` every link (a < b), if ``listed``.
    """

    def __init__(self, docs: DataFrame, percent: int = PERCENT, every: bool = True, listed: bool = False) -> None:
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50, up to 100: smaller sets have no 2-subsets in common")
        self.spark, self.percent = docs.sparkSession, percent
        self.scratch = Scratch(self.spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
        survey = self.scratch.keep(rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_survey, _SURVEY))
        found = survey.df.where("kind = 0").drop("kind")
        self.documents = self.scratch.keep(found.drop("sketch")).df
        least = F.min(F.struct("doc_id", "text_key"))
        sets = found.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(least.alias("d"), F.first("sketch").alias("sketch"))
        # the numbers are fixed as the table is written
        self.sets = self.scratch.keep(
            sets.select(F.monotonically_increasing_id().alias("set_id"), "k1", "k2", "n", "d.doc_id", "d.text_key", "sketch")
        ).df
        order, weight = self._order(survey)
        survey.drop()
        met = self._met(order, weight)
        first = self._stars(met.df)
        held = [self._held(first.df)]
        links = self._links(first.df, held[0].df)
        if not every:
            held.pop().drop()
        near = components(links.df, self.scratch)
        left = self._left(met.df, first.df, near)
        first.drop()
        if not every:
            met.drop()
        held.append(self._held(left.df))
        more = self._links(left.df, held[-1].df)
        left.drop()
        if not every:
            held.pop().drop()
        self.spanning = links.df.unionByName(more.df)
        self.near = components(self.spanning, self.scratch) if more.df.take(1) else near
        if every:
            self._every(met.df, held[0].df.unionByName(held[1].df), listed)
            for table in (met, *held):
                table.drop()

    def _most_frequent(self, counts: DataFrame, most: int) -> Broadcast:
        """The most frequent of counted shingles, by level; bounded, as it orders shingles alone."""
        often = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "value").limit(most).toPandas()
        hashes = often["value"].to_numpy(np.int64).view(np.uint64)
        sort = np.argsort(hashes)
        level = np.minimum(np.log2(np.maximum(often["n"].to_numpy(np.float64), 2)), 63).astype(np.uint8)
        return self.spark.sparkContext.broadcast(Order(hashes[sort], level[sort]))

    def _order(self, survey: Table) -> tuple[Broadcast, float]:
        """The order of shingles, and how many other documents one that isn't frequent meets."""
        sampled = survey.df.where("kind = 1").select(F.col("k1").alias("value"), "n")
        counts = self.scratch.keep(sampled.groupBy("value").agg(F.sum("n").alias("n")).where("n > 1"))
        whole = sampled.agg(F.sum("n")).first()[0] or 0
        met = counts.df.agg(F.sum(F.when(F.col("n") < OFTEN, F.col("n") * (F.col("n") - 1))), F.sum(F.when(F.col("n") >= OFTEN, F.col("n")))).first()
        weight = (met[0] or 0) / max(1, whole - (met[1] or 0))
        lead = self._most_frequent(counts.df, SAMPLED)
        counts.drop()
        beside = self.rows.select("text").mapInArrow(lambda it: _beside(it, lead.value), "value long, n long")
        return self._most_frequent(beside.groupBy("value").agg(F.sum("n").alias("n")), FREQUENT), weight

    def _met(self, order: Broadcast, weight: float) -> Table:
        """(sig, set_id, at, pivot, pivot_at): the lists that several sets share, with the set whose place is the first."""
        size = F.least("n", F.lit(4 * _LIGHT_MOST))
        sizes = {r.n: r.many for r in self.documents.where("n > 0").groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("many")).collect()}  # at most 4 * _LIGHT_MOST rows
        self.light = light = boundary(sizes, weight, self.percent)
        percent = self.percent
        posts = self.scratch.keep(
            self.rows.select("text").mapInArrow(lambda it: _posts(it, order.value, light, percent), "sig long, k1 long, at long")
        )
        # most signatures come once: what tells them from the rest is eight bytes of each
        often = self.scratch.keep(posts.df.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig"))
        some = self.scratch.keep(posts.df.join(often.df, "sig", "left_semi"))
        posts.drop()
        often.drop()
        lists = (
            some.df.groupBy("sig")
            .agg(F.min("k1").alias("least"), F.max("k1").alias("most"), F.min("at").alias("pivot_at"), F.min_by("k1", "at").alias("k1"))
            .where("least < most")
        )
        # half a name may be that of several sets: all of them meet in the list
        named = self.sets.select("set_id", "k1")
        pivots = self.scratch.keep(lists.select("sig", "pivot_at", "k1").join(named, "k1").select("sig", "pivot_at", F.col("set_id").alias("pivot")))
        met = self.scratch.keep(some.df.join(pivots.df, "sig").join(named, "k1").select("sig", "set_id", "at", "pivot", "pivot_at"))
        some.drop()
        pivots.drop()
        return met

    def _stars(self, met: DataFrame) -> Table:
        """Pairs of a pivot and a set of its lists that may be alike."""
        n, m = F.col("at").bitwiseAND(0xFFFFFFFF), F.col("pivot_at").bitwiseAND(0xFFFFFFFF)
        need = F.ceil(self.percent * (n + m) / (100 + self.percent))
        may = (F.least(n, m) >= need) & (n - F.shiftright("at", 32) >= need) & (m - F.shiftright("pivot_at", 32) >= need)
        pairs = met.where("set_id <> pivot").where(may).select(F.col("pivot").alias("a"), F.col("set_id").alias("b"))
        # sets that share half a name don't tell a list apart, so they are held against one another
        same = self.sets.groupBy("k1").agg(F.array_sort(F.collect_list("set_id")).alias("ids")).where(F.size("ids") > 1)
        same = same.select(
            F.explode(F.transform("ids", lambda x: F.struct(x.alias("x"), F.filter("ids", lambda y: y > x).alias("y")))).alias("p")
        ).select(F.col("p.x").alias("a"), F.explode("p.y").alias("b"))
        pairs = pairs.unionByName(same).distinct()
        for side in ("b", "a"):
            pairs = pairs.join(
                self.sets.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")),
                side
            )
        percent = self.percent
        return self.scratch.keep(pairs.mapInArrow(lambda it: _sketched(it, percent), "a long, b long"))

    def _left(self, met: DataFrame, first: DataFrame, near: DataFrame) -> Table:
        """Pairs of one list in different components that nothing rules out yet."""
        lists = (
            met.select("sig", "set_id", "at")
            .join(near.withColumnRenamed("node", "set_id"), "set_id", "left")
            .withColumn("component", F.coalesce("component", "set_id"))
        )
        kept = self.scratch.keep(lists)
        mixed = kept.df.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("k"))
        # of two sets one is the pivot, so that pair is decided
        mixed = mixed.where("x <> y AND k > 2").select("sig", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
        known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = self.scratch.keep(self._scan(kept.df.join(mixed, "sig").distinct()).join(known, ["a", "b"], "left_anti"))
        kept.drop()
        return out

    def _scan(self, lists: DataFrame, inside: bool = False) -> DataFrame:
        """Pairs (a, b) that meet in a list of (sig, blocks, set_id, component, at)."""
        rows = lists.join(self.sets.select("set_id", "sketch"), "set_id")
        own = F.pmod(F.xxhash64("set_id"), "blocks").cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "set_id", "component", "at", "sketch"
        )
        percent = self.percent
        scanned = (
            rows.repartition("sig", "i", "j")
            .sortWithinPartitions("sig", "i", "j")
            .mapInArrow(lambda it: _scanned(it, percent, inside), "a long, b long")
        )
        return scanned.distinct()

    def _copies(self) -> DataFrame:
        """(set_id, copies): how many documents have each set."""
        rows = self.documents.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "text_key", "n", "k1", "k2").distinct()
        many = rows.groupBy("k1", "k2", "n").agg(F.count(F.lit(1)).alias("copies"))
        return many.join(self.sets.select("set_id", "k1", "k2", "n"), ["k1", "k2", "n"]).select("set_id", "copies")

    def _every(self, met: DataFrame, held: DataFrame, listed: bool) -> None:
        """All links. Each is inside a component: one of two sets has a link that is known, in others all are looked for."""
        near, pairs = self.near.withColumnRenamed("node", "set_id"), F.col("k") * (F.col("k") - 1)
        found = near.join(self.sets.select("set_id", "n"), "set_id").groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
        found = self.scratch.keep(found.where("k > 2"))
        whole, more, done = found.df, None, []
        large = found.df.where(F.col("k") > FEW)
        if large.take(1):
            lists = self.scratch.keep(met.select("sig", "set_id", "at").join(near.join(large.select("component"), "component"), "set_id").distinct())
            done.append(lists)
            often = lists.df.groupBy("component", "sig").agg(F.count(F.lit(1)).alias("k"))
            listed = often.groupBy("component").agg(F.sum(pairs).alias("listed")).join(large, "component")
            sparse = self.scratch.keep(listed.where(F.col("listed") * LIST_COST < pairs).select("component"))
            done.append(sparse)
            if sparse.df.take(1):
                whole = whole.join(sparse.df, "component", "left_anti")
                lists = lists.df.join(sparse.df, "component", "left_semi")
                shared = lists.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
                shared = shared.select("sig", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
                some = self.scratch.keep(self._scan(lists.join(shared, "sig"), inside=True))
                more = self._links(some.df, held)
                done.append(some)
        blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("n") / _BLOCK_SHINGLES)).cast("int")
        whole = near.join(whole.select("component", blocks.alias("blocks")), "component")
        own, percent = F.pmod(F.xxhash64("set_id"), "blocks").cast("int"), self.percent
        copies = self.scratch.keep(self._copies().join(near.select("set_id"), "set_id")).df
        rows = whole.join(held, "set_id").join(copies, "set_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "set_id", "copies", "found"
        ).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "set_id")
        counted = self.scratch.keep(rows.mapInArrow(lambda it: _inside(it, percent, False), "set_id long, linked long"))
        turned, swap = F.col("a") > F.col("b"), {"a": "b", "b": "a", "n_a": "n_b", "n_b": "n_a"}
        rest = self.spanning.unionByName(more.df) if more else self.spanning
        rest = rest.join(whole.select(F.col("set_id").alias("a")), "a", "left_anti")
        rest = rest.select(*(F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in swap.items()), "common").distinct()
        rest = self.scratch.keep(rest).df
        ends = rest.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(rest.select(F.col("b").alias("set_id"), F.col("a").alias("other")))
        ends = ends.join(copies.withColumnRenamed("set_id", "other"), "other").select("set_id", F.col("copies").alias("linked"))
        self.linked = self.scratch.keep(counted.df.unionByName(ends).groupBy("set_id").agg(F.sum("linked").alias("linked"))).df
        if listed:
            self.links = self.scratch.keep(rows.mapInArrow(lambda it: _inside(it, percent, True), _LINK)).df.unionByName(rest)
        for table in (found, counted, *done):
            table.drop()

    def _held(self, pairs: DataFrame) -> Table:
        """(set_id, found): the shingles of the sets of pairs."""
        some = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        wanted = some.join(self.sets.select("set_id", "doc_id", "text_key", "k1", "k2"), "set_id")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[int] = set()
            for batch in batches:
                for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                    part = batch.slice(lo, hi - lo)
                    found, bounds = shingles(data, offsets)
                    k1, k2 = set_keys(found, bounds)
                    same = (k1 == np.asarray(part.column("k1"))) & (k2 == np.asarray(part.column("k2")))
                    ids = part.column("set_id").to_pylist()
                    take = [r for r in np.flatnonzero(same).tolist() if ids[r] not in done and not done.add(ids[r])]
                    raw = found.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r in take], pa.int64()), pa.array([raw[8 * bounds[r] : 8 * bounds[r + 1]] for r in take], pa.binary())],
                        ["set_id", "found"]
                    )

        texts = self.rows.withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"])
        return self.scratch.keep(texts.select("set_id", "k1", "k2", "text").mapInArrow(own, "set_id long, found binary"))

    def _links(self, pairs: DataFrame, held: DataFrame) -> Table:
        """The pairs that are alike, by the shingles of both sets."""
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
        right = (
            pairs.join(parts, "a")
            .select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
            .join(held.withColumnRenamed("set_id", "b"), "b")
        )
        left = parts.select(
            "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        ).join(held.withColumnRenamed("set_id", "a"), "a")
        both = left.select("a", F.lit(None).cast("long").alias("b"), "part", "found").unionByName(right.select("a", "b", "part", "found"))
        percent = self.percent
        both = both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return self.scratch.keep(both.select("a", "b", "found").mapInArrow(lambda it: _compared(it, percent), _LINK).distinct())

    def members(self) -> DataFrame:
        """(k1, k2, component, component_id) of every set; component_id is the component's least doc_id."""
        joined = self.sets.join(
            self.near.withColumnRenamed("node", "set_id"), "set_id", "left"
        ).withColumn("component", F.coalesce("component", "set_id"))
        least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return joined.join(least, "component").select("k1", "k2", "component", "component_id")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        component_id = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
        return self.documents.join(self.members(), ["k1", "k2"], "left").select(
            "doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id")
        )

    def counts(self) -> DataFrame:
        """(doc_id, text_key, n_links) of every document: with how many others it links. Rows without a doc_id are left out."""
        rows = self.documents.where("doc_id IS NOT NULL").select("doc_id", "text_key", "n", "k1", "k2").distinct()
        many = self.sets.join(self._copies(), "set_id").join(self.linked, "set_id", "left")
        many = many.select("k1", "k2", "n", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        return rows.join(many, ["k1", "k2", "n"], "left").select("doc_id", "text_key", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each document's number of shingles and its component."""
    return Join(docs, percent).result()


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id.

    Rows without a doc_id stay, and so do those without shingles. Of rows that
    repeat a doc_id and its text one stays; rows that share a doc_id alone are
    told apart by their texts.
    """
    run = Join(docs, percent, every=False)
    rows = run.documents.where("doc_id IS NOT NULL")
    linked = rows.where("n > 0").join(run.members(), ["k1", "k2"]).groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("d"))
    keep = linked.select("d.doc_id", "d.text_key").unionByName(rows.where("n = 0").select("doc_id", "text_key").distinct())
    name, key = "_doc_id", "_text_key"
    while name in docs.columns or key in docs.columns:
        name, key = name + "_", key + "_"
    keep = keep.select(F.col("doc_id").alias(name), F.col("text_key").alias(key))
    known = docs.where("doc_id IS NOT NULL").withColumns({name: F.col("doc_id").cast("long"), key: F.xxhash64("text")})
    return known.join(keep, [name, key], "left_semi").dropDuplicates([name, key]).drop(name, key).unionByName(docs.where("doc_id IS NULL"))
