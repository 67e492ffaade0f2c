"""Substring deduplication by level-wise doubling.

Levels have lengths ``base``, then twice the last, up to ``window`` words. At
each level only windows that repeat (start in documents of different doc_id)
survive, and only windows made of survivors are looked at on the next level, until
none survive or ``window`` is reached. The lowest level looks at one window in
four: of the windows within each window of the next length, the one with the
least hash. Equal windows choose equal ones, so none is lost.

Every level counts by ``groupBy`` (combined before the shuffle, so a passage
that a third of all documents share is one row of each task), and finds the
windows of repeats by a sort-merge join that adaptive execution may split.
Levels hash with different seeds: a window counts as repeated only if it is made of
windows that repeat, and if 64 bits of its own agree with an earlier one's. So a window is taken for a
repeat by chance once in 2**64 for each pair of surviving windows that differ. (A second
64 bits took the tables of a run from 3.4 to more than 4.6 times the input.) Texts are shuffled packed, twice; per-word rows
exist only for windows that survived the level before.

Defined results: null and empty texts have no words. A row whose doc_id is
null is neither first nor removed from. Repeated rows (same doc_id and text)
get the same result each; windows repeated within one doc_id don't count. A text of fewer
than ``window`` words keeps all. Other columns are passed on untouched by
`clean` and left out by `report`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._arrow import NOT_SPACE, cut, gather, replace_column, slices, span_hashes, utf8, window_hashes, window_starts, words
from framelake.llm._scratch import Scratch, Table

WINDOW = 13
BASE = 7

_AT = "_repeat_at"
_ROW = "h long, doc_id long, key long, at int"
_NAMES = ["h", "doc_id", "key", "at"]


def least(hashes: np.ndarray, span: int) -> np.ndarray:
    """Position of the least (the first of equal ones) of each ``span`` consecutive hashes."""
    n = len(hashes) - span + 1
    best, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, span):
        other = hashes[k : k + n]
        better = other < best
        best = np.where(better, other, best)
        at = np.where(better, np.arange(k, k + n), at)
    return at


def levels(window: int, base: int) -> list[int]:
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _rows(batch: pa.RecordBatch, lo: int, first: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    row = np.searchsorted(first, at, "right") - 1
    take = pa.array(lo + row)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(hashes[at].view(np.int64)), batch.column("doc_id").take(take), batch.column("key").take(take),
            pa.array((at - first[row]).astype(np.int32))
        ],
        _NAMES
    )


def _lowest(batches: Iterator[pa.RecordBatch], length: int, following: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, data, offsets in slices(*utf8(batch.column("text"))):
            w = words(data, offsets, NOT_SPACE)
            hashes = window_hashes(span_hashes(data, w.start, w.end), length, 1)
            span = following - length + 1
            if len(hashes) < span:
                continue
            ok = window_starts(w.first, following)[: len(hashes) - span + 1]
            chosen = np.zeros(len(hashes), bool)
            chosen[least(hashes, span)[ok]] = True
            yield _rows(batch, lo, w.first, np.flatnonzero(chosen), hashes)


def _longer(batches: Iterator[pa.RecordBatch], before: int, length: int, lowest: bool, level: int) -> Iterator[pa.RecordBatch]:
    """Windows of ``length`` words that are made of surviving ones (``at``)."""
    for batch in batches:
        lists = batch.column("at")
        ends = np.asarray(lists.offsets)
        flat = np.asarray(lists.values)
        for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
            w = words(data, offsets, NOT_SPACE)
            n = len(w.start)
            at = flat[ends[lo] : ends[hi]] + np.repeat(w.first[:-1], np.diff(ends[lo : hi + 1]))
            hashes = window_hashes(span_hashes(data, w.start, w.end), length, level)
            alive = np.zeros(n + 1, np.int64)
            if lowest:
                np.add.at(alive, np.maximum(at - (length - before), 0), 1)
                np.add.at(alive, np.minimum(at + 1, n), -1)
                alive = np.cumsum(alive)[: len(hashes)] > 0
            else:
                alive[at] = 1
                alive = (alive[: len(hashes)] > 0) & (alive[length - before : length - before + len(hashes)] > 0)
            yield _rows(batch, lo, w.first, np.flatnonzero(alive & window_starts(w.first, length)[: len(hashes)]), hashes)


def repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> tuple[DataFrame, Table]:
    """(doc_id, key, at): the windows of each document that also start in a
    document with a smaller doc_id; key is xxhash64 of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text")
    )
    steps = levels(window, base)
    alive: Table | None = None
    for k, length in enumerate(steps):
        last = k == len(steps) - 1
        held: Table | None = None
        if k == 0:
            following = length if last else steps[1]
            found = rows.mapInArrow(lambda it, n=length, m=following: _lowest(it, n, m), _ROW)
        else:
            found = rows.join(alive.df, ["doc_id", "key"]).mapInArrow(
                lambda it, b=steps[k - 1], n=length, f=k == 1, s=k + 1: _longer(it, b, n, f, s), _ROW
            )
            held = scratch.keep(found)
            found = held.df
            alive.drop()
        repeated = scratch.keep(
            found.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "least")
        )
        hit = found.join(repeated.df, "h")
        if last:
            hit = hit.where("doc_id > least")
        alive = scratch.keep(hit.groupBy("doc_id", "key").agg(F.collect_set("at").alias("at")))
        repeated.drop()
        if held:
            held.drop()
        if not last and not alive.df.take(1):
            break  # no window repeats, so none of twice the length does
    return alive.df, alive


def _removed(w, lists: pa.Array, lo: int, hi: int, window: int) -> np.ndarray:
    """Which words of a slice the windows in ``lists`` cover."""
    n = len(w.start)
    edge = np.zeros(n + 1, np.int64)
    for r in range(lo, hi):
        if (x := lists[r]).is_valid:
            at = np.asarray(x.values) + w.first[r - lo]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def _with_repeats(docs: DataFrame, window: int, base: int) -> DataFrame:
    found, _ = repeats(docs, window, base)
    names = [_AT, "_repeat_id", "_repeat_key"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    found = found.select(F.col("at").alias(names[0]), F.col("doc_id").alias(names[1]), F.col("key").alias(names[2]))
    return docs.join(found, (F.col("doc_id").cast("long") == F.col(names[1])) & (F.xxhash64("text") == F.col(names[2])), "left").drop(*names[1:])


def report(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """A row for each document: its words, those removed, and a hash of those kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(_AT)
            for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                w = words(data, offsets, NOT_SPACE)
                gone = _removed(w, lists, lo, hi, window)
                total = np.concatenate(([0], np.cumsum(gone)))
                start, end = w.start[~gone], w.end[~gone]
                kept = gather(data, start, end)
                size = np.concatenate(([0], np.cumsum(end - start + 1)))[w.first - total[w.first]]
                hashes = [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(w.count, pa.int64()),
                        pa.array(np.diff(total[w.first]), pa.int64()), pa.array(hashes, pa.string())
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"]
                )

    return _with_repeats(docs.select("doc_id", "text"), window, base).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """``docs`` without the removed words (white space elsewhere stays as it is).

    A document that had words and has none left goes; n_chars, where there is
    such a column, is brought up to date.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, column = batch.column(batch.num_columns - 1), batch.column("text")  # the last column is the lists
            batch = batch.select(list(range(batch.num_columns - 1)))
            if lists.null_count == len(lists):
                yield batch
                continue
            changed, gone = {}, np.zeros(len(column), bool)
            for lo, hi, data, offsets in slices(*utf8(column)):
                w = words(data, offsets, NOT_SPACE)
                removed = _removed(w, lists, lo, hi, window)
                for r in range(lo, hi):
                    if lists[r].is_valid:
                        own = slice(w.first[r - lo], w.first[r - lo + 1])
                        gone[r] = removed[own].all()
                        changed[r] = cut(data[offsets[r - lo] : offsets[r - lo + 1]].tobytes(), w.start[own] - offsets[r - lo], removed[own]).decode()
            texts = column.to_pylist()
            for r, x in changed.items():
                texts[r] = x
            batch = replace_column(batch, "text", pa.array(texts, column.type))
            if "n_chars" in batch.schema.names:
                size = batch.column("n_chars").to_pylist()
                for r, x in changed.items():
                    size[r] = len(x)
                batch = replace_column(batch, "n_chars", pa.array(size, batch.column("n_chars").type))
            yield batch.filter(pa.array(~gone))

    return _with_repeats(docs, window, base).mapInArrow(run, docs.schema)
