"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The benchmark's windows (n consecutive words; an item of fewer words is one
window of its own length) become a sorted hash set. A block of at most
``MAX_WINDOWS`` windows (in flat arrays, about 100 bytes each) is broadcast at a time,
so what is broadcast has a proven bound: a benchmark within it takes one scan of the corpus and no
shuffle; a larger one takes a scan for each block, whose hits (rows of
contaminated documents alone) are then merged by document. Every hit is
verified against the words themselves. `clean` carries the hits of the blocks
beside each row, found on its unchanged text, and cuts once.

Defined results: null or empty texts have no words and no hits; a null text
stays null. Repeated rows give the same result each. A null item_id counts
as an item named by the empty string. Empty tables give empty results or no
hits. Columns other than those named are passed through untouched (`clean`) or
left out (`report`), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._arrow import LOWER, WORD_CHARS, Words, cut, replace_column, slices, span_hashes, utf8, window_hashes, window_starts, words
from framelake.llm._scratch import Scratch, bounded

N_WORDS = 10
MAX_WINDOWS = 1_000_000
_FILTER_BITS = 22

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


@dataclass
class Grams:
    """Windows of one length: sorted hashes, and of each its words and its items, all in flat arrays.

    Window i has the bytes text[text_at[i]:text_at[i + 1]] and the items
    names[j] for j in owners[owner_at[i]:owner_at[i + 1]].
    """

    hashes: np.ndarray
    text: bytes
    text_at: np.ndarray
    owners: np.ndarray
    owner_at: np.ndarray
    names: list[str]
    seen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def __getstate__(self):
        return self.hashes, self.text, self.text_at, self.owners, self.owner_at, self.names

    def __setstate__(self, state) -> None:
        self.hashes, self.text, self.text_at, self.owners, self.owner_at, self.names = state
        self.__post_init__()

    def words(self, i: int) -> bytes:
        return self.text[self.text_at[i] : self.text_at[i + 1]]

    def items(self, i: int) -> list[str]:
        return [self.names[j] for j in self.owners[self.owner_at[i] : self.owner_at[i + 1]].tolist()]


def build(items: list[tuple[object, str | None]], n: int = N_WORDS) -> dict[int, Grams]:
    """The hash set of the windows of some items, by window length."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        w = words(data, np.array([0, len(data)]), WORD_CHARS)
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        size = min(n, len(parts))
        for i in range(len(parts) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(b" ".join(parts[i : i + size]), set()).add("" if item is None else str(item))
    out = {}
    for size, grams in found.items():
        texts = list(grams)
        joined = np.frombuffer(b" ".join(texts), np.uint8)
        w = words(joined, np.array([0, len(joined)]), WORD_CHARS)
        hashes = window_hashes(span_hashes(joined, w.start, w.end), size)[::size]
        order = np.argsort(hashes, kind="stable")
        names = sorted(set().union(*grams.values()))
        code = {name: k for k, name in enumerate(names)}
        own = [sorted(code[x] for x in grams[texts[i]]) for i in order.tolist()]
        ends = lambda lengths: np.concatenate(([0], np.cumsum(np.fromiter(lengths, np.int64, len(order)))))
        out[size] = Grams(
            hashes[order], b"".join(texts[i] for i in order.tolist()), ends(len(texts[i]) for i in order.tolist()),
            np.fromiter((k for o in own for k in o), np.int32), ends(map(len, own)), names
        )
    return out


def scan(data: np.ndarray, offsets: np.ndarray, index: dict[int, Grams]) -> tuple[Words, np.ndarray, dict[int, set[str]]]:
    """Words of some rows, which of them are hit, and the items by contaminated row."""
    low = LOWER[data]
    w = words(low, offsets, WORD_CHARS)
    n = len(w.start)
    edge, items = np.zeros(n + 1, np.int64), {}
    if n and index:
        hashes = span_hashes(low, w.start, w.end)
        for size, grams in index.items():
            at = window_hashes(hashes, size)
            near = np.flatnonzero(grams.seen[at >> np.uint64(64 - _FILTER_BITS)] & window_starts(w.first, size)[: len(at)])
            k = np.searchsorted(grams.hashes, at[near])
            k[k == len(grams.hashes)] = 0
            same = grams.hashes[k] == at[near]
            rows = np.searchsorted(w.first, near, "right") - 1
            for i, j, row in zip(near[same].tolist(), k[same].tolist(), rows[same].tolist(), strict=True):
                text = b" ".join(low[a:b].tobytes() for a, b in zip(w.start[i : i + size], w.end[i : i + size], strict=True))
                while j < len(grams.hashes) and grams.hashes[j] == at[i]:  # equal hashes of different words stand together
                    if grams.words(j) == text:
                        edge[i] += 1
                        edge[i + size] -= 1
                        items.setdefault(row, set()).update(grams.items(j))
                        break
                    j += 1
    return w, np.cumsum(edge)[:n] > 0, items


def _blocks(benchmark: DataFrame, n: int, most: int) -> tuple[int, Iterator[dict[int, Grams]]]:
    """How many hash sets there are, and each in turn: it holds about ``most`` windows at most (or one item)."""
    text = F.coalesce("text", F.lit(""))
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.size(F.regexp_extract_all(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), 0)))).first()[0] or 0
    blocks = max(1, -(-total // most))

    def each() -> Iterator[dict[int, Grams]]:
        for k in range(blocks):
            part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            yield build([(r.item_id, r.text) for r in part.toLocalIterator()], n)

    return blocks, each()


def _digest(n_words: int, n_hit: int, items: list[str]) -> tuple:
    return n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, items


def report(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """A row for each document: its words, those hit, and the items that occur in it."""
    sc = docs.sparkSession.sparkContext
    bounded(docs.sparkSession)
    many, blocks = _blocks(benchmark, n, max_windows)
    rows = docs.select("doc_id", "text")
    if many == 1:
        only = sc.broadcast(next(blocks))
        return rows.mapInArrow(lambda it: _report(it, only.value), REPORT)
    hits, scratch = None, Scratch(docs.sparkSession)
    for block in blocks:  # a block is let go of before the next is made
        b = sc.broadcast(block)
        part = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(
            lambda it, b=b: _hits(it, b.value), "doc_id long, text_key long, hit array<int>, items array<string>"
        )
        part = scratch.keep(part).df
        b.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_counted, "doc_id long, text_key long, n_words long")
    on = counted["doc_id"].eqNullSafe(merged["doc_id"]) & (counted["text_key"] == merged["text_key"])
    items = F.coalesce(merged["items"], F.array().cast("array<string>"))
    n_hit = F.when(merged["hit"].isNull(), F.lit(0)).otherwise(F.size(merged["hit"]))
    return counted.join(merged, on, "left").select(
        counted["doc_id"], "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items")
    )


def _report(batches: Iterator[pa.RecordBatch], index: dict[int, Grams]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
            w, hit, items = scan(data, offsets, index)
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[w.first[1:]] - total[w.first[:-1]]
            rows = [_digest(a, b, sorted(items.get(i, ()))) for i, (a, b) in enumerate(zip(w.count.tolist(), n_hit.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo).cast(pa.int64()),
                    *(
                        pa.array(c, t) for c,
                        t in zip(
                            zip(*rows, strict=True),
                            (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())), strict=True
                        )
                    )
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )


def _hits(batches: Iterator[pa.RecordBatch], index: dict[int, Grams]) -> Iterator[pa.RecordBatch]:
    """Of contaminated documents alone: the words hit and the items."""
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for lo, _, data, offsets in slices(*utf8(batch.column("text"))):
            w, hit, items = scan(data, offsets, index)
            rows = sorted(items)
            take = pa.array([lo + i for i in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take).cast(pa.int64()), keys.take(take),
                    pa.array([np.flatnonzero(hit[w.first[i] : w.first[i + 1]]).tolist() for i in rows], pa.list_(pa.int32())),
                    pa.array([sorted(items[i]) for i in rows], pa.list_(pa.string()))
                ],
                ["doc_id", "text_key", "hit", "items"],
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        n = [words(LOWER[d], o, WORD_CHARS).count for _, _, d, o in slices(data, offsets)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), batch.column("text_key"),
                pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
            ],
            ["doc_id", "text_key", "n_words"]
        )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, max_windows: int = MAX_WINDOWS, drop_share: float = 1.0) -> DataFrame:
    """``docs`` without the spans that occur in the benchmark.

    A document of whose words at least ``drop_share`` are hit goes as a whole;
    n_chars, where there is such a column, is brought up to date. The hits of a
    benchmark of several blocks are found block by block, each on the whole
    texts, with a table in the shared folder between them, and cut at once.
    """
    sc, out = docs.sparkSession.sparkContext, docs
    bounded(docs.sparkSession)
    many, blocks = _blocks(benchmark, n, max_windows)
    marks = None
    if many > 1:
        marks = "_hit"
        while marks in docs.columns:
            marks += "_"
        out = docs.withColumn(marks, F.array().cast("array<int>"))
        scratch, before = Scratch(docs.sparkSession), None
        for _ in range(many - 1):
            b = sc.broadcast(next(blocks))
            after = scratch.keep(out.mapInArrow(lambda it, b=b, marks=marks: _mark(it, b.value, marks), out.schema))
            b.unpersist()
            if before is not None:
                before.drop()
            before, out = after, after.df
    last = sc.broadcast(next(blocks))
    return out.mapInArrow(lambda it: _clean(it, last.value, drop_share, marks), docs.schema)


def _with_marks(w: Words, hit: np.ndarray, marks: pa.Array) -> np.ndarray:
    """``hit`` and the words of each row that ``marks`` names."""
    size = marks.value_lengths().to_numpy(zero_copy_only=False)
    hit[np.repeat(w.first[:-1], size) + marks.flatten().to_numpy()] = True
    return hit


def _mark(batches: Iterator[pa.RecordBatch], index: dict[int, Grams], marks: str) -> Iterator[pa.RecordBatch]:
    """The rows as they are, with the words hit added to those in ``marks``."""
    for batch in batches:
        column, found = batch.column(marks), []
        for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
            w, hit, _ = scan(data, offsets, index)
            hit = _with_marks(w, hit, column.slice(lo, hi - lo))
            found += [np.flatnonzero(hit[x:y]).tolist() for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
        yield replace_column(batch, marks, pa.array(found, column.type))


def _clean(batches: Iterator[pa.RecordBatch], index: dict[int, Grams], drop_share: float, marks: str | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        changed: dict[int, str] = {}
        gone = np.zeros(batch.num_rows, bool)
        for lo, hi, data, offsets in slices(*utf8(column)):
            w, hit, items = scan(data, offsets, index)
            rows = list(items)
            if marks is not None:
                own = batch.column(marks).slice(lo, hi - lo)
                hit = _with_marks(w, hit, own)
                rows = sorted({*items, *np.flatnonzero(own.value_lengths().to_numpy(zero_copy_only=False)).tolist()})
            for i in rows:
                own = slice(w.first[i], w.first[i + 1])
                gone[lo + i] = hit[own].mean() >= drop_share
                changed[lo + i] = cut(data[offsets[i] : offsets[i + 1]].tobytes(), w.start[own] - offsets[i], hit[own]).decode()
        if marks is not None:
            batch = batch.drop_columns([marks])
        if changed:
            texts = column.to_pylist()
            for i, text in changed.items():
                texts[i] = text
            batch = replace_column(batch, "text", pa.array(texts, column.type))
            if "n_chars" in batch.schema.names:
                size = batch.column("n_chars").to_pylist()
                for i, text in changed.items():
                    size[i] = len(text)
                batch = replace_column(batch, "n_chars", pa.array(size, batch.column("n_chars").type))
            batch = batch.filter(pa.array(~gone))
        yield batch
