"""Sequence packing by cutting-stock column generation.

A document of n tokens gives n // capacity full pieces, each a sequence of
its own, and a remainder. Remainders are counted by length in ``UNITS`` steps
(rounded up), which is all that the plan depends on: a linear program over
patterns (how many pieces of each step a sequence holds) whose columns are
priced by an unbounded knapsack, solved by dynamic programming over the
steps. The optimal mix is rounded down, and the few pieces left over (fewer than
patterns times pieces) are placed best-fit, longest first. So the driver's work is
bounded by ``UNITS``, whatever the corpus.

Pieces are then ranked within their step (counts by step and chunk, their running
sums, and a row number inside each chunk: no step is ever one task), and rank
selects pattern, copy and place. Offsets are running sums inside a sequence,
which has at most ``capacity`` pieces.

Defined results: null and empty texts are the end token alone. Repeated rows
are packed once each. An empty table gives no pieces. Columns other than
doc_id and text are left out. Which sequence a piece goes to depends on
spark.sql.shuffle.partitions, as ranks are counted by so many chunks.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm._arrow import NOT_SPACE, slices, span_hashes, utf8, words
from framelake.llm._scratch import Scratch

CAPACITY = 2048
UNITS = 256
END = 1
GAP = 2e-4
_MOST_WORDS = 600_000

#: Bytes of ASCII letters, and the second ones of Latin-1 letters in UTF-8, whose first is C3.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SECOND = np.zeros(256, bool)
_SECOND[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?"]] = True


class WordIds:
    """Ids of words that white space parts, each encoded once by the library.

    The vocabulary's splitter drops white space and nothing joins across it,
    so a text's ids are those of its words in turn; likewise a single stop
    after an ASCII letter or digit stands alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def of(self, parts: list[bytes], letters: list[bool]) -> list[bytes]:
        """Ids of words, of which ``letters`` tells whether they are of letters alone."""
        known = self.known
        if len(known) > _MOST_WORDS:
            known.clear()
        plain, rest = [], []
        for p, alone in zip(parts, letters, strict=True):
            if p not in known:
                (plain if alone else rest).append(p)
        if plain:
            # words of letters alone are one piece each, so one text of them all can be told apart by word ends
            ids = np.array(self.tokenizer.encode(b" ".join(plain).decode(), add_special_tokens=False).ids, np.uint32)
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) == len(plain):
                raw, ends = ids.tobytes(), ends.tolist()
                known.update(zip(plain, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:  # another vocabulary's words aren't single pieces
                rest += plain
        if rest:
            for p, e in zip(rest, self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, np.uint32).tobytes()
        return [known[p] for p in parts]

    def rows(self, data: np.ndarray, offsets: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, each row's ``end`` last, and the rows' offsets in them."""
        w = words(data, offsets, NOT_SPACE)
        stop = (w.end - w.start > 1) & _STOPS[data[w.end - 1]]
        stop[stop] = _ALNUM[data[w.end[stop] - 2]]
        start = np.sort(np.concatenate((w.start, w.end[stop] - 1)))
        ends = np.sort(np.concatenate((w.end - stop, w.end[stop])))
        if len(start):
            _, where, inverse = np.unique(span_hashes(data, start, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            letter = _LETTER[data]
            pair = (data[:-1] == 0xC3) & _SECOND[data[1:]]
            letter[:-1] |= pair
            letter[1:] |= pair
            other = np.concatenate(([0], np.cumsum(~letter)))
            first, last = start[where], ends[where]
            ids = self.of([raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], (other[first] == other[last]).tolist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, at = np.frombuffer(b"".join(ids), np.uint32), np.concatenate(([0], np.cumsum(size)))[:-1]
            each = size[inverse]
            to = np.cumsum(each)
            tokens = flat[np.arange(int(to[-1])) + np.repeat(at[inverse] - (to - each), each)]
            bounds = np.concatenate(([0], to))[np.searchsorted(start, offsets)]
        else:
            tokens, bounds = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        return np.insert(tokens, bounds[1:], np.uint32(end)), bounds + np.arange(len(offsets))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Full pieces and remainders of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in batches:
            for lo, _, data, offsets in slices(*utf8(batch.column("text"))):
                ids, bounds = encoder.rows(data, offsets)
                raw, size = ids.astype("<u4").tobytes(), np.diff(bounds)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, size[row] - start)
                at = bounds[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(lo + row)).cast(pa.int64()), pa.array(start), pa.array(length),
                        pa.array(crc, pa.int64()), pa.array(size[row])
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def knapsack(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern; value[k] is that of a piece of k + 1 units."""
    best, take = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        total = best[room - 1 :: -1][: len(value)] + value[:room]
        k = int(total.argmax())
        if total[k] > best[room - 1] + 1e-12:
            best[room], take[room] = total[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(value), np.int64), units
    while room:
        if take[room]:
            pattern[take[room] - 1] += 1
            room -= take[room]
        else:
            room -= 1
    return float(best[units]), pattern


def cutting_stock(demand: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, for demand[k] pieces of k + 1 of len(demand) units."""
    units = len(demand)
    have = np.flatnonzero(demand)
    if not len(have):
        return []
    m = len(have)
    fits = units // (have + 1)
    patterns = [np.eye(m, dtype=np.int64)[i] * fits[i] for i in range(m)]
    inverse = np.diag(1 / fits)
    amount = demand[have] / fits
    while True:
        dual = inverse.sum(axis=0)
        value = np.full(units, -1.0)
        value[have] = dual
        worth, pattern = knapsack(value, units)
        # the optimum is at least the present cost over the best pattern's worth
        if worth <= 1 + 1e-9 or amount.sum() * (1 - 1 / worth) <= gap * amount.sum():
            break
        column = inverse @ pattern[have]
        ratio = np.where(column > 1e-11, amount / np.where(column > 1e-11, column, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * column, 0)
        amount[out] = step
        row = inverse[out] / column[out]
        inverse = inverse - np.outer(column, row)
        inverse[out] = row
        patterns[out] = pattern[have]
    left, plan = demand.copy(), []
    for p, x in zip(patterns, amount, strict=True):
        use = int(min(np.floor(x + 1e-7), (left[have][p > 0] // p[p > 0]).min()))
        if use > 0:
            full = np.zeros(units, np.int64)
            full[have] = p
            left -= full * use
            plan.append((full, use))
    return plan + _best_fit(left)


def _best_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The pieces left over, longest first, each to the fullest sequence that has room."""
    units = len(left)
    rooms: list[list[Counter]] = [[] for _ in range(units + 1)]
    for k in range(units, 0, -1):
        for _ in range(int(left[k - 1])):
            room = next((r for r in range(k, units) if rooms[r]), units)
            own = rooms[room].pop() if room < units else Counter()
            own[k] += 1
            rooms[room - k].append(own)
    same = Counter(tuple(sorted(c.items())) for r in rooms for c in r)
    out = []
    for items, n in sorted(same.items()):
        full = np.zeros(units, np.int64)
        for k, c in items:
            full[k - 1] = c
        out.append((full, n))
    return out


@dataclass
class Plan:
    """Runs of ranks of a step that go to one pattern: key is step << 40 | first rank."""

    key: np.ndarray
    each: np.ndarray  # pieces of the step in a copy of the pattern
    sequence: np.ndarray  # the pattern's first sequence

    @classmethod
    def of(cls, demand: np.ndarray) -> Plan:
        """demand[k]: remainders of k + 1 units; demand[-1]: full pieces."""
        key, each, sequence = [], [], []
        ranks, base = np.zeros(len(demand), np.int64), 0
        for pattern, n in cutting_stock(demand[:-1]):
            for k in np.flatnonzero(pattern).tolist():
                key.append(((k + 1) << 40) | int(ranks[k]))
                each.append(int(pattern[k]))
                sequence.append(base)
                ranks[k] += pattern[k] * n
            base += n
        key.append(len(demand) << 40)
        each.append(1)
        sequence.append(base)
        order = np.argsort(key)
        return cls(np.array(key)[order], np.array(each)[order], np.array(sequence)[order])

    def place(self, step: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence, and place among the pieces of the step there."""
        want = (step.astype(np.int64) << 40) | rank
        at = np.searchsorted(self.key, want, "right") - 1
        within = want - self.key[at]
        return self.sequence[at] + within // self.each[at], within % self.each[at]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and offset there; ids by the vocabulary file at ``path``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)  # which also bounds batches
    cut = scratch.keep(pieces(docs, path, capacity)).df
    grain = capacity // UNITS
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = F.when(F.col("length") == capacity, UNITS + 1).otherwise(F.ceil(F.col("length") / grain)).cast("int")
    cut = cut.withColumn("step", step).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)).cast("int"))
    counts = scratch.keep(cut.groupBy("step", "chunk").agg(F.count(F.lit(1)).alias("n"))).df
    demand = np.zeros(UNITS + 1, np.int64)
    for r in counts.groupBy("step").agg(F.sum("n").alias("n")).collect():  # a row for each step
        demand[r.step - 1] = r.n
    plan = spark.sparkContext.broadcast(Plan.of(demand))

    before = Window.partitionBy("step").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("step", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("step", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        cut.withColumn("rank", F.row_number().over(own) - 1)
        .join(firsts, ["step", "chunk"])
        .withColumn("rank", F.col("rank") + F.col("first"))
        .drop("first", "chunk")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, place = plan.value.place(np.asarray(batch.column("step")), np.asarray(batch.column("rank")))
            out = batch.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("place", pa.array(place))

    order = Window.partitionBy("sequence_id").orderBy(F.col("step").desc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "step", F.col("rank").cast("long").alias("rank")
    ).mapInArrow(run, f"{_PIECES}, step int, sequence_id long, place long")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset")
    )
