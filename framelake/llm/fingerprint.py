"""Context-triggered piecewise hashing of whole texts.

A rolling hash over seven bytes decides, from its context alone, where chunks
end: at level k where its lowest k bits are all ones, so the boundaries of a
level contain those of all higher ones. A text's level is the lowest at which
it has fewer than ``MOST`` boundaries; its fingerprint is
``level:signature:signature of the next level``, with one character for each
chunk, the last of which runs to the end of the text. Nothing is cut off: a
longer text has larger chunks.

Fingerprints are comparable where they share a level. Likeness is
``2 * LCS / (len + len)`` of the two signatures, that is one less the edit
distance by insertions and deletions over their lengths; the best of the
shared levels counts, and equal fingerprints give 1. As in other piecewise
hashes, signatures without a common run of ``RUN`` characters (of all, where
shorter) count as unlike (0), which keeps chance matches out.

Defined results: null and empty texts both have the fingerprint ``0::``, and two
of them are alike (1); an empty and another text are not (0). Texts that
share a doc_id are ordered by their xxhash64, descending; rows repeated whole are next to one another. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm._arrow import mix, powers, slices, utf8
from framelake.llm._scratch import bounded

MOST = 64
RUN = 4
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_TABLE = mix(np.arange(256, dtype=np.uint64), 3)
_ROLL = (_TABLE >> np.uint64(32)).astype(np.uint32)
_LEVELS = 32
_CONTEXT = 7


def _triggers(data: np.ndarray) -> np.ndarray:
    """How many of the lowest bits of the rolling hash at each byte are ones."""
    word = _ROLL[data]
    roll = word.copy()
    for back in range(1, min(_CONTEXT, len(data))):
        roll[back:] += word[:-back] << np.uint32(4 * back)
    roll = (roll ^ (roll >> np.uint32(16))) * np.uint32(0x7FEB352D)
    roll ^= roll >> np.uint32(15)
    free = ~roll
    lowest = free & (roll + np.uint32(1))  # the lowest zero bit
    return np.minimum(np.bitwise_count(lowest - np.uint32(1)), _LEVELS).astype(np.int8)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each row of a slice."""
    if not len(data):
        return ["0::"] * (len(offsets) - 1)
    # the first bytes of a row must not see the row before: each row is hashed behind zero padding
    n = len(offsets) - 1
    size = np.diff(offsets)
    pad = np.arange(n) * _CONTEXT + _CONTEXT
    spaced = np.zeros(len(data) + _CONTEXT * (n + 1), np.uint8)
    spaced[np.arange(len(data)) + np.repeat(pad, size)] = data
    ones = _triggers(spaced)
    total = np.zeros(len(spaced) + 1, np.uint64)
    up, down = powers(len(spaced))
    np.cumsum(_TABLE[spaced] * up[: len(spaced)], out=total[1:])
    out = []
    for i in range(n):
        a, b = int(offsets[i] + pad[i]), int(offsets[i + 1] + pad[i])
        own = ones[a:b]
        if a == b:
            out.append("0::")
            continue
        counts = np.bincount(own, minlength=_LEVELS + 2)[::-1].cumsum()[::-1]  # boundaries of each level
        level = int(np.argmax(counts < MOST))
        marks = np.flatnonzero(own >= level)
        deep = own[marks]
        signatures = []
        for k in (level, level + 1):
            ends = marks[deep >= k] + 1 + a
            if not len(ends) or ends[-1] != b:
                ends = np.append(ends, b)
            starts = np.concatenate(([a], ends[:-1]))
            chunk = mix((total[ends] - total[starts]) * down[starts])
            signatures.append(_ALPHABET[(chunk >> np.uint64(58)).astype(np.int64)].tobytes().decode())
        out.append(f"{level}:{signatures[0]}:{signatures[1]}")
    return out


def _lcs(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence and common run of many pairs of at most 64 characters, bit-parallel."""
    n, width = len(a), max(map(len, a), default=0) or 1
    deep = max(map(len, b), default=0)
    left, right = np.zeros((n, 64), np.uint8), np.zeros((n, max(deep, 1)), np.uint8)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)] = np.frombuffer(x, np.uint8)
        right[i, : len(y)] = np.frombuffer(y, np.uint8)
    vector = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    chain = np.zeros((n, width), np.int8)
    run = np.zeros(n, np.int8)
    for j in range(deep):
        c = right[:, j : j + 1]
        same = (left == c) & (c != 0)
        match = np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
        both = vector & match
        vector = (vector + both) | (vector - both)
        grown = np.zeros_like(chain)
        grown[:, 0] = 1
        grown[:, 1:] = chain[:, :-1] + 1
        chain = np.where(same[:, :width], grown, 0).astype(np.int8)
        np.maximum(run, chain.max(axis=1), out=run)
    return np.bitwise_count(~vector).astype(np.int64), run.astype(np.int64)


def likeness(first: list[str], second: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    out = np.zeros(len(first))
    left: list[bytes] = []
    right: list[bytes] = []
    of: list[int] = []
    for i, (x, y) in enumerate(zip(first, second, strict=True)):
        if x == y:
            out[i] = 1
            continue
        (k, *s), (m, *t) = x.split(":"), y.split(":")
        for p, u in enumerate(s):
            q = int(k) + p - int(m)
            if 0 <= q < 2 and u and t[q]:
                left.append(u.encode())
                right.append(t[q].encode())
                of.append(i)
    for at in range(0, len(of), 1024):
        x, y = left[at : at + 1024], right[at : at + 1024]
        common, run = _lcs(x, y)
        sizes = np.array([(len(u), len(v)) for u, v in zip(x, y, strict=True)])
        score = np.where(run >= np.minimum(RUN, sizes.min(axis=1)), 2 * common / sizes.sum(axis=1), 0)
        np.maximum.at(out, np.array(of[at : at + 1024]), np.minimum(score, 1 - 1e-9))
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each whole text, without any shuffle."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, _, d, o in slices(*utf8(batch.column("text"))) for x in fingerprints(d, o)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _range_of(docs: DataFrame, partitions: int) -> tuple[Column, list[int]]:
    """A number for a row's range of doc_id (or, without one, of hashes), ranges being of about equal numbers of rows; their bounds."""
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / partitions for k in range(1, partitions)], 0.2 / partitions))) if partitions > 1 else []
    cuts = [int(x) for x in bounds]
    # two levels of constant lists, so a row is held against about 2 sqrt(partitions) bounds
    step = max(1, math.isqrt(len(cuts)))
    array = lambda x: F.array(*map(F.lit, x)).cast("array<long>")
    passed = lambda c: F.size(F.filter(c, lambda x: F.col("doc_id") >= x))
    block = passed(array(cuts[step - 1 :: step]))
    parts = F.array(*(array(cuts[k : k + step - 1]) for k in range(0, len(cuts) + 1, step))).cast("array<array<long>>")
    known = block * step + passed(F.get(parts, block))
    # rows without a doc_id come last, by descending hash: equal parts of the hashes' range
    width = (1 << 64) // partitions + 1
    none = -1 - F.floor(
        (F.lit((1 << 63) - 1).cast("decimal(20,0)") - F.xxhash64("text").cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")
    ).cast("int")
    return F.when(F.col("doc_id").isNotNull(), known).otherwise(none), cuts


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text), the next document by descending doc_id; the last one's is the first.

    Rows are dealt by doc_id ranges; each range also gets a copy of the first
    row of the range after it (one row a range), so a range needs no other.
    Null doc_ids come last, in ranges of their hashes. Each text is shuffled once, packed.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part, _ = _range_of(rows.select("doc_id").where("doc_id IS NOT NULL"), partitions)
    bounded(spark)
    rows = rows.withColumn("part", part)
    heads = (
        rows.groupBy("part")
        .agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("h"), "text")).alias("head"))
        .select("part", "head.doc_id", "head.text")
    )
    order = Window.orderBy(F.col("part").desc())
    # one row for each range, at most spark.sql.shuffle.partitions + 1
    before = heads.withColumn(
        "part", F.coalesce(F.lag("part").over(order), F.min("part").over(Window.partitionBy(F.lit(1))))
    ).withColumn("ghost", F.lit(True))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(before)
    own = Window.partitionBy("part").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    return both.withColumn("next_text", F.lead("text").over(own)).where("NOT ghost").select("doc_id", "text", "next_text")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of the other."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts, following = part.column("text").to_pylist(), part.column("next_text").to_pylist()
                changed = [edited(t, f or "") for t, f in zip(texts, following, strict=True)]
                marks = [[x for _, _, d, o in slices(*utf8(c)) for x in fingerprints(d, o)] for c in (part.column("text"), pa.array(changed, pa.large_string()), part.column("next_text"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(map(len, texts), pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                        pa.array(marks[0], pa.string()),
                        pa.array(marks[1], pa.string()),
                        pa.array(likeness(marks[0], marks[1])),
                        pa.array(likeness(marks[0], marks[2])),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return beside_next(docs).mapInArrow(run, SCHEMA)
