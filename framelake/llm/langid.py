"""Hierarchical language identification.

First the language family is predicted, then one-versus-one linear support
vector machines separate the languages of that family by their votes (ties by the sum of the
margins). Features are the square roots of counts of hashed byte 2- and
3-grams of the whole text, with A-Z in lower case and each run of other
ASCII characters than letters as one space (bytes beyond ASCII stay), at unit length. The machines (squared hinge loss) are fitted by dual
coordinate descent in numpy.

What is learned from is bounded: about ``per_language`` documents of each of the
``languages`` with the most documents, chosen by a hash of doc_id, of those whose lang is not null and
whose crc32(doc_id) mod 5 is not 0. Families are the fixed table below; a language
that isn't there makes a family of its own.

Defined results: null texts, empty ones and those without a letter are
``und`` with score 0; so is every text where there was nothing to learn from. Each row is judged by
its text alone, so repeated rows get equal results. A null doc_id is neither
held out nor learned from. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._arrow import LOWER, slices, utf8
from framelake.llm._scratch import bounded

PER_LANGUAGE = 1000
LANGUAGES = 200
BUCKETS = 4096
UNKNOWN = "und"
_SLOPE = 3.0
_ROWS = 512

# Families of languages, fixed values.
FAMILY = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}

_LETTER = LOWER.copy()
_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``BUCKETS`` for each text, of unit length (or zero)."""
    rows = len(offsets) - 1
    byte = _LETTER[data]
    keep = np.ones(len(byte), bool)
    keep[1:] = (byte[1:] != 0x20) | (byte[:-1] != 0x20)
    row = np.repeat(np.arange(rows), np.diff(offsets))[keep]
    byte = byte[keep].astype(np.uint32)
    total = np.zeros(rows * BUCKETS)
    for n in (2, 3):
        if len(byte) < n:
            continue
        gram = byte[: len(byte) - n + 1].copy()
        for k in range(1, n):
            gram = (gram << np.uint32(8)) | byte[k : len(byte) - n + 1 + k]
        bucket = ((gram + np.uint32(n << 28)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        whole = row[: len(gram)] == row[n - 1 :]
        total += np.bincount(row[: len(gram)][whole] * BUCKETS + bucket[whole].astype(np.int64), minlength=rows * BUCKETS)
    out = np.sqrt(total.reshape(rows, BUCKETS)).astype(np.float32)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(size, 1e-9)


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights, the bias last, of an L2-regularised squared-hinge machine, for y of -1 and 1."""
    n, d = x.shape
    w, bias, alpha = np.zeros(d, np.float32), 0.0, np.zeros(n)
    diagonal = 0.5 / cost
    size = np.concatenate([(x[lo : lo + _ROWS] ** 2).sum(axis=1) for lo in range(0, n, _ROWS)]) + 1 + diagonal
    order, random = np.arange(n), np.random.default_rng(seed)
    for _ in range(rounds):
        random.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            gradient = y[i] * (float(x[i] @ w) + bias) - 1 + diagonal * alpha[i]
            step = max(alpha[i] - gradient / size[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.append(w, np.float32(bias))


@dataclass
class Model:
    """One-versus-rest machines of families, and one-versus-one machines within each."""

    families: list[str]
    languages: dict[str, list[str]]
    family: np.ndarray
    pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of rows of features."""
        sure = lambda m: 1 / (1 + np.exp(-_SLOPE * m))
        if not self.families:
            return np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        x = np.hstack((x, np.ones((len(x), 1), np.float32)))
        margin = x @ self.family.T
        first = margin.argmax(axis=1)
        score = np.ones(len(x)) if len(self.families) == 1 else sure(margin.max(axis=1))
        out = np.empty(len(x), object)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(first == k)
            own = self.languages[name]
            pairs, weights = self.pairs[name]
            votes = np.zeros((len(rows), len(own)))
            inner = np.ones(len(rows))
            if pairs and len(rows):
                m = x[rows] @ weights.T
                worst = np.full((len(rows), len(own)), np.inf)
                for (i, j), v in zip(pairs, m.T, strict=True):
                    votes[:, i] += (v > 0) + 1e-3 * np.tanh(v)
                    votes[:, j] += (v <= 0) - 1e-3 * np.tanh(v)
                    worst[:, i], worst[:, j] = np.minimum(worst[:, i], v), np.minimum(worst[:, j], -v)
                inner = sure(worst[np.arange(len(rows)), votes.argmax(axis=1)])
            out[rows] = np.array(own, object)[votes.argmax(axis=1)] if len(rows) else []
            score[rows] *= inner
        return out, score


def train(x: np.ndarray, lang: list[str]) -> Model:
    names = np.array([FAMILY.get(v, v) for v in lang], object)
    langs = np.array(lang, object)
    families = sorted(set(names.tolist()))
    rest = [linear_svm(x, np.where(names == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1] + 1, np.float32) for f in (families if len(families) != 2 else families[:1])]
    if len(families) == 2:
        rest.append(-rest[0])
    own, pairs = {}, {}
    for f in families:
        own[f] = sorted(set(langs[names == f].tolist()))
        which = [(i, j) for i in range(len(own[f])) for j in range(i + 1, len(own[f]))]
        weights = []
        for i, j in which:
            a, b = langs == own[f][i], langs == own[f][j]
            weights.append(linear_svm(x[a | b], np.where(a, 1.0, -1.0)[a | b]))
        pairs[f] = (which, np.array(weights))
    return Model(families, own, np.array(rest), pairs)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sorted(rows: pa.Table) -> tuple[np.ndarray, list[str]]:
    """Features and languages by doc_id (and then features, as ids may repeat), copied once, straight from Arrow's buffers."""
    halves = []
    for c in rows.column("x").chunks:
        if len(c):
            wide = np.int64 if pa.types.is_large_binary(c.type) else np.int32
            first = int(np.frombuffer(c.buffers()[1], wide)[c.offset])
            halves.append(np.frombuffer(c.buffers()[2], np.float16, len(c) * BUCKETS, first).reshape(-1, BUCKETS))
    x = np.empty((rows.num_rows, BUCKETS), np.float32)
    if not halves:
        return x, []
    head = np.concatenate([h[:, :8] for h in halves]).view("S16").ravel()
    order = np.lexsort((head, rows.column("doc_id").to_numpy()))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = 0
    for h in halves:
        x[place[at : at + len(h)]] = h
        at += len(h)
    return x, np.array(rows.column("lang").to_pylist(), object)[order].tolist()


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Fit on a bounded sample of the documents that aren't held out: about ``per_language``
    of each of the ``languages`` that have the most."""
    known = (
        docs.select("doc_id", "text", F.col("lang").alias("lang"))
        .where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
        .where(~held_out())
    )
    often = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r.lang: r.n for r in often.collect()}
    bounded(docs.sparkSession)
    if not counts:
        return Model([], {}, np.zeros((0, BUCKETS + 1), np.float32), {})
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])
    part = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                x = features(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("lang").slice(lo, hi - lo),
                        pa.array([r.tobytes() for r in x], pa.binary())
                    ],
                    ["doc_id", "lang", "x"]
                )

    x, lang = _sorted(known.where(part).mapInArrow(run, "doc_id long, lang string, x binary").toArrow())
    pa.default_memory_pool().release_unused()
    return train(x, lang)


def judge(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    lang, score = model.predict(features(data, offsets))
    none = ~has_letters(data, offsets)
    lang[none], score[none] = UNKNOWN, 0.0
    return lang, score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The language of every whole text, without a shuffle."""
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                lang, score = judge(data, offsets, held.value)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(lang.tolist(), pa.string()),
                        pa.array(score.astype(np.float64))
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"]
                )

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def clean(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """``docs`` without those of no language or a score below ``least``."""
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                lang, score = judge(data, offsets, held.value)
                yield batch.slice(lo, hi - lo).filter(pa.array((lang != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
