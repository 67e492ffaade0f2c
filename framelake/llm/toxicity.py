"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 3, 4 and 5
bytes; filters of widths 1, 2 and 3 run over the words of the whole text,
and the maximum of each over the text (above 0) feeds a logistic output. As
embedding and filters are linear, their products are tabulated by bucket once
trained, so judging a word is a few additions of table rows.

Training is by Adam over minibatches. It takes at most ``MOST`` labelled rows of
each label (the first by a hash of doc_id, and of those as many as have ``CHARS`` / 2 characters), of those whose crc32(doc_id) mod 5
is not 0; labels, lang, source and doc_id are no inputs. Thresholds are calibrated on
all labelled rows that aren't held out, at their own mix of labels: one for each language, as identified from the text
itself, at the best F1, and the common one where a language has fewer than ``FEWEST`` rows of a label. Rows that
were fitted count with the output of one of ``FOLDS`` models that did not see them. Outputs are
counted in bins of 1 / ``BINS``, and thresholds lie between bins. The
score is the logistic of the output less that threshold, so 0.5 is the
threshold of each language.

Defined results: null and empty texts and those without words get the score of an empty
text. Each row is judged by its text alone, so repeated rows get equal
results. Rows of ``labels`` without a document, or with a null, are not
learned from; a document labelled several times is fitted once for each label, and calibrated on as often;
of rows that share a doc_id one (of the least hash) is fitted.
Where there is nothing to learn from every score is next to 0. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import langid
from framelake.llm._arrow import LOWER, WORD_CHARS, Words, mix, slices, span_hashes, utf8, words
from framelake.llm._scratch import Scratch, bounded

MOST = 2000
CHARS = 48_000_000
BUCKETS = 1 << 15
SIZE = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PARTS = 4
ROUNDS = 6
FOLDS = 5
FEWEST = 20
BINS = 64
_MOST_RAW = 256
_STEPS = sum(WIDTHS)


def parts(low: np.ndarray, w: Words) -> np.ndarray:
    """``PARTS`` buckets of each word: of the word, and of its first 3, 4 and 5 bytes."""
    out = np.empty((len(w.start), PARTS), np.int32)
    for k, size in enumerate((None, 3, 4, 5)):
        end = w.end if size is None else np.minimum(w.end, w.start + size)
        out[:, k] = (mix(span_hashes(low, w.start, end), 20 + k) >> np.uint64(64 - 15)).astype(np.int32)
    return out


def _pool(response: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum above 0 of each filter over each row's words, and where it is (-1: nowhere)."""
    rows = len(first) - 1
    top, at = np.zeros((rows, response.shape[1]), np.float32), np.full((rows, response.shape[1]), -1)
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if a < b:
            k = response[a:b].argmax(axis=0)
            best = response[a + k, np.arange(response.shape[1])]
            on = best > 0
            top[r, on], at[r, on] = best[on], a + k[on]
    return top, at


def _respond(tabled: np.ndarray, bias: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter responses at each word from products by step; beyond a row's end there is nothing."""
    n = len(tabled)
    out = np.tile(bias, (n, 1))
    last = np.repeat(first[1:], np.diff(first))  # the end of each word's row
    column = 0
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            part = tabled[j:, column : column + FILTERS]
            inside = (np.arange(n - j) + j < last[: n - j])[:, None] if j else True
            out[: n - j, k * FILTERS : (k + 1) * FILTERS] += np.where(inside, part, 0) if j else part
            column += FILTERS
    return out


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray  # SIZE x (steps * FILTERS)
    bias: np.ndarray
    output: np.ndarray  # one for each filter, and the bias
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    language: langid.Model | None = None
    _table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = self.embedding @ self.filters
        rows = len(first) - 1
        if not len(ids):
            return np.full(rows, self.output[-1])
        _, where, inverse = np.unique(
            ids[:, 0].astype(np.int64) << 32 | ids[:, 3].astype(np.int64) << 15 | ids[:, 1], return_index=True,
            return_inverse=True
        )
        own = self._table[ids[where]].sum(axis=1)
        response = _respond(own[inverse], self.bias, first)
        top = np.zeros((rows, response.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(first))
        top[some] = np.maximum(np.maximum.reduceat(response, first[some], axis=0), 0)
        return top @ self.output[:-1] + self.output[-1]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        low = LOWER[data]
        w = words(low, offsets, WORD_CHARS)
        raw = self.logits(parts(low, w), w.first)
        cut = np.full(len(raw), self.threshold)
        if self.thresholds and self.language is not None:
            lang, _ = langid.judge(data, offsets, self.language)
            cut = np.array([self.thresholds.get(v, self.threshold) for v in lang])
        return 1 / (1 + np.exp(-np.clip(raw - cut, -60, 60)))


def train(texts: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, seed: int = 0, rate: float = 0.02) -> Model:
    """Fit embeddings, filters and output to texts (arrays of ``parts``)."""
    random = np.random.default_rng(seed)
    p = {
        "embedding": random.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
        "filters": random.normal(0, 0.4, (SIZE, _STEPS * FILTERS)).astype(np.float32),
        "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32),
        "output": np.append(
            np.abs(random.normal(0, 0.3, len(WIDTHS) * FILTERS)) * np.tile([1, -1], len(WIDTHS) * FILTERS // 2), 0
        ).astype(np.float32),
    }
    first_moment, second_moment = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    step = 0
    for _ in range(rounds):
        order = random.permutation(len(texts))
        for lo in range(0, len(order), 48):
            batch = order[lo : lo + 48]
            ids = np.concatenate([texts[i] for i in batch])
            first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in batch])))
            word = p["embedding"][ids].sum(axis=1)
            response = _respond(word @ p["filters"], p["bias"], first)
            top, at = _pool(response, first)
            raw = top @ p["output"][:-1] + p["output"][-1]
            error = ((1 / (1 + np.exp(-raw)) - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            grad = {
                "output": np.append(top.T @ error, error.sum()).astype(np.float32), "filters": np.zeros_like(p["filters"]),
                "bias": np.zeros_like(p["bias"])
            }
            back = error[:, None] * p["output"][:-1]
            row, unit = np.nonzero(at >= 0)
            where, g = at[row, unit], back[row, unit]
            np.add.at(grad["bias"], unit, g)
            touched, flow = [], []
            column = np.concatenate(([0], np.cumsum(WIDTHS))) * FILTERS
            for j in range(max(WIDTHS)):
                k = unit // FILTERS
                use = (np.array(WIDTHS)[k] > j) & (where + j < first[row + 1])
                c = column[k[use]] + j * FILTERS + unit[use] % FILTERS
                np.add.at(grad["filters"].T, c, g[use][:, None] * word[where[use] + j])
                touched.append(where[use] + j)
                flow.append(g[use][:, None] * p["filters"].T[c])
            step += 1
            bucket, inverse = np.unique(ids[np.concatenate(touched)].ravel(), return_inverse=True)
            own = np.zeros((len(bucket), SIZE), np.float32)
            np.add.at(own, inverse, np.repeat(np.concatenate(flow), PARTS, axis=0))
            for name, g in [*grad.items(), ("embedding", own)]:
                rows = bucket if name == "embedding" else slice(None)
                m = first_moment[name][rows] = 0.9 * first_moment[name][rows] + 0.1 * g
                v = second_moment[name][rows] = 0.99 * second_moment[name][rows] + 0.01 * g * g
                p[name][rows] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(**p)


def best_threshold(raw: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Between the two outputs where F1 is best; y of the n rows (1 unless given) with an output are toxic."""
    order = np.argsort(-raw, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.cumsum(np.ones(len(y)) if n is None else n[order]) + y.sum())
    # of equally good places the middle one
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(good[len(good) // 2])
    low = raw[order[k + 1]] if k + 1 < len(y) else raw[order[k]] - 1
    return float((raw[order[k]] + low) / 2)


@dataclass
class Fit:
    """A model without thresholds, the documents it was fitted to, and for each the model that did not see it."""

    model: Model
    ids: np.ndarray
    fold: np.ndarray
    folds: list[Model]


def _marked(labels: DataFrame) -> DataFrame:
    return (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~langid.held_out())
        .select(F.col("doc_id").cast("long").alias("labelled"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    )


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, chars: int = CHARS) -> Fit | None:
    """Fit on a sample of rows that aren't held out, bounded in rows and in characters; None where there are none."""
    marked = _marked(labels)
    # of each label those first by hash: at most 2 * most rows, which are broadcast, so texts stay where they are
    sample = [tuple(r) for v in (0, 1) for r in marked.where(F.col("toxic") == v).distinct().orderBy(F.xxhash64("labelled", F.lit(3)), "labelled").limit(most).collect()]
    if not sample:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sample, "labelled long, toxic int"))
    known = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("labelled")).where("text IS NOT NULL")
    bounded(docs.sparkSession)
    # of rows that share a doc_id one is learned from, whatever their number; at most 2 * most texts are shuffled
    known = (
        known.groupBy("labelled", "toxic")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
        .select(F.col("labelled").alias("doc_id"), "toxic", F.col("t.text").alias("text"))
    )
    known = Scratch(docs.sparkSession).keep(known).df
    # long texts are cut by rows, in the order of the hash, to what the driver holds
    room, own = {0: chars // 2, 1: chars // 2}, []
    for r in known.select(
        "doc_id", "toxic", F.length("text").alias("chars"), F.xxhash64("doc_id", F.lit(3)).alias("place")
    ).orderBy("place", "doc_id").collect():
        room[r.toxic] -= r.chars
        if room[r.toxic] >= 0:
            own.append((r.doc_id, r.toxic))
    if not own:
        return None
    known = known.join(F.broadcast(docs.sparkSession.createDataFrame(own, "doc_id long, toxic int")), ["doc_id", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                low = LOWER[data]
                w = words(low, offsets, WORD_CHARS)
                ids = parts(low, w)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id").cast(pa.int64()), own.column("toxic"),
                        pa.array([ids[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary())
                    ],
                    ["doc_id", "toxic", "ids"]
                )

    rows = known.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, ids binary").toArrow()
    if not rows.num_rows:
        return None
    # the order must not depend on tasks
    ids = rows.column("ids").to_pylist()
    order = sorted(range(rows.num_rows), key=lambda i, a=rows.column("doc_id").to_pylist(), b=rows.column("toxic").to_pylist(): (a[i], b[i], ids[i]))
    texts = [np.frombuffer(ids[i], np.int32).reshape(-1, PARTS) for i in order]
    doc = rows.column("doc_id").to_numpy()[order]
    y = (rows.column("toxic").to_numpy()[order] > 0).astype(np.float32)
    model = train(texts, y)
    model.language = langid.learn(docs, 300)
    # documents are dealt to folds label by label, so each model sees both labels
    own, first = np.unique(doc, return_index=True)
    if min(y[first].sum(), (1 - y[first]).sum()) < 2:
        return Fit(model, np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    fold = np.empty(len(own), np.int64)
    fold[np.argsort(y[first], kind="stable")] = np.arange(len(own)) % FOLDS
    out = fold[np.searchsorted(own, doc)]
    return Fit(model, own, fold, [train([t for t, b in zip(texts, out == k, strict=True) if not b], y[out != k]) for k in range(FOLDS)])


def outputs(docs: DataFrame, found: Fit) -> DataFrame:
    """(doc_id, held_out, lang, raw, fair) of every whole text: fair is the output of a model that did not see the document."""
    held = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                low = LOWER[data]
                w = words(low, offsets, WORD_CHARS)
                ids = parts(low, w)
                raw = f.model.logits(ids, w.first).astype(np.float64)
                lang, _ = langid.judge(data, offsets, f.model.language)
                own = batch.slice(lo, hi - lo)
                fair = raw.copy()
                doc = own.column("doc_id").cast(pa.int64())
                known = doc.is_valid().to_numpy(zero_copy_only=False)
                name = doc.fill_null(0).to_numpy()
                for r in np.flatnonzero(known & np.isin(name, f.ids)).tolist():
                    a, b = w.first[r], w.first[r + 1]
                    fair[r] = f.folds[f.fold[np.searchsorted(f.ids, name[r])]].logits(ids[a:b], np.array([0, b - a]))[0]
                yield pa.RecordBatch.from_arrays(
                    [doc, own.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(raw), pa.array(fair)],
                    ["doc_id", "held_out", "lang", "raw", "fair"]
                )

    return docs.select("doc_id", "text", langid.held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang string, raw double, fair double"
    )


def calibrate(model: Model, judged: DataFrame, labels: DataFrame) -> None:
    """Set the thresholds by `outputs` of all labelled rows that aren't held out."""
    marked = _marked(labels).groupBy("labelled").agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n"))
    place = F.floor(F.greatest(F.least("fair", F.lit(float(_MOST_RAW))), F.lit(-float(_MOST_RAW))) * BINS + 0.5).alias("place")
    # at most 2 * _MOST_RAW * BINS + 1 rows of each language
    rows = (
        judged.where("NOT held_out")
        .select("doc_id", "lang", place)
        .join(marked, F.col("doc_id") == F.col("labelled"))
        .groupBy("lang", "place")
        .agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
        .toPandas()
    )
    if not 0 < rows["y"].sum() < rows["n"].sum():
        return
    whole = rows.groupby("place", as_index=False)[["y", "n"]].sum()
    model.threshold = best_threshold(whole["place"].to_numpy(float) / BINS, whole["y"].to_numpy(float), whole["n"].to_numpy(float))
    for name, own in rows.groupby("lang"):
        if own["y"].sum() >= FEWEST and own["n"].sum() - own["y"].sum() >= FEWEST:
            model.thresholds[name] = best_threshold(own["place"].to_numpy(float) / BINS, own["y"].to_numpy(float), own["n"].to_numpy(float))


def _blank() -> Model:
    return Model(
        np.zeros((BUCKETS, SIZE), np.float32), np.zeros((SIZE, _STEPS * FILTERS), np.float32),
        np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS + 1, -60, np.float32)
    )


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Fit on a bounded sample of rows that aren't held out, and calibrate thresholds on all of them."""
    found = fit(docs, labels, most)
    if found is None:
        return _blank()
    calibrate(found.model, outputs(docs, found), labels)
    return found.model


def assess(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """`score` of ``docs`` by what is learned from them, with one look at each text for thresholds and scores."""
    found = fit(docs, labels, most)
    if found is None:
        return score(docs, _blank())
    judged = Scratch(docs.sparkSession).keep(outputs(docs, found)).df
    calibrate(found.model, judged, labels)
    cut = F.lit(found.model.threshold)
    if found.model.thresholds:
        cut = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(found.model.thresholds.items()) for x in pair])[F.col("lang")], cut)
    value = 1 / (1 + F.exp(-F.greatest(F.least(F.col("raw") - cut, F.lit(60.0)), F.lit(-60.0))))
    return judged.select("doc_id", "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The toxicity of every whole text, without a shuffle."""
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(*utf8(batch.column("text"))):
                found = held.value.scores(data, offsets)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id").cast(pa.int64()), own.column("held_out"), pa.array(found.astype(np.float64)),
                        pa.array((found >= 0.5).astype(np.int32))
                    ],
                    ["doc_id", "held_out", "score", "predicted"]
                )

    return docs.select("doc_id", "text", langid.held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
