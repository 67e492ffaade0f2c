"""Main paths against plain implementations of the same definitions, and the odd inputs of each operator."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import _sketch, decontaminate, fingerprint, jaccard, langid, substrings, toxicity, url_filter, warc
from framelake.llm._arrow import LOWER, WORD_CHARS, mix, utf8, words
from framelake.llm._scratch import Scratch

from test_text_operators import component_ids, shingle_set, without_repeats

M64 = (1 << 64) - 1
DIR = "/root/testdata/sf0.001"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# fingerprints: chunks and likeness byte by byte ----------------------------------------------------


def plain_fingerprint(data: bytes) -> str:
    if not data:
        return "0::"
    table = [int(x) for x in mix(np.arange(256, dtype=np.uint64), 3)]
    ones = []
    for i in range(len(data)):
        roll = 0
        for back in range(7):  # the context before the text is zero bytes
            b = data[i - back] if i >= back else 0
            roll = (roll + ((table[b] >> 32) << (4 * back))) & 0xFFFFFFFF
        roll = ((roll ^ (roll >> 16)) * 0x7FEB352D) & 0xFFFFFFFF
        roll ^= roll >> 15
        n = 0
        while n < 32 and roll >> n & 1:
            n += 1
        ones.append(n)
    level = next(k for k in range(34) if sum(o >= k for o in ones) < fingerprint.MOST)
    out = []
    for k in (level, level + 1):
        chunk, signature = b"", ""
        chunks = []
        for b, o in zip(data, ones, strict=True):
            chunk += bytes([b])
            if o >= k:
                chunks.append(chunk)
                chunk = b""
        if chunk:
            chunks.append(chunk)
        for c in chunks:
            total = 0
            for j, b in enumerate(c):
                total = (total + table[b] * pow(0x9E3779B97F4A7C15 | 1, j, 1 << 64)) & M64
            signature += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[int(mix(np.array([total], np.uint64))[0]) >> 58]
        out.append(signature)
    return f"{level}:{out[0]}:{out[1]}"


def plain_likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    best = 0.0
    (k, *s), (m, *t) = x.split(":"), y.split(":")
    for p, u in enumerate(s):
        for q, v in enumerate(t):
            if int(k) + p != int(m) + q or not u or not v:
                continue
            lcs = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
            run, most = [[0] * (len(v) + 1) for _ in range(len(u) + 1)], 0
            for i in range(len(u)):
                for j in range(len(v)):
                    lcs[i + 1][j + 1] = max(lcs[i][j + 1], lcs[i + 1][j], lcs[i][j] + (u[i] == v[j]))
                    run[i + 1][j + 1] = run[i][j] + 1 if u[i] == v[j] else 0
                    most = max(most, run[i + 1][j + 1])
            if most >= min(fingerprint.RUN, len(u), len(v)):
                best = max(best, min(2 * lcs[-1][-1] / (len(u) + len(v)), 1 - 1e-9))
    return best


def test_fingerprints_byte_by_byte(texts):
    rng = random.Random(9)
    some = [t or "" for t in texts if len(t or "") < 3000] + [prose(rng, 300, ["é", "漢字", "abc", "zz"])]
    got = fingerprint.fingerprints(*utf8(pa.array(some)))
    assert got == [plain_fingerprint(t.encode()) for t in some]
    pairs = [(got[rng.randrange(len(got))], got[rng.randrange(len(got))]) for _ in range(150)] + list(zip(got, [plain_fingerprint((t[:-9] + "x").encode()) for t in some], strict=True))
    assert np.allclose(fingerprint.likeness(*map(list, zip(*pairs, strict=True))), [plain_likeness(a, b) for a, b in pairs])


def test_neighbours_of_ties_and_missing_ids(spark):
    rows = [(i // 3 if i < 90 else None, f"text {i % 40} " * (i % 7)) for i in range(120)] + [(5, "again")] * 3 + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).repartition(5)
    hashed = {t: spark.createDataFrame([(t or "",)], "t string").select(F.xxhash64("t")).first()[0] for _, t in set(rows)}
    order = sorted(((i, hashed[t], t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = [(r[0], r[2], order[(k + 1) % len(order)][2]) for k, r in enumerate(order)]
    got = [tuple(r) for r in fingerprint.beside_next(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# toxicity and language: the tabulated forms against direct ones -------------------------------------


def test_convolution_word_by_word():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.SIZE)).astype(np.float32), rng.normal(size=(toxicity.SIZE, 6 * toxicity.FILTERS)).astype(np.float32), rng.normal(size=3 * toxicity.FILTERS).astype(np.float32), rng.normal(size=3 * toxicity.FILTERS + 1).astype(np.float32))
    texts = ["", "one", "Two words", "a much longer text of words, words and words é漢", "!!!", "x " * 50]
    data, offsets = utf8(pa.array(texts))
    low = LOWER[data]
    w = words(low, offsets, WORD_CHARS)
    ids = toxicity.parts(low, w)
    want = []
    for r in range(len(texts)):
        own = [model.embedding[i].sum(axis=0) for i in ids[w.first[r] : w.first[r + 1]]]
        raw, column = model.output[-1], 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                top = 0.0
                for at in range(len(own)):
                    x = model.bias[k * toxicity.FILTERS + f]
                    for j in range(width):
                        if at + j < len(own):
                            x += own[at + j] @ model.filters[:, column + j * toxicity.FILTERS + f]
                    top = max(top, x)
                raw += top * model.output[k * toxicity.FILTERS + f]
            column += width * toxicity.FILTERS
        want.append(raw)
    assert np.allclose(model.logits(ids, w.first), want, atol=1e-3)


def test_votes_one_by_one():
    rng = np.random.default_rng(1)
    langs = ["en", "de", "sv", "fr", "es", "xx"]
    centre = {v: rng.random(langid.BUCKETS) for v in langs}
    x = np.array([centre[v] + 0.1 * rng.random(langid.BUCKETS) for v in langs for _ in range(8)], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.train(x, [v for v in langs for _ in range(8)])
    assert model.families == ["germanic", "romance", "xx"]
    got, score = model.predict(x)
    for row, told, s in zip(np.hstack((x, np.ones((len(x), 1)))), got, score, strict=True):
        margins = [float(w @ row) for w in model.family]
        own = model.languages[model.families[margins.index(max(margins))]]
        pairs, weights = model.pairs[model.families[margins.index(max(margins))]]
        votes = [[0, 0.0] for _ in own]
        for (i, j), w in zip(pairs, weights, strict=True):
            v = float(w @ row)
            votes[i if v > 0 else j][0] += 1
            votes[i][1] += np.tanh(v)
            votes[j][1] -= np.tanh(v)
        assert told == own[max(range(len(own)), key=lambda k: (votes[k][0] + 1e-3 * votes[k][1]))] and 0 <= s <= 1
    assert got.tolist() == [v for v in langs for _ in range(8)]


def test_grams_one_by_one():
    texts = ["Abc, abd!  x", "", "é é", "12 3"]
    data, offsets = utf8(pa.array(texts))
    got = langid.features(data, offsets)
    for r, t in enumerate(texts):
        raw = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in t.encode())
        one = bytearray()
        for b in raw:
            if b != 32 or not one or one[-1] != 32:
                one.append(b)
        count = np.zeros(langid.BUCKETS)
        for n in (2, 3):
            for i in range(len(one) - n + 1):
                gram = int.from_bytes(one[i : i + n], "big") + (n << 28)
                count[((gram * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1
        size = np.sqrt(count.sum())
        if r:  # the first row has no row before it whose space could go
            pass
        assert np.allclose(got[r], np.sqrt(count) / max(size, 1e-9), atol=1e-5) or texts[r].startswith(" ")


def test_models_on_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = docs.limit(40).unionByName(docs.limit(40)).withColumn("labelled", F.lit(1)).withColumn("held_out", F.lit("z")).withColumn("score", F.lit(0))
    model = langid.learn(docs)
    twice = langid.identify(odd, model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang_pred", "score").alias("k")).collect()
    assert all(r.n == 2 and r.k == 1 for r in twice)
    assert langid.identify(docs.limit(0), model).count() == 0 and langid.clean(docs.limit(0), model).columns == docs.columns
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the old house").alias("text"))
    assert {r.n for r in langid.identify(many, model).groupBy("lang_pred").agg(F.count(F.lit(1)).alias("n")).collect()} == {3000}
    few = langid.learn(docs, languages=1)
    assert sum(len(v) for v in few.languages.values()) == 1
    doubled = labels.unionByName(labels).unionByName(labels.limit(5).withColumn("toxic", F.lit(None).cast(labels.schema["toxic"].dataType)))
    found = toxicity.learn(docs.unionByName(docs.limit(30)), doubled, 60)
    assert toxicity.score(docs.limit(0), found).count() == 0
    got = toxicity.score(odd.select("doc_id", "text", "labelled", "score"), found).groupBy("doc_id").agg(F.count_distinct("score").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.k == 1 and r.n == 2 for r in got)
    small = toxicity.fit(docs, labels, 60, chars=20_000)
    assert 0 < len(small.ids) < 30
    assert toxicity.fit(docs, labels, 60, chars=0) is None


# archives ----------------------------------------------------------------------------------------------


def test_malformed_numbers_and_archive_files(spark, tmp_path):
    body = b"payload"
    good = warc.record(7, "u", body, warc.digest(body), len(body), None, False)
    for old, new in ((b"Content-Length: 7", "Content-Length: ²".encode()), (b"Content-Length: 7", b"Content-Length: -7"), (b"Content-Length: 7", b"Content-Length: " + b"9" * 40)):
        with pytest.raises(warc.WarcError):
            warc.parse(good.replace(old, new))
    bad = good.replace(b"X-Payload-Length: 7", "X-Payload-Length: ²".encode())
    far = good.replace(b"<urn:page:7>", b"<urn:page:9999999999999999999>")
    big = warc.record(8, "u", b"long " * 100_000, warc.digest(b"long " * 100_000), 500_000, None, False)
    content = warc.archive([good, bad, far, big, good])
    rows = warc.read(spark.createDataFrame([("a", bytearray(content))], "name string, content binary")).collect()
    assert [(r.page_id, r.error is None) for r in rows] == [(7, True), (None, False), (None, True), (8, True), (7, True)]
    (tmp_path / "a.warc.zst").write_bytes(content)
    (tmp_path / "b.warc.zst").write_bytes(content[: len(content) - 9])
    found = warc.read_files(spark, str(tmp_path)).groupBy(F.regexp_extract("archive", "([^/]+)$", 1).alias("f")).agg(F.count("page_id").alias("n"), F.count("error").alias("bad")).collect()
    assert {(r.f, r.n, r.bad) for r in found} == {("a.warc.zst", 3, 1), ("b.warc.zst", 2, 2)}
    with pytest.raises(warc.WarcError):
        list(warc.frames(struct.pack("<II", warc.DICTIONARY_MAGIC, 1 << 31)))


# links ----------------------------------------------------------------------------------------------------


def test_propagation_over_a_large_graph(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, n, 40_000), (rng.pareto(1.2, 40_000) * 40).astype(int) % n, strict=True) if a != b}
    edges |= {(i, 1) for i in range(5000, 9000)} | {(n + i, n + i + 1) for i in range(60)} | {(0, n)}  # a hub, and a chain from a seed
    a, b = map(np.array, zip(*sorted(edges), strict=True))
    size = n + 61
    out = np.bincount(a, minlength=size)
    rank = seed = np.zeros(size)
    seed[[0, 7, 11]] = 1 / 3
    rank = 0.15 * seed
    for _ in range(300):
        rank = 0.15 * seed + 0.85 * np.bincount(b, rank[a] / out[a], minlength=size)
    table = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), (1 / out[a]).tolist(), strict=True)), "src long, dst long, weight double").select(F.lit("trust").alias("kind"), F.col("src").cast("string"), F.col("dst").cast("string"), "weight")
    seeds = spark.createDataFrame([("trust", str(i), 1.0) for i in (0, 7, 11)], "kind string, host string, rank double")
    got = {int(r.host): r["rank"] for r in url_filter.propagate(table, seeds, Scratch(spark)).collect()}
    want = rank / rank.sum()
    assert set(got) == set(np.flatnonzero(rank > 0).tolist()) and n + 60 in got
    assert max(abs(got[i] - want[i]) for i in got) < 1e-3 and max(abs(got[i] / want[i] - 1) for i in got) < 0.05


def test_links_that_count(spark):
    html = """<A Href='http://One.net/x'> <!-- <a href="http://hidden.net/"> --> <script>var x = '<a href="http://script.net/">'</script> <img SRC=//two.net:80/i.png> <a href="/own"> <style>url(//s.net)</style>"""
    rows = spark.createDataFrame([(1, "http://src.net/", html), (2, None, html), (3, "http://one.net/", None), (4, "http://" + "long" * 20_000 + ".net/", "x")], "page_id long, url string, html string")
    assert sorted(r.dst for r in url_filter.host_edges(rows).collect()) == ["one.net", "two.net:80"]
    assert url_filter.judge(rows).count() == 4


# near duplicates --------------------------------------------------------------------------------------------


def test_sketches_bound_what_differs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate((s[: len(s) - len(s) // 20], rng.integers(0, 1 << 63, len(s) // 30 + 1).astype(np.uint64)))) for s in sets]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    maps = _sketch.sketches(np.concatenate(sets), bounds)
    x, y = map(np.ravel, np.meshgrid(np.arange(40), np.arange(40)))
    told = _sketch.apart(maps, maps, x, y)
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    assert (told <= true).all() and (told[x == y] == 0).all() and np.mean(told[true > 500] > 100) > 0.9


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for k in range(6000):
        copy = list(base)
        copy[rng.randrange(60)] = f"w{k}"
        texts.append(" ".join(copy))
    far = [" ".join(base[:30] + [rng.choice(vocabulary) for _ in range(30)]) for _ in range(300)]  # meet the group in its lists
    rows = list(enumerate(texts + far + [texts[0]] * 500))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {got[i] for i in range(6000)} == {0} == {got[i] for i in range(6300, 6800)}
    assert all(got[i] == i for i in range(6000, 6300))


def test_rows_that_share_an_id(spark):
    rng = random.Random(6)
    a, b = (prose(rng, 40, [f"q{i}" for i in range(99)]) for _ in range(2))
    rows = [(1, a, 1), (1, b, 2), (1, a, 3), (2, b, 4), (3, a, 5), (4, "", 6), (4, "", 7), (None, a, 8), (4, None, 9)]
    got = sorted((r.doc_id or 0, r.text or "") for r in jaccard.clean(spark.createDataFrame(rows, "doc_id long, text string, _doc_id int")).collect())
    assert got == sorted([(1, a), (1, b), (4, ""), (4, ""), (0, a)])


@pytest.mark.parametrize("few, cost, block", [(512, 4, 7), (2, 0, 3)])  # blocks of components, and lists
def test_every_link(spark, monkeypatch, few, cost, block):
    for name, v in (("FEW", few), ("LIST_COST", cost), ("BLOCK", block)):
        monkeypatch.setattr(jaccard, name, v)
    rng, vocabulary = random.Random(11), [f"v{i}" for i in range(90)]
    texts = ["", "  ", "a", "A", "b c"]
    for size in (8, 30, 60, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for k in range(15):  # drifts, so that not all of a group are alike
            texts.append(" ".join(base))
            base[rng.randrange(size)] = f"w{size}x{k}"
    base = [rng.choice(vocabulary) for _ in range(100)]
    texts += [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(40)]  # all alike
    rows = list(enumerate(texts + texts[10:12] + [texts[20].upper()]))
    rows += [rows[20], (21, "B C")]  # a row again, and a doc_id with another text
    docs = sorted(set(rows))
    sets = [shingle_set(t) for _, t in docs]
    alike = [[bool(x) and 100 * len(x & y) >= 75 * len(x | y) for y in sets] for x in sets]
    run = jaccard.Join(spark.createDataFrame([*rows, (None, "a")], "doc_id long, text string").repartition(3), listed=True)
    names = {r.set_id: r.doc_id for r in run.sets.collect()}
    got = sorted(tuple(sorted((names[r.a], names[r.b]))) + (r.common,) for r in run.links.collect())
    least = {}
    for k, s in enumerate(sets):
        least.setdefault(frozenset(s), k)
    true = sorted((docs[i][0], docs[j][0], len(sets[i] & sets[j])) for i in least.values() for j in least.values() if docs[i][0] < docs[j][0] and alike[i][j])
    assert got == true and run.spanning.count() < len(true)
    counts = sorted((r.doc_id, r.n_links) for r in run.counts().collect())
    assert counts == sorted((docs[i][0], sum(alike[i]) - alike[i][i]) for i in range(len(docs)))


# substrings, benchmarks, pipeline ---------------------------------------------------------------------------


def test_substrings_with_clashing_columns(spark):
    rng = random.Random(8)
    shared = prose(rng, 30, [f"s{i}" for i in range(99)])
    rows = [(i, f"{prose(rng, 9, [f'x{i}{j}' for j in range(20)])} {shared}", i, "k", [i]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _repeat_id int, _repeat_key string, _repeat_at array<int>")
    out = {r.doc_id: r for r in substrings.clean(docs).collect()}
    for i, n, gone, _ in without_repeats([(r[0], r[1]) for r in rows], 13):
        assert len(out[i].text.split()) == n - gone and out[i]["_repeat_at"] == [i] and out[i]["_repeat_key"] == "k"


def test_equal_hashes_of_different_windows(monkeypatch):
    items = [(k, f"alpha{k} beta{k} gamma{k}") for k in range(4)]
    real = decontaminate.window_hashes
    monkeypatch.setattr(decontaminate, "window_hashes", lambda w, n, seed=0: np.zeros_like(real(w, n, seed)))
    index = decontaminate.build(items, 3)
    data, offsets = utf8(pa.array(["x alpha2 beta2 gamma2 y", "alpha0 beta1 gamma2"]))
    _, hit, found = decontaminate.scan(data, offsets, index)
    assert found == {0: {"2"}} and hit.tolist() == [False, True, True, True, False, False, False, False]


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kinds = dict(docs.dtypes)
    rows = docs.unionByName(docs.limit(20)).unionByName(spark.range(3).select(*(F.lit(None).cast(kinds[c]).alias(c) for c in docs.columns)))
    rows = rows.withColumn("_hit", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("n", F.lit(None).cast("int"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = corpus_pipeline.run(spark, DIR).select("doc_id", "start", "length", "ids_crc32").collect()
    odd = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, odd)) == sorted(map(tuple, whole))


def test_components_of_documents_with_nulls(spark):
    texts = [None, "", "a b", "a b", "c d e f g h i", "c d e f g h i j"]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(3)).withColumn("k1", F.lit("z"))).collect()))
    assert got == sorted(component_ids(texts))
