import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import decontaminate, fingerprint, jaccard, packing, substrings, token_counts
from framelake.llm._arrow import slices, utf8

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def distinct(rows):
    return sorted(set(map(tuple, rows)), key=str)


# token counts and packing ------------------------------------------------------------------


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts(docs, nothing, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(docs, path).collect()}
    want = [(len((t or "").encode()), len(ids), len(ids) > 1024) for t, ids in zip(texts, library("byte_bpe_50k.json", texts), strict=True)]
    assert [got[i] for i in range(len(texts))] == want
    assert token_counts.count(nothing, path).count() == 0 and token_counts.count(docs, path).count() == len(texts) + 2


def test_token_counts_of_odd_texts():
    import random

    rng, path = random.Random(1), public_tokenizers.path("byte_bpe_50k.json")
    parts = [*"abst'relv  \n\t!?.,12é漢ñ　\xa0’D<|>", "'ll", "'re", "<|endoftext|>", "   "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 9000, "<|endoftext|>" * 3, " " * 500]
    machine = token_counts.merger(path)
    got = np.concatenate([token_counts.count_tokens(d, o, machine) for _, _, d, o in slices(*utf8(pa.array(texts)))])
    assert got.tolist() == [len(x) for x in library("byte_bpe_50k.json", texts)]


def test_packing(spark, docs, nothing, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    ids = [np.array(x + [1], "<u4") for x in library("word_bpe_49k.json", texts)]
    want = Counter()
    for i in [*range(len(texts)), 12, 13]:
        for a in range(0, len(ids[i]), 2048):
            piece = ids[i][a : a + 2048]
            want[i, a, len(piece), zlib.crc32(piece.tobytes()), len(ids[i])] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(nothing, path).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(0)
    demand = np.bincount(np.minimum(255, rng.exponential(60, 20_000).astype(int)), minlength=256)
    plan = packing.cutting_stock(demand)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * np.arange(1, 257)).sum() <= 256 for p, _ in plan)
    bound = (demand * np.arange(1, 257)).sum() / 256
    assert sum(n for _, n in plan) <= bound * 1.01 + 5


# repeated substrings -------------------------------------------------------------------------


def without_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,base", [(13, 7), (13, 2), (5, 9), (3, 1)])
def test_substrings(docs, texts, window, base):
    rows = list(enumerate(texts))
    got = substrings.report(docs, window, base).collect()
    assert sorted(map(tuple, got)) == sorted(without_repeats(rows + rows[12:14], window))


def test_substrings_cleaned(docs, nothing, texts):
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in substrings.clean(docs).collect()}
    for i, n, gone, _ in without_repeats(rows, 13):
        if n and gone == n:
            assert i not in out
        elif not gone:
            assert out[i].text == texts[i]
        else:
            assert len(SPACE.findall(out[i].text)) == n - gone and out[i].n_chars == len(out[i].text)
    assert substrings.report(nothing).count() == 0 and substrings.clean(nothing).columns == docs.columns


# near duplicates ------------------------------------------------------------------------------


def shingle_set(t, n=5):
    w = SPACE.findall(lower(t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def component_ids(texts, percent=75):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


def test_jaccard(docs, nothing, texts):
    got = jaccard.join(docs).collect()
    assert distinct(got) == distinct(component_ids(texts)) and len(got) == len(texts) + 2
    assert jaccard.join(nothing).count() == 0
    kept = jaccard.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in component_ids(texts)})


@pytest.mark.parametrize("light", [1, 16, 64])
def test_jaccard_boundary_decides_nothing(spark, monkeypatch, light):
    import random

    rng, words = random.Random(3), [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((6, 9, 14, 24, 60)))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    got = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(component_ids(texts))


# decontamination -------------------------------------------------------------------------------


def contamination(texts, items, n=10):
    windows = {}
    for k, t in items:
        w = ALNUM.findall(lower(t or ""))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    sizes = {len(g) for g in windows}
    out = []
    for d, t in enumerate(texts):
        w, hit, found = ALNUM.findall(lower(t or "")), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, nothing, texts):
    items = [(i, " ".join((texts[11 + i] or "").split()[3:18])) for i in range(9)] + [(20, "ONE Two"), (21, None), (22, ""), (23, "É"), (3, "naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(texts, items)
    assert any(r[5] for r in want)
    for most in (decontaminate.MAX_WINDOWS, 20):
        got = decontaminate.report(docs, bench, max_windows=most).drop("items").collect()
        assert distinct(got) == distinct(want) and len(got) == len(texts) + 2
    out = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
    for d, n, hit, *_ in want:
        if not hit:
            assert out[d] == texts[d]
        elif hit == n:
            assert d not in out
        else:
            assert len(ALNUM.findall(lower(out[d]))) == n - hit
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(nothing, bench).count() == 0


def test_decontaminated_texts_do_not_depend_on_blocks(spark, docs, texts):
    items = [(i, " ".join((texts[11 + i] or "").split()[3:18])) for i in range(9)] + [(i + 30, " ".join((texts[11 + i] or "").split()[8:25])) for i in range(9)] + [(20, "ONE Two"), (23, "É")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = distinct((r.doc_id, r.text, r.n_chars, r._hit) for r in decontaminate.clean(docs.withColumn("_hit", F.lit("kept")), bench).collect())
    kept = {d: n - hit for d, n, hit, *_ in contamination(texts, items) if hit < n or not n}
    for most in (20, 60):
        got = decontaminate.clean(docs.withColumn("_hit", F.lit("kept")), bench, max_windows=most)
        assert got.columns == [*docs.columns, "_hit"]
        rows = got.collect()
        assert distinct((r.doc_id, r.text, r.n_chars, r._hit) for r in rows) == want
        assert {r.doc_id: len(ALNUM.findall(lower(r.text or ""))) for r in rows} == kept
    line = [f"w{i}" for i in range(1, 31)]
    doc = spark.createDataFrame([(1, " ".join(line))], "doc_id long, text string")
    for k in range(6):  # whichever blocks the two items fall in
        pair = spark.createDataFrame([(k, " ".join(line[:12])), (k + 50, " ".join(line[4:20]))], "item_id long, text string")
        assert [r.text.split() for r in decontaminate.clean(doc, pair, max_windows=14).collect()] == [line[20:]]
        assert decontaminate.clean(doc, pair, max_windows=14, drop_share=0.6).count() == 0


# fingerprints ------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, nothing, texts):
    rows = {r.doc_id: r for r in fingerprint.against_next(docs.dropDuplicates(["doc_id"])).collect()}
    plain = [t or "" for t in texts]
    one = [fingerprint.fingerprints(*utf8(pa.array([t])))[0] for t in plain]
    for i, t in enumerate(plain):
        following = plain[i - 1]
        changed = fingerprint.edited(t, following)
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i].fingerprint == one[i]
        assert rows[i].near_next == fingerprint.likeness([one[i]], [one[i - 1]])[0]
    long = [i for i, t in enumerate(plain) if len(t) > 300]
    assert np.mean([rows[i].near_edited for i in long]) > 0.5
    assert rows[len(texts) - 1].near_next == 0
    assert fingerprint.against_next(nothing).count() == 0
    assert fingerprint.likeness(["3:abcdefgh:abc"], ["3:abcdefgh:abc"])[0] == 1


def test_lcs_by_brute_force():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
        return row[-1]

    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 65))).encode() for _ in range(2)) for _ in range(60)]
    got, _ = fingerprint._lcs(*map(list, zip(*pairs, strict=True)))
    assert got.tolist() == [lcs(a, b) for a, b in pairs]


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k l m n o p"), (1, "a b c d e f g h i j k l m n o p"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substrings.report(docs).collect()) == [(False, 0), (True, 0), (True, 0)]
    assert {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()} == {(None, None), (1, 1)}
    assert fingerprint.against_next(docs).count() == 3
    assert token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.json")).agg(F.sum("n_tokens")).first()[0] > 0
