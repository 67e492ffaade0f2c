import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from framelake.llm._scratch import Scratch

from test_text_operators import ALNUM, SPACE, component_ids, contamination, lower, without_repeats

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    scratch, docs, seen = Scratch(spark), spark.read.parquet(f"{DIR}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0]))
        assert docs.columns == columns
        docs = scratch.keep(stage(spark, docs, DIR)).df
    start, language, near, substring, clean = seen
    assert [i for i, _ in language] == [i for i, t in start if any(c.isalpha() for c in t or "")]

    ids, texts = zip(*language, strict=True)
    assert near == [language[k] for k in sorted({c for _, _, c in component_ids(texts)})]
    assert list(ids) == sorted(ids)

    after = dict(substring)
    for i, n, gone, _ in without_repeats(near, 13):
        if n == gone:
            assert i not in after
        else:
            assert len(SPACE.findall(after[i])) == n - gone

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    after = dict(clean)
    for (i, t), (_, n, hit, *_) in zip(substring, contamination([t for _, t in substring], items), strict=True):
        if not hit:
            assert after[i] == t
        elif n == hit:
            assert i not in after
        else:
            assert len(ALNUM.findall(lower(after[i]))) == n - hit

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in clean}
    got = docs.collect()
    assert sum(r.length for r in got) == sum(map(len, tokens.values()))
    for r in got:
        assert zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    odd = ["日本語のテキストです。これは長い文です。", "Это русский текст о погоде и о природе", "xqzv kjhw zzzz qqqq wwwx vvkq", "0x7f3a 9b2c deadbeef c0ffee", " 12 "]
    more = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(odd)], docs.schema)
    got = sorted(r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), DIR).collect())
    assert got == sorted(r.doc_id for r in docs.collect())


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
