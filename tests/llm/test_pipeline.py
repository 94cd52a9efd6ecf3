"""The pipeline against DuckDB SQL for its first four stages and a public tokenizer library for the last."""

import hashlib
from collections import Counter

import duckdb
import pytest
from conftest import rows

import corpus_pipeline
from packetlens.llm.jaccard import jaccard_ctes
from packetlens.llm.lines import lines_ctes
from packetlens.llm.mixing import mixing_ctes
from packetlens.llm.quality import quality_sql


def expected(path: str) -> Counter:
    import public_tokenizers
    import tiktoken

    from packetlens.llm.bpe import read_ranks

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    con.sql(f"CREATE TABLE s4 AS SELECT doc_id, text, source FROM ({quality_sql('documents', 'doc_id, text, source')}) WHERE kept")
    con.sql(f"CREATE TABLE s10 AS WITH {lines_ctes('s4')} SELECT doc_id, clean AS text, source FROM deduped")
    con.sql(f"CREATE TABLE s7 AS WITH RECURSIVE {jaccard_ctes('s10')} SELECT s10.* FROM s10 JOIN comp USING (doc_id) WHERE comp.component_id = doc_id")
    con.sql(f"CREATE TABLE s3 AS WITH {mixing_ctes('s7')} SELECT doc_id, text, copies FROM mixed WHERE copies > 0")
    ranks = read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for doc, text, copies in con.sql("SELECT * FROM s3").fetchall():
        ids = enc.encode_ordinary(text)
        out[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += copies
    return out


def test_pipeline(spark, sf):
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == expected(f"{sf}/documents.parquet")


def test_mixed_rows_equal_sql(spark, sf, oracle):
    assert rows(corpus_pipeline.run_mixed(spark, sf)) == oracle(corpus_pipeline.ORACLES["pipeline_mixed"])


CLASHING = "key string, label string, s string, n int, h string, bucket string, doc string, keys string, size string, copies string, th string, r string, col string"


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_the_columns_and_stand_nulls(spark, sf, step):
    text = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "the word of it " * 9, "en", "a", 3), (4, "the of and to a in is it was for on that by this with be as at from the", "en", "b", 9)]
    extra = ("x", "y", "z", 7, *"abcdefghi")
    docs = spark.createDataFrame([(*r, *extra) for r in text * 2], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    name, stage = corpus_pipeline.STAGES[step]
    out = stage(spark, docs, sf)
    if name == "tokens":
        got = Counter((r.doc_id, r.n_tokens > 0) for r in out.collect())
        assert got == Counter({(i, bool(t)): 2 for i, t, *_ in text})
    else:
        assert out.columns == docs.columns
        assert all(tuple(r)[5:] == extra for r in out.collect())
    assert stage(spark, docs.where("false"), sf).count() == 0
