"""The corpus pipeline: five of the operators, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Byte-level BPE cannot be said in SQL, so ``ORACLE_SQL`` is None and the tests hold the
rows against SQL for the first four stages and a public tokenizer library for the last. The first four stages
are the query ``pipeline_mixed``, which has SQL.
"""

import public_tokenizers
from pyspark.sql import functions as F

from packetlens.llm.bpe import bpe_tokens, token_digests
from packetlens.llm.common import OWN, settle, table
from packetlens.llm.jaccard import jaccard_ctes, near_dedup
from packetlens.llm.lines import line_dedup, lines_ctes
from packetlens.llm.mixing import mixed_rows, mixing_ctes
from packetlens.llm.quality import quality_rules, quality_sql


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    row = docs.select(F.struct(*docs.columns).alias(OWN + "row"), "text")
    return quality_rules(row).where("kept").select(OWN + "row.*")


def lines(spark, docs, sf_dir):
    """Boilerplate lines of a source go; n_chars follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked documents stays."""
    return near_dedup(docs)


def mix(spark, docs, sf_dir):
    """Documents are left out, kept or repeated as their source's target asks."""
    return mixed_rows(docs)


def tokens(spark, docs, sf_dir):
    """Each row's tokens: count, digest of the ids and of the decoded bytes."""
    return token_digests(bpe_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def _through(spark, sf_dir, stages):
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        out = stage(spark, docs, sf_dir)
        docs = out if name == stages[-1][0] else settle(out)
    return docs


def run(spark, sf_dir):
    return _through(spark, sf_dir, STAGES)


def run_mixed(spark, sf_dir):
    """The rows that the last stage gets."""
    return _through(spark, sf_dir, STAGES[:-1]).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def mixed_sql() -> str:
    """DuckDB SQL for the first four stages."""
    return f"""
WITH RECURSIVE good AS (SELECT doc_id, text, lang, source FROM ({quality_sql("documents", "doc_id, text, lang, source")}) WHERE kept),
{lines_ctes("good")},
clean_docs AS (SELECT doc_id, clean AS text, lang, source FROM deduped),
{jaccard_ctes("clean_docs")},
unlike AS (SELECT clean_docs.* FROM clean_docs JOIN comp USING (doc_id) WHERE comp.component_id = doc_id),
{mixing_ctes("unlike")}
SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT *, unnest(range(copies)) FROM mixed)"""


QUERIES = {"pipeline": run, "pipeline_mixed": run_mixed}
ORACLES = {"pipeline_mixed": mixed_sql()}
