"""The corpus pipeline: documents in, tokens out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``; the last one returns the tokens.

1. quality: the line CRF is fitted on the given labels; documents scoring under
   the threshold go, empty ones among them.
2. lines: lines within one word of an earlier one go, and ``n_chars`` follows;
   documents of which that leaves nothing, copies of earlier ones, go whole.
3. near: one document of each group linked by a similarity of 0.8 or more
   stays; documents left without words are linked with nothing and stay.
4. benchmark: documents that hold a ten-word window of a benchmark item go.
5. tokens: doc_id, lang, source, n_tokens, ids and the digest of the decoded
   text of every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe, crf_quality, decontaminate, line_dedup, minhash
from tidewheel.llm.queries import tokenizer_path

#: Hundredths of Jaccard similarity from which documents are linked; a pair at it shares none of 40 bands of 6 minima with
#: a probability of 5e-6.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf_quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.replace_text(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, threshold=NEAR, bands=40, rows=6)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(decontaminate.is_clean(found.columns[-1])).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), out="r")
    return coded.select("doc_id", "lang", "source", (F.length("r.ids") / 4).cast("long").alias("n_tokens"), F.col("r.ids").alias("ids"), F.sha2(F.col("r.decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]
#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
