"""The corpus pipeline: five stages over `documents`, each working on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
A driver may write each stage's result as Parquet and read it back for the next, as the check does, or call run(). Null
and empty texts stay in until the encoder, which gives them no tokens, unless the quality classifier rejects them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfare.llm import bpe, decontam, line_dedup, ngram_join, quality_crf
from lumenfare.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores below 0.3 go; labels are learnt from the rows that are not held out."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that at least three documents share stay only in the largest doc_id; n_chars follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 or more on five-word shingles, one row of the smallest doc_id stays."""
    return ngram_join.keep_first(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (binary, little-endian unsigned 32-bit), their number, and digests of ids and of the decoded bytes."""
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = F.expr("cast(octet_length(_ids) div 4 as long)")
    return out.select("doc_id", "lang", "source", n.alias("n_tokens"), F.col("_ids").alias("token_ids"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: The classifier, the alignment and the encoder have no SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's rows are written in the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
