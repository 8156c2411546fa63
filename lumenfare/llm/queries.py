"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, decontam, fingerprint, html_extract, line_dedup, ngram_join, quality_crf, repair, secrets, spelling, toxicity, warc
from .common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprint(spark, sf_dir):
    return fingerprint.digest(table(spark, sf_dir, "documents"))


def op2_near_classes(spark, sf_dir):
    return fingerprint.near_classes(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    return html_extract.digest(table(spark, sf_dir, "pages"))


def op7_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark, sf_dir):
    return quality_crf.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chat_format(spark, sf_dir):
    return chat.digest(table(spark, sf_dir, "conversations"))


def op11_secrets(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repair.digest(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprint": op2_fingerprint,
    "op2_near_classes": op2_near_classes,
    "op3_ngram_join": op3_ngram_join,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_chat_format": op10_chat_format,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
}
