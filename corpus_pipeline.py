"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before kept, and all but the last return the columns of ``documents``.
Rejections are anti-joins on doc_id, so clean rows pass unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import exact_dedup, jaccard, language, packing, quality
from panelmill.llm.common import read, stash, without

#: Bits a byte beyond which a text is in none of the languages: their own take 2 to 4, bytes never seen 10 and more.
MOST_BITS = 9.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language: null, without letters, or too costly to code in every one. A null lang is filled in.

    Rows that repeat an id are judged each by its own text; a table without a training row is judged ``und`` and goes; columns of
    any other name pass as they are, as the rest of the row travels as one value beside the text.
    """
    counts = language.train(docs, F.lit(True))
    others = [c for c in docs.columns if c.lower() != "text"]
    rows = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"))
    found = language.identify(rows, counts)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS))
    back = {c: F.col(f"_row.`{c}`") for c in others} | {"lang": F.coalesce(F.col("_row.lang"), "lang_pred")}
    return kept.select(*[back.get(c, F.col("text")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are outliers of their language and source. Null texts have no words and go;
    a null lang or source is a group of its own; of rows that share an id all go if one is rejected; an empty table stays empty."""
    return without(docs, quality.judge(docs).where(~F.col("kept")), "doc_id")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the smallest doc_id; null ids come last, and of rows that repeat an id and a text one stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingle similarity 0.8 or more connect, keeps the smallest doc_id. Texts without
    words link with nothing and stay; a text of fewer than five words is one shingle; a text of any length is one set."""
    joined = jaccard.join(docs, n_words=5, percent=80)
    return without(docs, joined.where(F.col("component_id") != F.col("doc_id")), "doc_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences of 2048; a null text is the end mark alone, longer ones are cut."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("pack", pack),
]

#: Tokens and code lengths cannot be told in SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
