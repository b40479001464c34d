"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Every stage takes what it needs of ``documents`` and leaves other columns behind, whatever their names.  Nulls in
``lang``, ``source`` and ``n_chars`` are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import credential_links, dart_minhash, rule_ensemble
from clausewright.llm.curve_packing import curve_packed
from clausewright.llm.shared import materialise
from clausewright.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject (score of 0.3 or more), as they are.

    A null text scores as the empty one; equal texts score alike, so ties and repeated rows stay or go together.
    """
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.scored(docs, model, out="quality_score", least=0.3).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, as it is: one with the least key and, of several texts under it, the least digest.

    All texts without a word, null ones among them, are one class; repeated rows are one document; a row without a key
    stays only if its class has no key.
    """
    return dart_minhash.one_of_each(docs).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier; documents of which nothing is left go.

    ``n_chars`` is counted anew where a text changed.  A null text comes out empty; a row without a key comes after all
    others; repeated rows are one document; texts under one key go by a hash of theirs.
    """
    out = remove_repeats(docs, carry=("lang", "source", "n_chars"), whole_chars=True)
    text = F.col("kept").cast("string")
    changed = F.col("n_removed") > 0
    return out.where(~changed | (F.octet_length("kept") > 0)).select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by their kind; ``n_chars`` is counted anew where a text changed.

    A text without secrets, a null one too, is passed on as it is; repeated rows are each treated.
    """
    found = credential_links.scan(docs, carry=("text", "lang", "source", "n_chars"))
    spans = F.concat("strong", "linked")
    text = credential_links.redacted(F.col("text"), spans)
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, along the curve: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is the empty one, whose only id is the closing one; repeated rows are each packed; a null key is kept.
    """
    return curve_packed(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("secrets", secrets), ("packing", packing)]

#: The stages train, hash, sort and tokenise: not SQL.  tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
