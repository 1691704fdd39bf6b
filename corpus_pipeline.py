"""From raw documents to packed training sequences.

Each stage reads what its predecessor wrote and takes its decisions into effect: documents that are
rejected go, texts lose what is to be removed. All stages but the last return the columns of
``documents``, ``n_chars`` counting the remaining text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm import decontamination, language, packing, repeats, scratch, simhash
from ledgerlight.llm.plans import table, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior probability below which no language is taken for certain.
LEAST_SCORE = 0.5
#: Words of a shingle of the near-duplicate stage; fingerprints are linked within ``simhash.MAX_BITS`` bits.
SHINGLE_WORDS = 3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the known languages; texts without a letter, null ones, and uncertain ones go.

    Rows are judged by their text alone, so repeated rows stay or go together. Other columns are not read.
    """
    table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.in_fold("doc_id")))
    known = language.identify(docs, model, "text", *COLUMNS).where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints.

    That is the one with the smallest ID, of equal IDs the first by text and the other columns; a row
    without an ID comes last. Null and blank texts are one group. Other columns are not read.
    """
    table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, SHINGLE_WORDS, carry=COLUMNS)
    first = Window.partitionBy("group").orderBy(F.col("doc_id").asc_nulls_last(), "given")
    return found.withColumn("place", F.row_number().over(first)).where("place = 1").select("given.*").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that an earlier document has too; a document with nothing left goes.

    Null and empty texts lose nothing and stay; rows with equal IDs are not earlier than each other.
    """
    table(spark, sf_dir, "documents")
    done = repeats.remove_repeats(docs, carry=("lang", "source"))
    left = done.where("n_removed = 0 or trim(kept_text) <> ''")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; a document with nothing left goes.

    Null and empty texts have no words and stay; repeated rows are cut alike.
    """
    done = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source"))
    left = done.where("n_hit = 0 or n_words > n_hit")
    return left.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("bigint").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 tokens; a null text is the end ID alone, repeated rows are packed each."""
    table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file(), length=4096, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: Naive Bayes, XXH64 and the tokenizer have no SQL form; ``tests/llm/test_pipeline.py`` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
