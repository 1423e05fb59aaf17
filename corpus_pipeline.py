"""A corpus from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, mixing, simhash, suffixes, toxicity
from lotwise.llm.common import delete, new_path, scratch
from lotwise.llm.queries import domain_labels, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Shares of tokens that the mixture aims at.
WEIGHTS = {"sound": 0.95, "junk": 0.05}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled ones, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by five-word shingles."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters of which all bytes lie in a string of 200 bytes that occurs elsewhere.

    A document of which nothing is left goes; one that was empty before stays.
    """
    found = suffixes.repeats(docs, 200, ("doc_id", "lang", "source", "n_chars"), whole_characters=True)
    left = F.decode("kept", "UTF-8")
    cut = F.size("spans") > 0
    rest = found.withColumn("n_chars", F.when(cut, F.char_length(left).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.when(cut, left).otherwise(F.col("text")))
    return rest.where(~cut | (F.trim("text") != "")).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at most once each, at rates that keep all sound text and cut junk to its share."""
    labels = domain_labels(spark, sf_dir).withColumn("domain", F.split("domain", "_")[0])
    model = mixing.fit(docs, labels, list(WEIGHTS))
    # goals out of reach must not stop a corpus: sound text keeps its rate, junk as near its share as it comes
    mixed = mixing.mix(docs, model, WEIGHTS, COLUMNS, whole=("sound",), strict=False).rated
    return mixed.where(mixing.draws(F.col("rate"), "doc_id", "text") > 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, four bytes each) of every text, and whether decoding them gives the text again."""
    vocabulary = bpe.Vocabulary(vocabulary_path())
    keep = ("doc_id", "lang", "source", "n_chars", "text")
    back = bpe.round_trip(docs.withColumn("text", F.coalesce("text", F.lit(""))), vocabulary, keep=keep)
    return back.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("toxicity", reject_toxic), ("simhash", drop_near_copies), ("suffixes", cut_repeats), ("mixing", mix_domains), ("bpe", encode)]

#: SQL can't express fits, fingerprints' components or BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves beside its output, and the output before it, is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
