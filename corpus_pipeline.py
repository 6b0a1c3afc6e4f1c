"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayworks.llm.byte_bpe import encode, read_ranks
from assayworks.llm.common import table, written
from assayworks.llm.minhash_dedup import without_near_duplicates
from assayworks.llm.mixing import mix_sources
from assayworks.llm.substring_dedup import RESERVED, substring_dedup
from assayworks.llm.toxicity import fit, toxicity


def _aside(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """The documents with names that the operator makes out of its way, and what they are now called."""
    names = {c: f"{c}_of_documents" for c in docs.columns if c in made}
    while set(names.values()) & set(docs.columns):
        names = {c: f"{n}_" for c, n in names.items()}
    return docs.withColumnsRenamed(names), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the grammar does not predict to be toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    renamed, names = _aside(docs, ("score", "predicted", "matched_clauses"))
    scored = toxicity(renamed, model)
    return scored.where("predicted = 0").select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without_near_duplicates(docs)


def drop_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in windows that start earlier; untouched texts stay as they are."""
    renamed, names = _aside(docs, RESERVED)
    cut = substring_dedup(renamed)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": n_chars}
    return cut.select(*[new.get(c, F.col(f"`{names.get(c, c)}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, in random order."""
    return mix_sources(docs, power=0.7, seed=0, copy=None)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(docs, ranks, public_tokenizers.PATTERN, ids=True, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_long_repeats),
    ("mixing", mix),
    ("byte-level BPE", tokenize),
]

#: Learned weights, recompression and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
