"""From raw documents to encoded training text, in five written stages."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewarden.llm import bpe_automaton, line_spread, quality_qda, simhash_tiles, template_leaks
from pagewarden.llm.common import materialize, read
from pagewarden.llm.queries import VOCABULARY, held_out

# Near duplicates: the contract of the operator, words of a shingle and differing bits of 64.
WORDS, RADIUS = 4, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = read(spark, sf_dir, "labels").where(~held_out())
    stats = materialize(quality_qda.with_statistics(docs), "quality-stats")
    model = quality_qda.fit(stats, labels)
    return quality_qda.with_score(docs, model, "_quality").where(
        F.col("_quality") >= quality_qda.CUT).drop("_quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; n_chars follows the text.

    Near duplicates that are mostly such lines stay whole: the next stage leaves one of them.
    """
    clean = line_spread.without_repeated_lines(
        docs, alike=lambda mostly: simhash_tiles.near_duplicates(mostly, WORDS, RADIUS))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return clean.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return simhash_tiles.one_of_each(docs, WORDS, RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return template_leaks.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document left."""
    return bpe_automaton.token_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

# No stage but the line dedup can be said in SQL; tests/llm holds the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
