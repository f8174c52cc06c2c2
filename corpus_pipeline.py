"""Corpus pipeline: five stages over `documents`, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import decontam, mixing, sigtree, suffix, toxicity
from signalmill.llm.common import boxed, cleared, release, stored, table

#: Words of a passage that is cut where it stands again (all of over fifty words), and of its anchors.
PASSAGE, PASSAGE_ANCHOR = 51, 34


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below 0.7."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(boxed(docs, F.col("text")), net).where("score < 0.7").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones (five-word shingles, 0.8)."""
    return sigtree.keep_first(docs, 5, sigtree.Rule(80))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier in the corpus."""
    return suffix.drop_later_copies(docs, PASSAGE, PASSAGE_ANCHOR, words=True)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training course: a row per document copy taken, range-sorted by position."""
    order = mixing.training_order(mixing.mix(docs))
    return order.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "copy", "words", "position")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]
#: SQL cannot express the network's scores; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage stored for itself, and its input, are deleted once its result is written; the last one's stay for the reader."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with cleared() as made:
            docs = stored(stage(spark, docs, sf_dir), name)
            del made[docs._stored_at]
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
