"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() applies them to the table
documents. ORACLE_SQL is None: the learned rules and the packing can't be expressed in SQL; tests/llm hold run()
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import read, stored
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.ngram_join import near_dedup
from loomgraph.llm.packing import pack
from loomgraph.llm.quality_rules import learn_rules, quality_filter


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule rejects. NULL and empty texts have all statistics 0 and are judged by these; repeated
    rows share their fate. Without labelled documents all stay. No rows give no rows."""
    return quality_filter(docs, learn_rules(docs, read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest identifier; of repeated rows one. Empty texts are copies of each
    other; rows with a NULL text all stay. No rows give no rows."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest identifier. Texts that are NULL or have no words,
    and rows without an identifier, all stay. No rows give no rows."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, for shares of the sources in proportion to the root of their sizes. A NULL source is
    one of its own; where n_chars is NULL the text is measured; a source of no characters is left out. Rows that share an
    identifier are repeated as often as each other. No rows give no rows."""
    return mix_sources(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with their text, and their windows. A document without tokens, such as a NULL or empty text, is
    a piece in no window. Repeated rows are packed each time. No rows give no rows."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What each stage before it returns is written once, in the folder of checkpoints that all
    executors share, and deleted when the next stage's is written; the last one's stays, as the result is read from it."""
    docs, drop = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, drop_next = stored(stage(spark, docs, sf_dir))
        if drop:
            drop()
        drop = drop_next
    return STAGES[-1][1](spark, docs, sf_dir)
