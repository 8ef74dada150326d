"""Corpus preparation in five stages: quality rules, language ID, near-dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) over all that its predecessor kept; run() writes each result to the
shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, packing, quality_rules, registry, simhash
from tessera.llm.sampling import fold
from tessera.sources.store import dealt, dropped, written

#: Packing by a byte-level BPE vocabulary, quality rules and language models are learned: SQL has none of them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list.

    Null, empty and wordless texts go; rows that repeat stay or go together, whatever their doc_id; very long texts are read whole; a tie with a threshold counts as at least it. Empty table: no rows."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence.

    Null texts and texts without a letter go; a tie of languages is no confidence; repeated rows stay or go together; very long texts are read whole. Empty table: no rows."""
    return language_id.keep_known(docs, language_id.fit(docs, fold(docs["doc_id"], 5) != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: texts whose sets of five-word shingles have a similarity of about 0.8 or more, and what they link.

    Null and wordless texts are copies of each other; a null doc_id stays only where its group has no other; repeated rows, very long texts and an empty table: as one_of_each() says."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to the threshold.

    Null and empty texts hold none; repeated rows stay or go together; very long texts are tiled whole, ties between tiles go by position. No items: all rows; empty table: none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: every id of every row in one.

    Null and empty texts give their end alone; a null doc_id stays null; repeated rows are packed once each; very long texts are cut over sequences. Empty table: no rows."""
    return packing.pack(docs, registry.tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        before = docs
        docs = written(stage(spark, before, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
