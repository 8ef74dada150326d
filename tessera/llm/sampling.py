"""Bounded labelled samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def label_sample(labels: DataFrame, label: str, most: int, keep: Column | None = None, only: int | None = None) -> DataFrame:
    """(doc_id, label int) of at most `most` labelled ids, an even draw by hash; with `only`, of those with that label.
    Conflicting rows of an id: the smaller label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if keep is not None:
        rows = rows.where(keep)
    ids = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    return (ids if only is None else ids.where(F.col("label") == only)).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)


def heaviest(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of a table of counts (`n`, 1 or more) with the largest counts, at most `most` of them: all whose count reaches a bound.

    The bound comes from a histogram over sixteenths of powers of two, so no task sorts or merges rows; rows of one count stay or go together."""
    step = F.floor(F.log2(F.col(n)) * 16)
    found = sorted(((r["s"], r["c"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    bound, total = None, 0
    for s, c in found:
        total += c
        if total > most:
            break
        bound = s
    return counts.where(step >= bound) if bound is not None else counts.limit(0)
