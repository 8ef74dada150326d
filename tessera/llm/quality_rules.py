"""Quality rules as learned decision lists.

Sequential covering on a bounded labelled sample: a rule is grown condition by condition (threshold on one text statistic, by
FOIL gain) until it covers no good text of the growing part, then pruned from its end on the other part; the texts it
covers are taken out and the next rule is grown. The list is emitted as one ordered Spark conditional expression over the
statistics columns, so its application is plain column code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import byte_texts, carried
from tessera.llm.sampling import label_sample
from tessera.llm.textstats import COUNTS, FEATURES, stats
from tessera.shipping import ship

#: Labelled rows to fit on at most.
SAMPLE = 8000
#: Statistics that rules may test: ratios, so that a text's length alone rejects nothing, and none that differ by language or layout.
TESTED = tuple(f for f in FEATURES[len(COUNTS) :] if f not in ("mean_word_chars", "words_per_line"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, stat: Column) -> Column:
        value = stat[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, TESTED.index(self.feature)]
        return v >= self.threshold if self.at_least else v < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, longest: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for f, name in enumerate(TESTED):
            v = x[inside, f]
            marks = bad[inside]
            levels = np.unique(np.quantile(v[marks], np.linspace(0, 1, 33)))
            for at_least in (True, False):
                for t in levels:
                    got = v >= t if at_least else v < t
                    p = (got & marks).sum()
                    if p and (gain := p * (np.log2(p / got.sum()) - base)) > best[0] + 1e-9:
                        best = (gain, Condition(name, at_least, float(t)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    got = covers(rule, x)
    p, n = (got & bad).sum(), (got & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def simplified(rule: Rule) -> Rule:
    """The rule without conditions that another one on the same statistic implies."""
    tightest: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        had = tightest.get((c.feature, c.at_least))
        if had is None or (c.threshold > had.threshold) == c.at_least:
            tightest[c.feature, c.at_least] = c
    return tuple(tightest.values())


def learn(x: np.ndarray, bad: np.ndarray, most: int = 12, longest: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Ordered rejection rules from statistics (TESTED, a row each) and marks. No bad or no good text: no rules."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    prune = np.arange(len(x)) % 3 == 2
    while len(rules) < most:
        grow_rows, prune_rows = left & ~prune, left & prune
        if (bad & grow_rows).sum() < least or not (~bad & grow_rows).any():
            break
        rule = _grow(x[grow_rows], bad[grow_rows], longest)
        while len(rule) > 1 and _worth(rule[:-1], x[prune_rows], bad[prune_rows]) >= _worth(rule, x[prune_rows], bad[prune_rows]):
            rule = rule[:-1]
        got = covers(rule, x) & left
        p, n = (got & bad).sum(), (got & ~bad).sum()
        if not rule or p < least or p / (p + n) < precision:
            break
        rules.append(simplified(rule))
        left &= ~got
    return rules


def expression(rules: list[Rule], stat: Column) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(stat)
        for c in rule[1:]:
            test &= c.column(stat)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def with_stats(docs: DataFrame, carry: Column | None, name: str) -> DataFrame:
    """`carry` (or the whole row) as `name` and `stat`, the struct of FEATURES of the whole text."""
    ship(docs.sparkSession)
    kind = pa.struct([(f, pa.float64()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([stats(t.as_py()) for t in byte_texts(batch)], float).reshape(-1, len(FEATURES))
            stat = pa.StructArray.from_arrays([pa.array(values[:, i].copy()) for i in range(len(FEATURES))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), stat], [name, "stat"])

    rows = carried(docs, carry, name)
    return rows.mapInArrow(run, f"`{name}` {rows.schema[0].dataType.simpleString()}, stat struct<{', '.join(f'{f}: double' for f in FEATURES)}>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: Column | None = None) -> list[Rule]:
    """Rules from at most `sample` labelled rows (quality 0 is bad) for which `keep` over doc_id holds.

    Texts that the base rules reject are left out: no learned rule ever decides on them. An id with several texts is read by that of the smallest hash."""
    picked = label_sample(labels, "quality", sample, keep)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    known = with_stats(rows, F.struct("doc_id", "label", F.xxhash64("text").alias("h")), "k").select("k.*", "stat")
    one = known.groupBy("doc_id").agg(F.min(F.struct("h", "label", "stat")).alias("s")).select("doc_id", "s.label", "s.stat")
    got = one.where(~base_failed(F.col("stat"))).orderBy("doc_id").collect()
    x = np.array([[r["stat"][f] for f in TESTED] for r in got], float).reshape(-1, len(TESTED))
    return learn(x, np.array([r["label"] == 0 for r in got], bool))


def base_failed(stat: Column) -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (stat["n_words"] < 10) | (stat["n_repeat_words"] * 100 > stat["n_words"] * 20)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, base_failed, rule (the first that rejects, else 0) and kept for every row of docs.

    Null or wordless text: all counts 0, base_failed, not kept. Repeated rows are judged alike, one result each; a null
    doc_id stays null; very long texts are counted whole; a value that ties with a threshold is at least it. Columns beyond doc_id and text, whatever their
    names, are ignored. Empty table: no rows."""
    stat = F.col("stat")
    return (
        with_stats(docs, F.col("doc_id").cast("long"), "doc_id")
        .select("doc_id", *[stat[c].cast("long").alias(c) for c in ("n_words", *COUNTS[1:])], base_failed(stat).alias("base_failed"), expression(rules, stat).alias("rule"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names; nulls, very long texts, ties and
    repeated rows are treated as there. Empty table: no rows."""
    rows = with_stats(docs, None, "row")
    return rows.where(~base_failed(F.col("stat")) & (expression(rules, F.col("stat")) == 0)).select("row.*")
