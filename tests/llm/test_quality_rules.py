import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q
from tessera.llm.sampling import fold
from tessera.llm.textstats import COUNTS, FEATURES, stats


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines, earlier, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


@given(st.one_of(st.none(), st.text(alphabet="aé#|\n \t\x0b\x85🙂", max_size=80), st.lists(st.sampled_from(["a", "b", "é", "a\n"]), max_size=60).map(" ".join)))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    # The contract counts symbols within whole texts; white space and words are ASCII's.
    assert stats(None if text is None else text.encode())[:5] == plain_counts(text)


def test_many_different_words():
    words = [str(i) for i in range(9000)] + ["x1", "x2", "x3", "x4", "x5"] * 2 + [str(i) for i in range(9000, 9100)]
    assert stats(" ".join(words).encode())[:5] == plain_counts(" ".join(words))


def test_learned_list():
    rng = np.random.default_rng(1)
    x = rng.random((900, len(Q.TESTED)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] < 0.2) & (x[:, 4] > 0.5))
    rules = Q.learn(x, bad)
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= Q.covers(r, x)
    assert (got == bad).mean() > 0.97 and len(rules) >= 2
    assert Q.learn(x, np.zeros(900, bool)) == [] == Q.learn(x[:0], bad[:0]) == Q.learn(x, np.ones(900, bool))


def test_expression_is_the_list(spark):
    rules = [(Q.Condition("upper_share", True, 0.5), Q.Condition("symbols_per_word", False, 0.1)), (Q.Condition("symbols_per_word", True, 0.3),)]
    texts = ["SHOUT LOUD", "a # b # c", "calm", "# # A", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["rule"] for r in Q.judge(df, rules).collect()}
    for i, t in enumerate(texts):
        x = np.array([[stats(t.encode())[FEATURES.index(f)] for f in Q.TESTED]])
        assert got[i] == next((k for k, r in enumerate(rules, 1) if Q.covers(r, x)[0]), 0)


def test_verdicts_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = Q.fit(docs, labels)
    judged = Q.judge(docs, rules).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((F.col("rule") > 0).cast("int")).alias("ruled")).collect()
    share = {r["quality"]: r for r in judged}
    assert share[1]["ruled"] < 0.01 and share[0]["kept"] < 0.05


def test_verdicts_on_rows_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = Q.fit(docs, labels, keep=fold(F.col("doc_id"), 5) != 0)
    held = labels.where(fold(F.col("doc_id"), 5) == 0)
    judged = Q.judge(docs, rules).where("NOT base_failed").join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    share = {r["quality"]: r for r in judged}
    print({q: (r["n"], r["kept"]) for q, r in share.items()})
    assert share[1]["kept"] > 0.99 and (0 not in share or share[0]["kept"] < 0.1)


def test_redundant_conditions_go():
    c = Q.Condition
    rule = (c("repeat_share", True, 0.54), c("upper_share", False, 0.3), c("repeat_share", True, 0.87), c("upper_share", False, 0.4))
    assert Q.simplified(rule) == (c("repeat_share", True, 0.87), c("upper_share", False, 0.3))


def test_counts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in Q.judge(docs, []).collect():
        want = plain_counts(text[r["doc_id"]])
        assert [r[c] for c in ("n_words", *COUNTS[1:])] == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r["kept"] == (not r["base_failed"])


def test_edge_rows(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, "k"), (1, good, "k"), (2, None, "k"), (3, "", "k"), (None, good, "k"), (4, good * 20_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = Q.judge(df, []).collect()
    assert len(got) == 6 and [r["n_words"] for r in got if r["doc_id"] in (2, 3)] == [0, 0]
    assert sorted((r["doc_id"] or 0) for r in got if r["kept"]) == [0, 1, 1]
    kept = Q.keep_good(df, [])
    assert kept.columns == df.columns and kept.count() == 3
    assert Q.judge(df.limit(0), []).count() == 0 and Q.keep_good(df.limit(0), []).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert Q.fit(df, labels) == [] and Q.fit(df, labels.limit(0)) == []
    assert FEATURES[:5] == COUNTS
