"""Labelled texts are learned from whole."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tessera.llm import toxicity as T


def late(n=120):
    """Examples whose telling words come after 20,000 characters."""
    rng = random.Random(5)
    plain, bad = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)], ["grumble", "snarl"]
    return [(k, " ".join(rng.choices(plain, k=3500) + (rng.choices(bad, k=3) if k % 3 == 0 else [])), int(k % 3 == 0)) for k in range(n)]


def test_toxic_words_late_in_a_text(spark):
    rows = late()
    assert all(len(t) > 20_000 for _, t, _ in rows)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    index = T.fit(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    plain = T.Index(rows)
    assert len(index.terms) and np.array_equal(index.terms, plain.terms) and np.array_equal(index.worth, plain.worth)
    assert np.array_equal(index.ids, plain.ids) and np.array_equal(index.marks, plain.marks) and np.array_equal(index.weight, plain.weight)
    calm = " ".join(rows[1][1].split()[:400])
    assert index.score(f"{calm} grumble, snarl grumble")[0] >= 0.7 > 0.3 > index.score(calm)[0]


def test_short_texts_fill_a_language(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = [(k, text(8), "aa") for k in range(3000)] + [(3000 + k, "12 34 56 78 9 " * 10 + text(1), "bb") for k in range(6000)]
    monkeypatch.setattr(L, "Model", lambda texts: texts)
    got = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert {k: len(v) for k, v in got.items()} == {"aa": L.EACH, "bb": L.EACH}


def test_language_is_learned_beyond_the_opening(spark, monkeypatch):
    rows = [(k, "opening words " * 400 + f"later {chr(97 + k % 26)}x " * 2000, "aa") for k in range(50)]
    monkeypatch.setattr(L, "Model", lambda texts: texts)
    got = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert got["aa"].count(b"later") > got["aa"].count(b"opening") > 0
