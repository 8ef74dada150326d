import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tessera.llm.sampling import fold

TEXTS = {"aa": b"abab cabba abcab", "bb": b"xyzzy abx yyx", "cc": b"q"}


def plain_phrases(text: bytes, known: bytes) -> int:
    """Longest matches from left to right; a byte that no match can take starts the next phrase or is one."""
    count, at = 0, 0
    while True:
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in known:
            n += 1
        if at + n >= len(text):
            return count + 1
        count += 1
        at += n if text[at + n : at + n + 1] in known and n else n + 1


@given(st.text(alphabet="abcxyz q!", max_size=40))
@settings(max_examples=200, deadline=None)
def test_phrases(text):
    model = L.Model(TEXTS)
    raw = text.encode()
    assert model.phrases([raw, b"", raw])[[0, 2]].tolist() == [[plain_phrases(raw, TEXTS[k]) for k in model.langs]] * 2


def test_lockstep_and_plain_loop_agree():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcxyz q") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(60)]
    model = L.Model(TEXTS)
    assert (model.phrases(texts) == np.array([[plain_phrases(t, TEXTS[k]) for k in model.langs] for t in texts])).all()


def test_normal():
    assert L.normal("  ÉA, 12 b!\n") == "éa b".encode()
    assert L.normal("12 !") == b"" and L.normal(None) == b"" and L.normal("") == b""


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, fold(docs["doc_id"], 5) != 0)
    got = L.identify(docs, model, docs["doc_id"], "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where(fold(F.col("doc_id"), 5) == 0).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edge_rows(spark):
    rows = [(1, "der die das und ist nicht " * 20, "de", 1.0), (2, "the of and to is not " * 20, "en", 1.0), (3, None, "en", 1.0), (4, "", None, 1.0), (5, "123 ...", "xx", 1.0), (None, "the of and", None, 1.0), (7, "der die " * 40_000, "de", 1.0), (7, "der die " * 40_000, "de", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.fit(df, df["doc_id"].isNotNull())
    assert model.langs == ["de", "en"]
    got = L.identify(df, model, df["doc_id"], "doc_id").collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "en"), (1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (7, "de"), (7, "de")]
    kept = L.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == 5
    empty = df.limit(0)
    assert L.identify(empty, model, empty["doc_id"], "doc_id").count() == 0
    nothing = L.fit(empty, empty["doc_id"].isNotNull())
    assert {(r["lang_pred"], r["score"]) for r in L.identify(df, nothing, df["doc_id"], "doc_id").collect()} == {("und", 0.0)}


def test_und_without_a_letter(spark):
    model = L.Model(TEXTS)
    for text in ("½ ½", "²³", "①②", "ⅷ", "12 _ 3", "", None, "🙂"):
        assert model.predict([text])[0] == [L.UNKNOWN] and model.predict([text])[1][0] == 0
    assert model.predict(["ª x"])[0] != [L.UNKNOWN]


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGS", 3)
    rows = [(k, f"some text {k % 9} of this", f"l{min(k % 9, k % 5)}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    most = sorted({r[2] for r in rows}, key=lambda v: (-sum(r[2] == v for r in rows), v))[:3]
    assert L.fit(df, F.lit(True)).langs == sorted(most)


def test_a_label_without_letters_stays_in_the_executors(spark):
    """Its texts are all looked at, none is sent on; copies of one text fill no language twice."""
    rows = [(k, f"{k} 12 34 56 " * 20, "digits") for k in range(20_000)] + [(k, "the same words again", "copies") for k in range(20_000)] + [(k, f"word{chr(97 + k % 26)} other{chr(97 + k // 26 % 26)} text", "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shares = {"digits": 1.0, "copies": 1.0, "en": 1.0}
    texts = L._drawn(docs, shares, L.EACH)
    assert set(texts) == {"copies", "en"} and texts["copies"] == b" the same words again"
    want = b" ".join(sorted({L.normal(t) for _, t, k in rows if k == "en"}))
    assert set(texts["en"][: L.EACH - 20].split(b" ")[1:-1]) <= set(want.split(b" ")) and len(texts["en"]) == min(L.EACH, len(want) + 1)
    assert L.fit(docs, F.lit(True)).langs == ["copies", "en"]


def test_excerpts_do_not_depend_on_partitions(spark):
    rng = random.Random(7)
    rows = [(k, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)), rng.choice(["aa", "bb"])) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = (L._drawn(docs.repartition(n), {"aa": 1.0, "bb": 0.5}, 5000) for n in (1, 13))
    assert one == many and {len(v) for v in one.values()} == {5000}
