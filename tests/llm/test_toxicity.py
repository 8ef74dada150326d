import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T
from tessera.llm.language_id import normal
from tessera.llm.sampling import fold


def examples(n=300):
    rng = random.Random(4)
    plain, bad = [f"word{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)], ["grumble", "snarl", "grumbling", "snarlish"]
    out = []
    for k in range(n):
        y = rng.random() < 0.3
        words = rng.choices(plain, k=30) + (rng.choices(bad, k=rng.randrange(1, 4)) if y else [])
        rng.shuffle(words)
        out.append((k, " ".join(words), int(y)))
    return out


def cosines(rows, text):
    """Cosines of a text with all examples over the whole vocabulary, term by term."""
    words = lambda t: [w for w in normal(t).decode().split(" ") if w]
    bags = {k: Counter(words(t)) for k, t, _ in rows}
    n = len(rows)
    once = [rows[e] for e in T.distinct([T.marks_of(t) for _, t, _ in sorted(rows)])]
    rate = sum(y for _, _, y in once) / len(once)

    def worth(w):
        df = sum(w in b for b in bags.values())
        seen, a = sum(w in bags[k] for k, _, _ in once), sum(y for k, _, y in once if w in bags[k])
        surplus = (a - seen * rate) / math.sqrt(max(1e-9, seen * rate * (1 - rate)))
        return math.log(1 + n / df) * (T.FLOOR + (1 - T.FLOOR) * min(1, max(0, (surplus - T.LOW) / (T.HIGH - T.LOW))))

    known = {w: worth(w) for b in bags.values() for w in b}

    def unit(bag):
        raw = {w: (1 + math.log(c)) * known[w] for w, c in bag.items() if w in known}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    q = unit(Counter(words(text)))
    return {k: sum(x * q.get(w, 0) for w, x in unit(b).items()) for k, b in bags.items()}


def test_nearest_is_exact(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "FIRST", 4)
    monkeypatch.setattr(T, "COMMON", 3)
    rows = examples()
    index = T.Index(rows)
    assert index.blocks > 2 * T.FIRST and 0 < (index.common >= 0).sum() < len(index.terms) and len(index.terms) == len({w for _, t, _ in rows for w in t.split()})
    for _, text, _ in [*rows[:25], (0, "snarl worda unheard", 0), (0, "wordaa snarl snarl", 0)]:
        near = cosines(rows, text)
        want = sorted((-round(s, 9), k) for k, s in near.items() if s > 0)[: T.NEIGHBOURS]
        got = [(-round(s, 9), index.ids[e]) for s, e in index.nearest(index.vector(text))]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-9)
        cut = want[-1][0] - 1e-8
        assert {k for s, k in got if s < cut} == {k for s, k in want if s < cut}


def test_most_blocks_are_skipped():
    rows = [(k, " ".join(f"topic{chr(97 + k // 64 // 8)}{chr(97 + k // 64 % 8)}x{chr(97 + i)}" for i in range(8)) + " shared words" * (k % 3), k % 2) for k in range(64 * 60)]
    index, read = T.Index(rows), []
    whole = index._read
    index._read = lambda got, term, weight, blocks: read.append(index.blocks if blocks is None else blocks.sum()) or whole(got, term, weight, blocks)
    assert (index.common >= 0).sum() == 2
    assert len(index.nearest(index.vector(rows[701][1]))) == T.NEIGHBOURS and sum(read) <= 2 * T.FIRST


def test_curve_rises_and_is_calibrated():
    votes = np.linspace(0, 1, 2001)
    marks = (np.random.default_rng(3).random(2001) < votes**2).astype(float)
    x, y = T.isotonic(votes, marks)
    assert (np.diff(y) >= 0).all() and abs(np.interp(votes, x, y) - votes**2).mean() < 0.05
    assert np.interp(0.25, *T.isotonic(votes, marks * 0)) == 0.25


def test_scores_separate():
    index = T.Index(examples()).calibrate()
    high, near = index.score("calm words and GRUMBLE, snarl grumble wordaa")
    assert high >= 0.7 and near
    assert index.score("wordaa wordbb wordcc wordaa")[0] < 0.3
    assert index.score("")[0] == index.score(None)[0] == index.score("calm")[0] < 0.5


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    index = T.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    held = docs.join(labels.where(fold(F.col("doc_id"), 3) == 1), "doc_id").select("doc_id", "text", "toxic")
    got = {r["doc_id"]: r["score"] for r in T.score(held, index).collect()}
    y = {r["doc_id"]: r["toxic"] for r in held.collect()}
    hit = np.array([(got[k] >= 0.7, v == 1) for k, v in y.items()])
    assert (hit[:, 0] & hit[:, 1]).sum() / hit[:, 1].sum() > 0.88
    assert (hit[:, 0] & ~hit[:, 1]).sum() / (~hit[:, 1]).sum() <= 0.005


def test_edge_rows(spark):
    rows = [(k, t, "x") for k, t, _ in examples(60)] + [(None, "grumble", "x"), (900, None, "x"), (901, "", "x"), (902, "snarl " * 100_000, "x"), (902, "snarl " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in examples(60)] + [(1, None), (None, 1), (900, 1), (5000, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    index = T.fit(df, labels)
    got = T.score(df, index).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1
    assert T.score(df.limit(0), index).count() == 0
    none = T.fit(df, labels.limit(0))
    assert {r["score"] for r in T.score(df, none).collect()} == {0.5}
