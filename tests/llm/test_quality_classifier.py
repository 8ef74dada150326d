import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality_classifier as C
from tessera.llm.sampling import fold


def test_risk_never_goes_below_zero():
    zp, zu = np.array([5.0, 6.0]), np.array([-5.0, -6.0])
    value, above = C.risk(zp, zu, 0.5)
    assert not above and value >= 0 and C.risk(np.zeros(3), np.zeros(3), 0.4)[1]


def test_learns_without_negatives():
    rng = np.random.default_rng(2)
    good, bad = (rng.normal(m, 1, (n, C.WIDTH)).astype(np.float32) for m, n in ((1.0, 900), (-1.0, 300)))
    model = C.learn(good[:400], np.concatenate([good[400:], bad]), 500 / 800)
    assert (model.scores(good) > 0.5).mean() > 0.95 and (model.scores(bad) < 0.5).mean() > 0.95
    # The ratio takes the most a classifier gives for certain, so well separated classes give the share itself.
    assert 0.3 < C.elkan_noto(good[:400], np.concatenate([good[400:], bad])) < 0.95


def test_weights_are_those_of_a_plain_optimiser():
    """The same risk, minimised by small plain gradient steps with derivatives taken numerically."""
    rng = np.random.default_rng(8)
    p, u = rng.normal(1, 1, (200, 3)), np.concatenate([rng.normal(1, 1, (150, 3)), rng.normal(-1, 1, (150, 3))])
    prior, ridge = 0.5, 1e-3
    centre, scale = u.mean(0), u.std(0) + 1e-2
    xp, xu = (np.clip((x - centre) / scale, -8, 8) for x in (p, u))
    value = lambda w: C.risk(xp @ w[:3] + w[3], xu @ w[:3] + w[3], prior)[0] + ridge / 2 * float(w[:3] @ w[:3])
    w, step = np.zeros(4), 1e-5
    for _ in range(3000):
        w = w - 0.5 * np.array([(value(w + step * e) - value(w - step * e)) / (2 * step) for e in np.eye(4)])
    model = C._descend(p, u, prior)
    got = np.append(model.weights, model.bias)
    assert value(got) <= value(w) + 0.01
    assert np.mean((xu @ got[:3] + got[3] > 0) == (xu @ w[:3] + w[3] > 0)) > 0.97


def test_scores_are_the_models_row_by_row(spark):
    """The query against features and a logistic written out for one row at a time."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = C.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: r["score"] for r in C.score(docs, model).collect()}
    for r in docs.collect():
        x = (C.features((r["text"] or "").encode()) - model.centre) / model.scale
        z = sum(w * min(8, max(-8, v)) for w, v in zip(model.weights.tolist(), x.tolist(), strict=True)) + model.bias
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-min(40, max(-40, z))))) < 1e-9


def test_conflicting_labels_are_not_trusted(spark):
    df = spark.createDataFrame([(k, f"Calm words number {k} in a row. " * 3) for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(8)] + [(3, 0)], "doc_id long, quality int")
    from tessera.llm.sampling import label_sample

    assert sorted(r["doc_id"] for r in label_sample(labels, "quality", 100, only=1).collect()) == [0, 1, 2, 4, 5, 6, 7]
    a, b = (C.fit(df.repartition(n), labels, F.lit(True)) for n in (1, 5))
    assert np.array_equal(a.weights, b.weights)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = C.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    held = docs.join(labels.where(fold(F.col("doc_id"), 5) == 0), "doc_id").select("doc_id", "text", "quality")
    got = {r["doc_id"]: r["score"] for r in C.score(held, model).collect()}
    hit = np.mean([(got[r["doc_id"]] >= 0.3) == (r["quality"] == 1) for r in held.collect()])
    assert hit > 0.97


def test_edge_rows(spark):
    good, bad = "Calm words in a row, and then some more. ", "BUY!! NOW### |$| "
    rows = [(k, (good if k % 3 else bad) * 5, 1) for k in range(60)] + [(100, None, 1), (101, "", 1), (None, good, 1), (102, good * 50_000, 1), (102, good * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(None, 1), (101, None), (7000, 1)], "doc_id long, quality int")
    model = C.fit(df, labels, F.col("doc_id").isNotNull())
    got = C.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[100] == by[101] and by[1] > by[0]
    assert C.score(df.limit(0), model).count() == 0
    none = C.fit(df, labels.limit(0), F.col("doc_id").isNotNull())
    assert len({r["score"] for r in C.score(df, none).collect()}) == 1
