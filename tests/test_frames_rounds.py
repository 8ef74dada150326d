"""Similarity matrices a pair of films at a time, frames one after the other, attempts as a state machine over a stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import sequence
from tessera.operators import frames
from tessera.plans.catalog import QUERIES
from tessera.sources import external
from tessera.streaming import rates, rounds

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held,passing", [(1 << 26, 1 << 25), (300, 1 << 14)])
def test_matrix_of_films(spark, monkeypatch, held, passing):
    """Films of several sizes and lengths, also where a film is cut into parts and its other's frames go by in runs."""
    from tests.test_similarity import plain_ssim

    monkeypatch.setattr(frames, "HELD", held)
    monkeypatch.setattr(frames, "PASSING", passing)
    rng = np.random.default_rng(3)
    film = lambda n, shape: [rng.integers(0, 256, shape).astype(np.uint8) for _ in range(n)]
    pairs = {"p": (film(7, (9, 8)), film(5, (9, 8))), "q": (film(3, (8, 8)), film(4, (16, 12))), "r": (film(1, (7, 7)), film(1, (7, 7))), "s": (film(2, (8, 8)), []), "t": ([], film(2, (8, 8))), "u": (film(1, (3, 3)), film(1, (3, 3)))}
    rows = [(p, side, k * 2, f.shape[1], f.tobytes()) for p, both in pairs.items() for side, some in enumerate(both) for k, f in enumerate(some)] + [(None, 0, 0, 8, b"x" * 64), ("p", 0, 99, 8, None), ("p", 1, 99, 8, b"")]
    df = spark.createDataFrame(rows, "pair_id string, side int, k int, width int, gray binary")
    got = {(r["pair_id"], r["i"], r["j"]): r["ssim"] for r in frames.matrix(df).collect()}
    want = {}
    for p, (a, b) in pairs.items():
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                want[p, 2 * i, 2 * j] = plain_ssim(x, y if x.shape == y.shape else np.rint(sequence.resize_area(y, *x.shape))) if min(x.shape) >= 7 else float("nan")
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.isclose(got[k], v, rtol=1e-9, equal_nan=True), k
    plain = {(r["pair_id"], r["i"], r["j"]): r["ssim"] for r in frames.matrix(df, resize=False).collect()}
    assert all(np.isnan(v) == (k[0] in "qu") for k, v in plain.items())
    assert frames.matrix(df.limit(0)).count() == 0


def test_a_frame_is_shuffled_once_for_each_pair(spark):
    rows = [("p", s, k, 8, bytes(64)) for s in (0, 1) for k in range(10)]
    df = spark.createDataFrame(rows, "pair_id string, side int, k int, width int, gray binary")
    out = frames.matrix(df)
    assert out.count() == 100
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1


def test_frames_one_after_the_other(spark, monkeypatch):
    """A decoder that gives its frames one after the other is read no further than what is handed on."""
    monkeypatch.setattr(external, "RUN", 4)
    alive, most = [0], [0]

    def decode(data):
        def shots():
            for k in range(data[0]):
                alive[0] += 1
                most[0] = max(most[0], alive[0])
                yield np.full((1, 2), k, np.uint8)

        return shots(), 10.0

    for run in external.runs_of(external.sampled(bytes([100]), decode, "x", 5)):
        assert sum(f.size for _, f in run) <= 4
        alive[0] = 0
    assert most[0] <= 8
    df = spark.createDataFrame([("a", bytes([9])), ("b", bytes([1]))], "path string, content binary")
    assert [(r["path"], r["frame_idx"]) for r in external.frame_rows(df, decode).orderBy("path", "frame_idx").collect()] == [("a", k) for k in (0, 2, 4, 6, 8)] + [("b", 0)]
    for data, why in (([0], "no frames in c"), ([], "could not load c")):
        with pytest.raises(Exception, match=why):
            external.frame_rows(spark.createDataFrame([("c", bytes(data))], "path string, content binary"), decode).collect()


def stored(spark, tmp_path, parts):
    """Files of attempts, one after the other."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "user string, n long, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_attempts_over_a_stream(spark, tmp_path):
    """Files out of order, a restart between them, an attempt that is too late, ties, keys without a success and rows that are none."""
    import datetime as dt

    at = lambda hour: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=hour)
    schema = "user string, n long, ts timestamp, ok boolean"
    run = lambda: rounds.run_appended(
        rounds.attempts(rates.event_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema), "user", "n", "ts", "ok", "5 hours"), str(tmp_path / "out"), str(tmp_path / "offsets")
    )
    with rounds.state_store(spark):
        stored(spark, tmp_path, [[("a", 3, at(3), False), ("a", 4, at(4), True), ("b", 1, at(1), None)], [("a", 1, at(1), False), ("b", 2, at(1), False), (None, 9, at(2), True), ("a", 9, None, True)]])
        early = {(r["user"], r["n"]) for r in run().collect()}
        assert early == set()  # nothing is sure yet
        stored(spark, tmp_path, [[("a", 2, at(2), False), ("c", 1, at(20), False), ("b", 4, at(26), True)], [("d", 1, at(21), False), ("c", 2, at(18), False), ("b", 3, at(25), True)], [("a", 5, at(26), True), ("c", 0, at(1), True)], [("", 0, dt.datetime(9999, 6, 1, tzinfo=dt.UTC), None)]])
        got = sorted(tuple(r) for r in run().collect())
    assert got == [("a", 1, 0, False), ("a", 2, 1, False), ("a", 3, 2, False), ("a", 4, 3, True), ("b", 1, 0, False), ("b", 2, 1, False), ("b", 3, 2, True), ("c", 1, 1, False), ("c", 2, 0, False), ("d", 1, 0, False)]


def test_the_stream_is_the_table(spark):
    want, got = (sorted(tuple(r[c] for c in ("user_id", "event_id", "round", "ok")) for r in QUERIES[q](spark, "/root/testdata/sf0.01").collect()) for q in ("feedback_rounds", "feedback_stream"))
    assert got == want and len(got) > 10


def test_numbers_of_many_keys_at_once():
    """Attempts of a group of keys, in two parts, against one key after the other."""
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"key": [f"u{i}" for i in rng.integers(0, 30, 400)], "us": rng.integers(0, 50, 400), "id": rng.integers(0, 9, 400), "ok": rng.random(400) < 0.08})
    told = rows[:0].assign(round=0, done=False)[["key", "round", "done"]]
    got = []
    for part in (rows[rows["us"] <= 20], rows[rows["us"] > 20], rows[:0]):
        out, told = rounds.numbered(part[~part["key"].isin(told["key"][told["done"]])], told)
        got += out[["key", "us", "id", "ok", "round"]].itertuples(index=False, name=None)
    want = []
    for key in sorted(set(rows["key"])):
        for n, (us, i, ok) in enumerate(sorted(rows[rows["key"] == key][["us", "id", "ok"]].itertuples(index=False, name=None))):
            want.append((key, us, i, ok, n))
            if ok:
                break
    assert sorted(got) == sorted(want) and told["key"].is_unique and told["done"].sum() == sum(w[3] for w in want)
    assert rounds._unpacked(rounds._packed(rows[:3])).equals(rows[:3])


def test_a_few_calls_of_state_for_many_keys(spark, tmp_path):
    """The keys of a stream share groups of state: what a batch asks of the state does not grow with the keys."""
    spark.range(6000).select(F.col("id").alias("user"), F.col("id").alias("n"), F.timestamp_seconds("id").alias("ts"), F.lit(False).alias("ok")).write.parquet(str(tmp_path / "in"))
    stream = rates.event_stream(spark, str(tmp_path / "in"), "*.parquet", "user long, n long, ts timestamp, ok boolean", 99)
    with rounds.state_store(spark):
        query = rounds.attempts(stream, "user", "n", "ts", "ok", "1 hour").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert 0 < max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 6000
