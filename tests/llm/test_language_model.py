import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_model as lm
from tessera.llm.registry import op13_language_model

DOCS = "doc_id long, text string, n_tokens int, word int"
ROWS = [(i, "The cat sat on the mat. A dog ran" if i % 2 else "der Hund lief und die Katze saß") for i in range(60)] + [(60, "unseen zzz zzz\x1cword  qqq\x0b\x0ctwo"), (61, None), (62, ""), (63, " \n"), (64, "É THE the"), (None, "the cat"), (60, "again the")]


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(rows, keep):
    counts = Counter()
    for i, t in rows:
        if keep(i):
            counts.update([*plain_words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*plain_words(t), None]
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return counts, out


def plain_score(model, counts, text):
    """One token after another in double precision, from the weights and all counts alone."""
    net, v = model.network, model.vocabulary
    s = net.state
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    frequent = v.words[: v.frequent]
    size, kinds = Counter(), Counter()
    group = lambda w: v.endings.index(w[-lm.ENDING :]) + 1 if w[-lm.ENDING :] in v.endings else 0
    for w, n in counts.items():
        if w is not None and w.encode() not in frequent:
            size[group(w.encode())] += n
            kinds[group(w.encode())] += 1
    h, total = np.zeros(s), 0.0
    for word in [*plain_words(text), None]:
        p = softmax(h @ net.C.astype(float) + net.c)
        if word is None:
            return (total + math.log(p[0])) / math.log(10)
        w = word.encode()
        if w in frequent:
            row = column = frequent.index(w)
            g = int(np.searchsorted(v.bounds, row, "right")) - 1
            low, high = v.bounds[g], v.bounds[g + 1]
            total += math.log(p[1 + g]) + math.log(softmax(net.W[low:high].astype(float) @ h + net.w[low:high])[row - low])
        else:
            g = group(w)
            column = v.frequent + g
            total += math.log(p[1 + v.heads + g]) + math.log((counts[word] + 0.1) / (size[g] + 0.1 * (kinds[g] + 1)))
        x, a = net.X[column].astype(float), h @ net.U.astype(float)
        z, r = sigmoid(x[:s] + a[:s]), sigmoid(x[s : 2 * s] + a[s : 2 * s])
        h = (1 - z) * h + z * np.tanh(x[2 * s :] + r * a[2 * s :])


@pytest.mark.parametrize("sizes", [{}, {"known": 6, "frequent": 4, "classes": 2, "endings": 2}, {"known": 3, "frequent": 0, "classes": 2, "endings": 1}])
def test_against_one_token_after_another(spark, sizes):
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in ROWS], DOCS)
    model, counts = lm.fit(docs, F.col("doc_id") % 10 != 0, **sizes)
    got = sorted((tuple(r) for r in lm.score(docs, model, counts).collect()), key=repr)
    plain_counts, base = plain_base(ROWS, lambda i: i is not None and i % 10)
    want = sorted(((*b, plain_score(model, plain_counts, t)) for b, (_, t) in zip(base, ROWS, strict=True)), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], abs=1e-9) and g[5] == pytest.approx(w[5], abs=1e-3)


def small(frequent=5, state=6):
    known = [f"w{i}".encode() for i in range(12)]
    counts = np.arange(12, 0, -1).astype(float) * 3
    ends = [(None, 81, 6), (b"w11", 3, 1)]
    v = lm.Vocabulary(known, counts, 20, 300, 13, frequent, 2, ends)
    net = lm.Network(v, state)
    rng = np.random.default_rng(2)
    for n in net.NAMES:
        setattr(net, n, (getattr(net, n) + rng.normal(0, 0.3, getattr(net, n).shape)).astype(np.float32))
    return v, net


def test_gradients_by_differences():
    v, net = small()
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    rng = np.random.default_rng(3)
    place, first, h = rng.integers(0, v.end + 1, (7, 3)), rng.random((7, 3)) < 0.3, rng.normal(0, 0.5, (3, net.state))

    def loss():
        at, total = h.copy(), 0.0
        for t in range(len(place)):
            at = at * ~first[t][:, None]
            total -= (net.logs(v, at, place[t]) - v.share[place[t]]).sum()
            at = net.step(at, net.X[v.column[place[t]]])[0]
        return total / place.size

    before = {n: getattr(net, n).copy() for n in net.NAMES}
    squares = {n: np.zeros_like(before[n]) for n in net.NAMES}
    found, _ = net.learn(v, place, first, h, squares, 0.0)
    assert found == pytest.approx(loss(), rel=1e-5)
    for n in net.NAMES:
        x = getattr(net, n)
        for at in [tuple(rng.integers(0, d) for d in x.shape) for _ in range(6)]:
            old = x[at]
            x[at] = old + 1e-4
            up = loss()
            x[at] = old - 1e-4
            down = loss()
            x[at] = old
            slope = (up - down) / 2e-4 * place.size / place.shape[1]
            assert math.sqrt(squares[n][at]) == pytest.approx(min(1, abs(slope)), abs=2e-3), (n, at)


def test_probabilities_sum_to_one():
    v, net = small()
    h = np.random.default_rng(4).normal(0, 1, (1, net.state)).astype(np.float32)
    p = [math.exp(net.logs(v, h, np.array([i]))[0]) for i in range(v.end + 1)]
    known, unknown, end = p[: len(v.words)], [x * lm.ADDED for x in p[len(v.words) : -1]], p[-1]
    assert sum(known) + sum(unknown) + end == pytest.approx(1, abs=1e-5)


def test_windows_and_lanes_change_nothing():
    v, net = small()
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(0, v.end, n), v.end) for n in [0, 1, 500, 3, 40, 40, 7] * 9]
    one = np.array([lm.scores(net, v, [t])[0] for t in texts])
    assert np.allclose(lm.scores(net, v, texts), one, atol=1e-3) and np.allclose(lm.scores(net, v, texts, window=1), one, atol=1e-3)
    assert sorted(i for x in lm.lanes_of(np.array([5, 1, 9, 1]), 3) for i in x) == [0, 1, 2, 3]


def test_the_state_learns_an_order(spark):
    """a b alternate: counts can't tell what comes next, the state can."""
    docs = spark.createDataFrame([(i, " ".join(["aa", "bb"] * 30), 1, 1) for i in range(400)] + [(1000 + i, " ".join(["cc", "dd"] * (20 + i % 9)), 1, 1) for i in range(400)], DOCS)
    texts = docs.withColumn("text", F.concat("text", F.lit(" x"), F.col("doc_id")))  # no copies
    model, counts = lm.fit(texts, F.lit(True))
    r = lm.score(texts, model, counts).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.5 * r["b"]


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "some words", 1, 1), (2, None, 1, 1)], DOCS)
    model, counts = lm.fit(empty, F.lit(True))
    assert lm.score(empty, model, counts).count() == 0
    rows = {r["doc_id"]: r for r in lm.score(some, model, counts).collect()}
    assert rows[1]["n_known"] == 0 and rows[1]["train_tokens"] == 0 and rows[1]["base_score"] == pytest.approx(0) and math.isfinite(rows[1]["score"])


def test_documents_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    _, want = plain_base([tuple(r) for r in rows], lambda i: zlib.crc32(str(i).encode()) % 10)
    got = {r["doc_id"]: r for r in op13_language_model(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, n, known, tokens, base in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, n, known, tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_heaviest_rows(spark):
    from tessera.llm.sampling import heaviest

    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 10 + [1000, 999, 7, 7])], "k long, n long")
    for most, want in ((0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (13, 4), (14, 14), (63, 14), (64, 64), (9999, 64)):
        assert heaviest(counts, "n", most).count() == want


def test_every_token_is_learned(spark, monkeypatch):
    """Texts beyond the sample of the starting weights, and all their tokens beyond its excerpts, change the network."""
    v, net = small()
    seen = []
    learn = lm.Network.learn
    monkeypatch.setattr(lm.Network, "learn", lambda self, v, place, *rest: (seen.append(place.T.ravel().tolist()), learn(self, v, place, *rest))[1])
    flat = np.concatenate([net.get(), np.full(net.get().size, 0.01)]).astype(np.float32)
    monkeypatch.setattr(lm, "STATE", 6)
    monkeypatch.setattr(lm.Network, "__init__", lambda self, v, state=6, init=lm.Network.__init__: init(self, v, state))
    texts = [b" ".join(b"w%d" % (i % 12) for i in range(n)) for n in (0, 1, 37, 2000, 5)]
    _, n = lm._trained(flat, v, texts, lanes=8)
    want = Counter(x for t in texts for x in [*map(v.places().__getitem__, lm.words(t)), v.end])
    assert n == sum(want.values()) and Counter(x for p in seen for x in p) == want
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, " ".join(["aa", "bb"] * 30) + f" x{i}", 1, 1) for i in range(400)], DOCS)
    model, counts = lm.fit(docs, F.lit(True), sample=0)
    r = lm.score(docs, model, counts).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.75 * r["b"]


def test_row_sums_and_reused_arrays():
    """Gradients of input rows are summed by row; arrays that are written on again are no part of a model that travels."""
    rng = np.random.default_rng(0)
    row, values = rng.integers(0, 9, 500) * 2, rng.normal(size=(500, 6)).astype(np.float32)
    want = np.zeros((20, 6))
    np.add.at(want, row, values)
    used, got = lm._row_sums(row, values, np.empty_like(values))
    assert used.tolist() == sorted(set(row.tolist())) and np.allclose(got, want[used], atol=1e-4)
    net = lm.Network(lm.Vocabulary([b"a", b"b"], np.array([3.0, 2.0]), 1, 6, 3, 2, 2, [(None, 0, 0)]))
    net.room("p", 100, 100)
    assert net.rooms and not pickle.loads(pickle.dumps(net)).rooms


def test_places_of_many_texts_at_once():
    """Words, places, and what is not in the tables are those of one text after another."""
    texts = [" zzz\x1cw0  QQQ\x0b\x0cw11\n", None, "", "É w3 É W3\tab \r\n", "   ", "x", "w1 w2 nosuchw11 w2 nosuchw11"]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(["before", *texts], kind).slice(1)
        got, sizes = lm.words_of(whole)
        want = [lm.words(t.encode() if t else None) for t in texts]
        assert got.to_pylist() == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
        v, _ = small()
        place, sizes, missed, at = v.finder()(whole)
        places = v.places()
        plain = [[*map(places.__getitem__, x), v.end] for x in want]
        assert place.tolist() == [i for x in plain for i in x] and sizes.tolist() == [len(x) for x in plain]
        assert missed.to_pylist() == places.missed and place[at].tolist() == [i for x in plain for i in x if len(v.words) <= i < v.end]
    assert [len(x) for x in lm._slices(pa.array(texts * 3))] == [21] and list(lm._slices(pa.array([], pa.string()))) == []
    assert lm.words_of(pa.array([], pa.string()))[0].to_pylist() == [] and lm.words_of(pa.array([" ", None]))[1].tolist() == [0, 0]


def test_slices_keep_all_texts(monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 2)
    texts = ["a" * n for n in (3, 3, 30, 0, 1, 8, 8, 2)] + [None]
    parts = [x.to_pylist() for x in lm._slices(pa.array(texts))]
    assert [t for p in parts for t in p] == texts and len(parts) > 3


def test_logits_far_apart():
    """Where no bound holds, each row's maximum is found; the results are the same."""
    v, net = small()
    h, place = np.random.default_rng(7).normal(0, 1, (40, net.state)).astype(np.float32), np.arange(40) % (v.end + 1)
    assert net.tables(v, np.abs(h).max(0))[2]
    near = net.logs(v, h, place)
    net.c += 500
    net.w += 300
    assert np.allclose(net.logs(v, h, place), near, atol=1e-3)
    net.C[:, 0] += 200
    assert not net.tables(v, np.abs(h).max(0))[2] and np.isfinite(net.logs(v, h, place)).all()
    x = h @ net.C.astype(float) + net.c
    x -= x.max(1, keepdims=True)
    want = (x - np.log(np.exp(x).sum(1, keepdims=True)))[place == v.end, 0]
    assert np.allclose(net.logs(v, h, place)[place == v.end], want, rtol=1e-4, atol=1e-3)


def test_sums_of_rows_that_occur_often():
    rng = np.random.default_rng(3)
    row, values = np.concatenate([np.full(90, 70_000), rng.integers(0, 40, 200), [5] * (lm.OFTEN + 1)]), rng.normal(size=(291 + lm.OFTEN, 4)).astype(np.float32)
    want = np.zeros((70_001, 4))
    np.add.at(want, row, values)
    used, got = lm._row_sums(row, values, np.empty_like(values))
    assert used.tolist() == sorted(set(row.tolist())) and np.allclose(got, want[used], atol=1e-4)


def test_words_travel_without_python_objects(monkeypatch):
    """A shard or a task makes no array of the best known words anew: op13's time for learning and scoring went beyond its limit."""
    v, _ = small()
    again = pickle.loads(pickle.dumps(v))
    assert again.words == v.words and not any(isinstance(x, list) and len(x) >= len(v.words) for x in again.__dict__.values())
    made, array = [], pa.array
    monkeypatch.setattr(lm.pa, "array", lambda x, *a, **k: (made.append(len(x)), array(x, *a, **k))[1])
    find = again.finder()
    assert made == [len(v.endings)]
    assert find(array(["w3 w0 zz"]))[0].tolist() == [3, 0, v.places()[b"zz"], v.end]


@pytest.mark.filterwarnings("error")
def test_gates_by_exponentials():
    """The gates' exponentials give the same states as hyperbolic tangents, and none too large for its type is a fault."""
    _, net = small()
    s, rng = net.state, np.random.default_rng(6)
    h, x = rng.uniform(-1, 1, (9, s)).astype(np.float32), rng.normal(0, 2, (9, 3 * s)).astype(np.float32)
    x[3], x[4], x[5] = 500, -500, 0
    sigmoid = lambda y: 0.5 + 0.5 * np.tanh(0.5 * y)
    a, y = h.astype(float) @ net.U, x.astype(float)
    z, r = sigmoid(y[:, :s] + a[:, :s]), sigmoid(y[:, s : 2 * s] + a[:, s : 2 * s])
    n = np.tanh(y[:, 2 * s :] + r * a[:, 2 * s :])
    a_room, n_room = np.empty((3 * s, 9), np.float32), np.empty((s, 9), np.float32)
    want = ((1 - z) * h + z * n, z, r, n, a[:, 2 * s :])
    for got in (net.step(h, x), [g.T for g in net.turned_step(h.T, x.T, net.to_gates(), a_room, n_room)]):
        for g, w in zip(got, want, strict=True):
            assert g.dtype == np.float32 and np.allclose(g, w, atol=2e-6)


def test_a_window_of_logits_far_apart(monkeypatch):
    """Learning takes each row's maximum where no bound holds, also where a window has no frequent word; the loss is that of the scores."""
    for far, tokens in ((False, 12), (True, 12), (True, 0)):
        v, net = small()
        if far:
            net.C[:, 0] += 30
            net.W[0] += 30
            net.w[3] += 20
            monkeypatch.setattr(lm, "SAFE", -1.0)
        rng = np.random.default_rng(9)
        place = rng.integers(v.frequent if not tokens else 0, v.end + 1, (7, 40))
        h, first = np.zeros((40, net.state), np.float32), rng.random((7, 40)) < 0.2
        at, want = h, 0.0
        for t in range(7):
            at = at * ~first[t][:, None]
            want -= (net.logs(v, at, place[t]) - v.share[place[t]]).sum()
            at = net.step(at, net.X[v.column[place[t]]])[0]
        got, end = net.learn(v, place, first, h, {n: np.full(getattr(net, n).shape, 0.01, np.float32) for n in net.NAMES}, 0.1)
        assert got == pytest.approx(want / place.size, rel=1e-3) and np.allclose(end, at, atol=1e-5)
        assert all(np.isfinite(getattr(net, n)).all() for n in net.NAMES)
