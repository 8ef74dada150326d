import multiprocessing
import os
import threading
import time

import pytest

from tessera.sources import calls, external, manifest


def slow(seconds):
    def make():
        def ask(x):
            time.sleep(seconds)
            return f"{x}!"

        return ask

    return make


def quiet():
    return [t for t in threading.enumerate() if t is not threading.main_thread() and t.name.startswith("ThreadPool")], multiprocessing.active_children()


@pytest.mark.parametrize("timeout", [None, 30])
def test_a_thousand_answers_by_twenty(timeout):
    began = time.perf_counter()
    got = list(calls.answers(slow(0.05), range(1000), 20, timeout))
    took = time.perf_counter() - began
    assert got == [(f"{i}!", False) for i in range(1000)]
    assert took < 50 / 20 * 2.5
    assert quiet() == ([], [])


def test_late_calls_are_ended_in_order():
    def make():
        def ask(x):
            time.sleep(60 if x % 7 == 3 else 0.01)
            return x, os.getpid()

        return ask

    began = time.perf_counter()
    got = list(calls.answers(make, range(21), 5, 0.4))
    assert time.perf_counter() - began < 15
    assert [late for _, late in got] == [i % 7 == 3 for i in range(21)]
    assert [a[0] for a, late in got if not late] == [i for i in range(21) if i % 7 != 3]
    assert os.getpid() not in {a[1] for a, late in got if not late} and quiet() == ([], [])


@pytest.mark.parametrize("timeout", [None, 20])
def test_input_is_taken_as_answers_go_out(timeout):
    taken = []
    found = calls.answers(slow(0.0), (taken.append(i) or i for i in range(1000)), 4, timeout)
    for n in range(1, 50):
        next(found)
        assert len(taken) <= n + 2 * 4 + 1
    found.close()
    assert quiet() == ([], [])


@pytest.mark.parametrize("timeout", [None, 20])
def test_errors_come_after_the_answers_before_them(timeout):
    def make():
        def ask(x):
            if x == 5:
                raise ValueError("no five")
            if x == 8 and timeout:
                os._exit(1)
            return x

        return ask

    found, seen = calls.answers(make, range(100), 3, timeout), []
    with pytest.raises((ValueError, RuntimeError), match="no five"):
        for a, _ in found:
            seen.append(a)
    assert seen == [0, 1, 2, 3, 4] and quiet() == ([], [])


def test_a_process_that_ends_is_an_error():
    def make():
        return lambda x: os._exit(3) if x == 2 else x

    with pytest.raises(RuntimeError, match="ended"):
        list(calls.answers(make, range(5), 2, 10))


def test_answers_of_a_table(spark):
    df = spark.range(400).selectExpr("CAST(id AS STRING) AS request").coalesce(1)
    began = time.perf_counter()
    got = external.with_answers(df, slow(0.05), in_flight=20).collect()
    assert time.perf_counter() - began < 12 and [r["response"] for r in got] == [f"{i}!" for i in range(400)]
    assert external.with_answers(df.limit(0), slow(0), timeout=1).collect() == []


def test_renders_in_flight(spark):
    df = spark.createDataFrame([("import time; time.sleep(1); open('a.png', 'wb').write(b'%d')" % i,) for i in range(8)] + [(" ",)], "code string").coalesce(1)
    got = external.with_renders(df, in_flight=8).collect()
    assert sorted(bytes(r["artifact"] or b"") for r in got) == [b"", *[b"%d" % i for i in range(8)]]


def lines(spark, path):
    return sorted((r["job"], r["value"]) for r in manifest.read_once(spark, path).collect())


def test_a_job_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    rows = spark.range(100).selectExpr("concat('é line ', id) AS value").repartition(5)
    for _ in range(2):
        manifest.append_once(rows, path, "first")
    manifest.append_once(rows.limit(3), path, "second")
    got = lines(spark, path)
    assert len(got) == 103 and sorted({v for j, v in got if j == "first"}) == sorted(r["value"] for r in rows.collect())


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    manifest.append_once(spark.createDataFrame([("kept",)], "value string"), path, "good")
    bad = spark.range(50).repartition(4).selectExpr("CASE WHEN id = 49 THEN raise_error('no') ELSE CAST(id AS STRING) END AS value")
    with pytest.raises(Exception, match="no"):
        manifest.append_once(bad, path, "bad")
    assert lines(spark, path) == [("good", "kept")]
    manifest.append_once(spark.createDataFrame([("again",)], "value string"), path, "bad")
    assert lines(spark, path) == [("bad", "again"), ("good", "kept")]


def test_a_repeated_task_counts_once(spark, tmp_path):
    path = str(tmp_path / "m")
    writer = manifest.Writer(path, "job")
    first, second = writer.write(iter([("a",), ("b",)])), writer.write(iter([("a",), ("b",)]))  # an attempt that was lost, and its repetition
    assert first.name != second.name
    writer.commit([second, None])
    assert lines(spark, path) == [("job", "a"), ("job", "b")]
    writer.commit([writer.write(iter([("c",)]))])
    assert lines(spark, path) == [("job", "a"), ("job", "b")]
    writer.abort([first])
    assert len([f for f in os.listdir(path) if f.endswith(".lines")]) == 1


def test_one_column_only(spark, tmp_path):
    with pytest.raises(Exception, match="one column"):
        manifest.append_once(spark.range(2).selectExpr("'a' AS value", "id"), str(tmp_path / "m"))


def test_files_that_are_there(spark, tmp_path):
    from tessera.sources import store

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "one.mp4").write_bytes(b"xyz")
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "two words é.mp4").write_bytes(b"x")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        files = store.files_in(spark, folder)
        assert {(r["name"], r["size"]) for r in files.collect()} == {("a/b/one.mp4", 3), ("two words é.mp4", 1)}
        rows = spark.createDataFrame([(i, n, 0.5, 2) for i, n in enumerate(["a/b/one.mp4", "empty.mp4", "missing.mp4", None, "two words é.mp4", "a/b/one.mp4"])], "id int, video string, score double, other int")
        got = store.only_with_files(rows, files, "video", "score")
        assert got.columns == rows.columns
        assert {r["id"]: (r["score"], r["other"]) for r in got.collect()} == {0: (0.5, 2), 1: (0.0, 2), 2: (0.0, 2), 3: (0.0, 2), 4: (0.5, 2), 5: (0.5, 2)}
