import json
import math
import string
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import loop
from tessera.plans.catalog import QUERIES
from tessera.plans.similarity import _mock_generate, _mock_render
from tessera.sources import external, store
from tessera.streaming import rates


def test_answers_and_time_outs(spark):
    def make():
        def ask(text):
            if text == "slow":
                time.sleep(2)
            return text.upper()

        return ask

    df = spark.createDataFrame([("a",), ("slow",), ("b",)], "request string").coalesce(1)
    got = {r["request"]: (r["response"], r["timed_out"]) for r in external.with_answers(df, make, timeout=0.3).collect()}
    assert got == {"a": ("A", False), "slow": (external.TIMED_OUT, True), "b": ("B", False)}


def test_chat_endpoint():
    def post(url, json, timeout):
        text = json["messages"][0]["content"]
        if text == "late":
            raise TimeoutError
        if text == "down":
            raise ConnectionError("refused")
        return {"choices": [{"message": {"content": text or None}}]} if text != "none" else {"choices": []}

    ask = external.chat_endpoint("http://host/v1/", "m", post)()
    assert (ask("hi"), ask("late"), ask("")) == ("hi", "", "")
    for bad in ("down", "none"):
        with pytest.raises(RuntimeError):
            ask(bad)


def test_scripts():
    made = external.run_script("open('a.png', 'wb').write(b'x')\nopen('b.mp4', 'wb').write(b'video')\nprint('out')")
    assert made == (b"video", True, "out\n", "")
    data, ok, _, errors = external.run_script("raise ValueError('no')")
    assert data is None and not ok and "ValueError: no" in errors
    assert external.run_script("import time; time.sleep(5)", timeout=0.5)[3].startswith("The render took")
    assert external.run_script("pass", [sys.executable, "-I"])[1] is False


def test_frames(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 3 2 255 " + bytes(range(6)))
    (tmp_path / "b.ppm").write_bytes(b"P6 1 1 255 " + bytes([100, 200, 50]))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in external.frames(spark, str(tmp_path)).collect()}
    assert rows["a.pgm"]["gray"] == list(range(6)) and (rows["a.pgm"]["height"], rows["a.pgm"]["width"]) == (2, 3)
    assert rows["b.ppm"]["gray"] == [round(0.299 * 100 + 0.587 * 200 + 0.114 * 50)]

    def video(data):
        import numpy as np

        return [np.full((1, 1), i, np.uint8) for i in range(30)], 12.0

    assert [r["frame_idx"] for r in external.frames(spark, str(tmp_path / "a.pgm"), video).collect()] == list(range(0, 30, 2))
    (tmp_path / "c.pgm").write_bytes(b"junk of some kind here")
    with pytest.raises(Exception, match="could not load"):
        external.frames(spark, str(tmp_path / "c.pgm")).collect()


def test_reflection(spark):
    sig, doc = external.described(string, "capwords")
    assert sig.startswith("(s, sep=None") and "Split the argument" in doc
    assert external.described(string, "digits")[0] == ": str"
    assert external.described(string, "Template.gone") == ("()", "Nothing is documented under Template.gone.")

    class Camera:
        """A camera."""

        zoom = 2

    class Scene:
        @property
        def camera(self) -> Camera:
            return Camera()

    package = type("P", (), {"Scene": Scene})
    assert external.described(package, "Scene.camera.zoom")[0] == ": int"
    assert external.api_docs(spark, string, ["digits", "digits", "x"]).count() == 2


def filtered_png(rgb, how):
    """A PNG written with one of its five line filters, byte by byte as the format says."""
    import struct
    import zlib

    height, width, samples = rgb.shape
    raw, above = b"", [0] * (width * samples)
    for line in rgb.reshape(height, -1).tolist():
        raw += bytes([how])
        for i, v in enumerate(line):
            a, b, c = (line[i - samples] if i >= samples else 0), above[i], (above[i - samples] if i >= samples else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw += bytes([(v - (0, a, b, (a + b) // 2, paeth)[how]) % 256])
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(raw)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"a") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_images(how, samples):
    import numpy as np

    rgb = np.random.default_rng(how).integers(0, 256, (5, 7, samples)).astype(np.uint8)
    want = np.rint(rgb[:, :, :3] @ np.array([0.299, 0.587, 0.114])) if samples > 2 else rgb[:, :, 0]
    frames, rate = external.decode_image(filtered_png(rgb, how))
    assert rate == 0 and len(frames) == 1 and (frames[0] == want).all()
    assert (external.decode_png(external.encode_png(rgb[:, :, 0]))[0][0] == rgb[:, :, 0]).all()


def test_media_that_cannot_be_read(spark, tmp_path):
    import numpy as np

    shots = [np.full((2, 2), i, np.uint8) for i in range(10)]
    external.write_files(spark, str(tmp_path), [("a.frames", external.encode_frames(shots, 10.0))])
    assert [r["frame_idx"] for r in external.frames(spark, str(tmp_path / "a.frames"), external.decode_frames).collect()] == [0, 2, 4, 6, 8]
    for name, data, decode, said in (
        ("b.frames", b"other", external.decode_frames, "can't be opened"),
        ("c.frames", external.encode_frames(shots, 0.0), external.decode_frames, "no frame rate"),
        ("d.frames", external.encode_frames([], 5.0), external.decode_frames, "no frames in"),
        ("e.png", b"\x89PNG\r\n\x1a\n", external.decode_image, "could not load"),
        ("f.any", b"x", lambda data: (shots, 0.0), "no frame rate in"),
    ):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=said):
            external.frames(spark, str(tmp_path / name), decode).collect()


def test_a_planner_or_a_plan(spark):
    df = spark.createDataFrame([(1, "scene"), (2, None)], "id long, reviewed_description string")
    said = lambda t: t.withColumn("response", F.when(F.col("id") == 1, "<PLAN>a</PLAN><PLAN>b</PLAN>").otherwise("none"))
    assert {r["id"]: r["code_plan"] for r in loop.planned(df, said).collect()} == {1: "b", 2: ""}
    assert {r["code_plan"] for r in loop.planned(df).collect()} == {None}
    with pytest.raises(ValueError, match="need no planner"):
        loop.planned(df.withColumn("code_plan", F.lit("x")), said)


def test_a_success_that_is_null_is_none(spark):
    df = spark.createDataFrame([(i, f"scene {i}") for i in range(3)], "id long, reviewed_description string")
    out = loop.run_rounds(df, _mock_generate, lambda t: t.withColumns({"success": F.when(F.col("id") > 0, F.col("id") == 1), "errors": F.lit("no")}), 2).collect()
    assert sorted((r["id"], r["success"], r["round"]) for r in out) == [(0, False, 2), (1, True, 0), (2, False, 2)]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        return type("Option", (), {"isDefined": staticmethod(lambda: False)})

                return Inner

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_path(type("Session", (), {"sparkContext": Context()})(), "x")


def test_small_tables_of_few_files_are_dealt_out(spark, tmp_path, monkeypatch):
    df = spark.range(1000).coalesce(1)
    df.write.parquet(str(tmp_path / "one"))
    df.repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    parts = lambda f: store.dealt(spark.read.parquet(str(tmp_path / f))).select(F.spark_partition_id()).distinct().count()
    assert parts("one") == spark.sparkContext.defaultParallelism and "Exchange" not in store.dealt(spark.read.parquet(str(tmp_path / "many")))._jdf.queryExecution().toString()
    monkeypatch.setattr(store, "SMALL", 10)
    assert parts("one") == 1


def test_summary_on_the_console(spark, capsys):
    store.show_summary(spark.createDataFrame([(0.5, 2)], "visual_similarity double, n long"))
    shown = capsys.readouterr().out
    assert "visual_similarity" in shown and "0.5" in shown


def test_chat_requests(spark):
    from tessera.functions import messages, text

    row = spark.createDataFrame([("hi",)], "t string").select(text.chat_request("m", messages.prompt(F.lit("s"), F.col("t"), True)).alias("r")).first()
    assert json.loads(row["r"]) == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}], "temperature": 0.0}


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "m")
    store.append_manifest(spark, path, "a", "b")
    store.append_manifest(spark, path, rows=spark.createDataFrame([("c",), ("d",)], "value string"))
    store.append_manifest(spark, None, "x", rows=spark.createDataFrame([("y",)], "value string"))
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["a", "b", "c", "d"]


def test_loop(spark):
    df = spark.createDataFrame([(i, f"scene {i}") for i in range(40)], "id long, reviewed_description string")
    out = {r["id"]: r for r in loop.run_rounds(df, _mock_generate, _mock_render, 3).collect()}
    assert len(out) == 40 and {r["round"] for r in out.values()} > {0, 1}
    assert all(r["success"] or r["round"] == 3 for r in out.values())
    assert all(r["template"] == ("code" if r["round"] == 0 else "feedback") for r in out.values())  # without notes
    forced = loop.run_rounds(df, _mock_generate, _mock_render, 2, notes=lambda t: t.withColumn("api_info", F.lit("n")), force_all=True).collect()
    assert {(r["round"], r["template"]) for r in forced} == {(2, "docs_feedback")} and len(forced) == 40
    with pytest.raises(ValueError):
        loop.run_rounds(df, _mock_generate, _mock_render, 11)
    planned = df.withColumn("code_plan", F.lit("1. go"))
    assert loop.run_rounds(planned, _mock_generate, _mock_render, 0).first()["template"] == "code_with_plan"


def test_csv_keeps_texts(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nover lines'), (2, ""), (3, "é|\\x")]
    df = spark.createDataFrame(rows, "k long, t string")
    back = store.read_csv(spark, store.write_csv(df, str(tmp_path / "c"), ["k"]), "row_idx long, k long, t string").orderBy("k").collect()
    assert [(r["row_idx"], r["k"], r["t"] or "") for r in back] == [(i, *r) for i, r in enumerate(rows)]


def test_windows_of_a_stream(spark, tmp_path):
    events = [(1, "2024-01-01 00:10:00", True), (2, "2024-01-01 00:50:00", False), (3, "2024-01-01 02:00:00", True)]
    df = spark.createDataFrame(events, "id long, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    # Files come in any order: none of their events may be too late.
    stream = rates.success_rate(rates.event_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema), F.col("ok"), lateness="3 hours")
    got = rates.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).orderBy("window_start").collect()
    want = rates.success_rate(df, F.col("ok")).orderBy("window_start").collect()
    assert got == want and [(r["n"], r["ok"], r["rate"]) for r in got] == [(2, 1, 0.5), (1, 1, 1.0)]
    assert math.isclose(json.loads("1.0"), got[1]["rate"])


def test_evaluation(spark):
    from tessera.operators import evaluate
    from tessera.operators.rewards import summary
    from tessera.plans.similarity import _show

    rows = [(1, "Line(1)", "<code>Line(1)</code>"), (2, "Line(1)", "think</think><code> </code>"), (3, "Line(1)", "<code>x = (</code>"), (4, "x = (", "<code>Line(1)</code>")]
    df = spark.createDataFrame([(k, f"t{k}", e, None) for k, e, _ in rows], "id long, text_script string, expected_code string, code_plan string")
    said = spark.createDataFrame([(k, r) for k, _, r in rows], "id long, response string")
    seen = []

    def render(t):
        seen.append(t.count())
        return _show(t)

    stages = (lambda t: t.join(said, "id"), render, lambda t: t.withColumn("codebert_similarity", F.lit(1.0)), lambda t: t.withColumns({"ssim_score": F.lit(0.64), "visual_semantic_score": F.lit(1.0)}))
    got = {r["id"]: r for r in evaluate.evaluate(df, *stages).collect()}
    assert seen[:1] == [2] and list(got[1].asDict())[1:] == list(evaluate.RESULT) and len(evaluate.RESULT) == 25
    # One word has no runs of two and more, so its n-gram match is next to nothing; the other three matches are whole.
    assert got[1]["codebleu"] == pytest.approx(0.75, abs=1e-3) and (got[1]["ast_distance_raw"], got[1]["visual_similarity"], got[1]["manim_render_success"]) == (0.0, 0.8, True)
    assert (got[2]["codebleu"], got[2]["ast_distance_raw"], got[2]["syntax_error"], got[2]["manim_render_success"], got[2]["raw_generated_thinking"]) == (0.0, 0.0, True, False, "think")
    assert (got[3]["ast_distance_raw"], got[3]["syntax_error"], got[3]["ssim_score"]) == (None, True, 0.0)
    assert (got[4]["manim_render_success"], got[4]["visual_similarity"]) == (True, 0.0)
    # Rows with a null or repeated id are rows like any other.
    again = spark.createDataFrame([(k, "t", "Line(1)", None) for k in (1, 1, None)], "id long, text_script string, expected_code string, code_plan string")
    some = (lambda t: t.withColumn("response", F.lit("<code>Line(1)</code>")), *stages[1:])
    assert [r["id"] for r in evaluate.evaluate(again, *some).orderBy("id").collect()] == [None, 1, 1]
    means = summary(evaluate.evaluate(df, *stages)).first()
    assert means["manim_render_success"] == 0.5 and means["syntax_error"] == 0.5
    with pytest.raises(RuntimeError, match="does not render"):
        evaluate.evaluate(df, *stages, strict=True)


def test_small_media_leave_in_few_batches_and_from_many_tasks(spark):
    """A film gave a batch of its own however small it was, and one file of short rows was one task's work."""
    rows = spark.range(0, 3000, 1, 2).selectExpr("cast(id as string) path", "unhex('0102') content")
    got = external.frame_rows(rows, lambda data: ([np.frombuffer(data, np.uint8).reshape(1, 2)] * 2, 5.0))
    batches = got.mapInArrow(lambda bs: [pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs], "n long").collect()
    assert sum(b["n"] for b in batches) == 6000 and len(batches) <= 4
    shown = got.where("path < '11'").withColumn("gray", external.pixels("gray")).collect()
    assert shown and all(r["gray"] == [1, 2] and (r["height"], r["width"]) == (1, 2) for r in shown)
    for name in ("image_frames", "video_frames", "session_names"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.index("REPARTITION_BY_NUM") > max(plan.find("MapInArrow"), plan.find("ArrowEvalPython")) > 0, name
