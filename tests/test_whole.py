"""Queries that have no SQL run over all of their rows, not over a part."""

import math

import numpy as np
import pyarrow.parquet as pq

from tessera.functions import sequence
from tessera.operators import visual
from tessera.plans.catalog import QUERIES
from tessera.plans.similarity import _pooled
from tessera.sources import external

FOLDER = "/root/testdata/sf0.001"


def test_the_evaluation_takes_every_program(spark):
    part = pq.read_table(f"{FOLDER}/part.parquet", columns=["p_partkey", "p_size"]).to_pylist()
    want = {r["p_partkey"] for r in part}
    want.remove(max(want))  # no part comes after it, so it has no expected program
    rows = QUERIES["evaluation_run"](spark, FOLDER).select("id", "raw_generated_code_plan").collect()
    assert len(rows) == len(want) and {r["id"] for r in rows} == want
    assert all(r["raw_generated_code_plan"] == ("1. go" if r["id"] % 2 == 0 else "") for r in rows)
    means = QUERIES["evaluation_means"](spark, FOLDER).collect()
    assert len(means) == 1 and math.isclose(means[0]["manim_render_success"], sum(k % 5 > 1 for k in want) / len(want))
    # Its means are those of its rows.
    run = QUERIES["evaluation_run"](spark, FOLDER).collect()
    for metric, mean in means[0].asDict().items():
        values = [float(r[metric]) for r in run if r[metric] is not None]
        assert math.isclose(mean, sum(values) / len(values), abs_tol=1e-9), metric


def warped(a, b):
    above = [0.0] + [math.inf] * len(b)
    for x in a:
        row = [math.inf]
        for j, y in enumerate(b):
            row.append(abs(x - y) + min(row[-1], above[j], above[j + 1]))
        above = row
    return above[-1]


def test_series_are_warped_whole(spark):
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    by = {r["vec_id"]: r["embedding"] for r in rows}
    want = {k: (v, by[k + 1]) for k, v in by.items() if k + 1 in by}
    folded, vectorised = ({r["vec_id"]: r["distance"] for r in QUERIES[q](spark, FOLDER).collect()} for q in ("dtw_series_folded", "dtw_series"))
    assert set(folded) == set(want) == set(vectorised)
    for k, (a, b) in want.items():
        assert len(a) == len(b) == 64
        assert abs(folded[k] - warped(a, b)) < 2e-6 and abs(vectorised[k] - warped(a, b)) < 2e-6
        assert folded[k] > warped(a[:4], b[:4]) + 0.1


def test_visual_scores_are_those_of_the_frames(spark):
    """Each pair by plain loops: all frames with all frames, best matches, warping."""
    from tests.test_similarity import plain_ssim

    rng = np.random.default_rng(9)
    films = [[rng.integers(0, 256, (8, 8)).astype(np.uint8) for _ in range(n)] for n in (3, 5, 1)] + [[rng.integers(0, 256, (16, 24)).astype(np.uint8) for _ in range(2)]]
    data = [external.encode_frames(f, 5.0) if len(f) > 1 else external.encode_png(f[0]) for f in films]
    decode = lambda b: external.decode_image(b) if b.startswith(b"\x89PNG") else external.decode_frames(b)
    pairs = [(k, data[g], data[x]) for k, (g, x) in enumerate([(0, 0), (1, 0), (0, 1), (2, 1), (1, 2), (0, 3), (3, 0), (0, 0)])]
    which = [(0, 0), (1, 0), (0, 1), (2, 1), (1, 2), (0, 3), (3, 0), (0, 0)]
    df = spark.createDataFrame(pairs, "id int, generated_artifact binary, expected_artifact binary")
    got = {r["id"]: r for r in visual.visual_scores(df, decode, _pooled).collect()}
    assert len(got) == len(pairs)
    unit = lambda f: (lambda v: v / np.sqrt(v @ v))(sequence.resize_area(f, 4, 4).ravel())
    for k, (g, x) in enumerate(which):
        a, b = films[x], films[g]
        m = np.array([[plain_ssim(p, q if q.shape == p.shape else np.rint(sequence.resize_area(q, *p.shape))) for q in b] for p in a])
        assert math.isclose(got[k]["ssim_score"], math.exp(-5 * warped(m.max(1), m.max(0)) / max(m.shape)), rel_tol=1e-9)
        cost = [[1 - float(unit(p) @ unit(q)) for q in b] for p in a]
        above = [0.0] + [math.inf] * len(b)
        for line in cost:
            row = [math.inf]
            for j, c in enumerate(line):
                row.append(c + min(row[-1], above[j], above[j + 1]))
            above = row
        assert math.isclose(got[k]["visual_semantic_score"], math.exp(-above[-1] / max(len(a), len(b))), rel_tol=1e-6)
    assert got[0]["ssim_score"] == got[7]["ssim_score"] == 1.0


def test_pairs_with_gaps_are_scored(spark, tmp_path):
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet")
    kept = [k for k in range(rows.num_rows) if rows["vec_id"][k].as_py() not in (1, 2, 3, 13, 20, 21, 22, 23)]
    pq.write_table(rows.take(kept), tmp_path / "embeddings.parquet")
    full, gaps = ({n: {r["pair_id"]: r for r in QUERIES[n](spark, d).collect()} for n in ("ssim_dtw_score", "embed_dtw_score")} for d in (FOLDER, str(tmp_path)))
    vectors = {r["vec_id"]: r["embedding"] for r in rows.take(kept).to_pylist()}
    for n in full:
        # Pair 0 has 1 and 4 frames, pair 1 has 4 and 3, pair 2 has no second side.
        assert set(gaps[n]) == set(full[n]) - {2}
        assert all(gaps[n][k] == r for k, r in full[n].items() if k > 2)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    one = unit(vectors[0])
    cost = sum(1 - sum(x * y for x, y in zip(one, unit(vectors[k]), strict=True)) for k in range(4, 8))  # one frame meets all of the other side
    assert abs(gaps["embed_dtw_score"][0]["cost"] - cost) < 2e-6 and abs(gaps["embed_dtw_score"][0]["score"] - math.exp(-cost / 4)) < 2e-6
    assert gaps["ssim_dtw_score"][0]["distance"] >= 0


def test_artifacts_are_decoded_once(spark, tmp_path):
    """Each of five readers of the frames decoded all artifacts again."""
    log = tmp_path / "decoded"

    def decode(data):
        with open(log, "ab") as f:
            f.write(data + b"\n")
        return [np.full((8, 8), data[0], np.uint8)] * 2, 4.0

    pairs = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in [(b"a", b"b"), (b"a", b"c"), (b"b", b"c"), (b"c", b"c")]], "generated_artifact binary, expected_artifact binary")
    got = visual.visual_scores(pairs, decode, _pooled).collect()
    assert len(got) == 4 and sorted(log.read_bytes().split()) == [b"a", b"b", b"c"]
