"""Visual scores of rendered programs: frames, their structural similarity matrix and embeddings, both by dynamic time warping.

Each distinct artifact is decoded and encoded once, each distinct pair of artifacts compared once. Frames meet only within their pair."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import sequence, vectors
from tessera.operators.frames import matrix
from tessera.shipping import ship
from tessera.sources.external import FRAMES, RUN, runs_of, sampled
from tessera.sources.store import spread, written

#: A decoder gives an artifact's frames, all or one after the other, and their rate; an encoder, made once a task, a vector for each frame.
Decode = Callable[[bytes], tuple[Iterable[np.ndarray], float]]
Encode = Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]]

#: Fixed value: how sharply the similarity of frames falls with their warping distance.
SHARPNESS = 5.0


def frames_of(artifacts: DataFrame, decode: Decode, encode: Encode, target_fps: float = 5) -> DataFrame:
    """key, k, height, width, gray, e: the sampled frames of artifacts (key, artifact), in order, with unit embeddings. What can't be decoded is an error."""
    ship(artifacts.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = encode()
        columns = ["key", "k", "height", "width", "gray", "e"]
        rows, room = [], 0
        for part in parts:
            for key, data in zip(part["key"], part["artifact"], strict=True):
                # A film's frames go on in runs of bounded size, before the next film is decoded; small runs together.
                for shots in runs_of(sampled(bytes(data), decode, key, target_fps)):
                    size = sum(f.size for _, f in shots)
                    if rows and (room + size > RUN or len(rows) >= FRAMES):
                        yield pd.DataFrame(rows, columns=columns)
                        rows, room = [], 0
                    known = embed([f for _, f in shots])
                    rows += [(key, k, *f.shape, f.astype(np.uint8).tobytes(), np.asarray(e, float).tolist()) for (k, f), e in zip(shots, known, strict=True)]
                    room += size
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    found = artifacts.mapInPandas(run, "key string, k int, height int, width int, gray binary, e array<double>")
    return found.withColumn("e", vectors.normalise(F.col("e")))


def visual_scores(pairs: DataFrame, decode: Decode, encode: Encode, target_fps: float = 5) -> DataFrame:
    """pairs (generated_artifact, expected_artifact, ...) with ssim_score and visual_semantic_score.

    The matrix of similarities between the frames of the expected and the generated artifact gives each frame's best match; the two series of these are warped, and so are the
    frames' unit embeddings by one less their product."""
    keyed = pairs.withColumns({"_g": F.sha2("generated_artifact", 256), "_x": F.sha2("expected_artifact", 256)})
    each = keyed.select(F.col("_g").alias("key"), F.col("generated_artifact").alias("artifact")).union(keyed.select("_x", "expected_artifact")).dropDuplicates(["key"])
    # Five places read the frames: written, they are decoded and encoded once.
    shots = written(frames_of(spread(each, "key"), decode, encode, target_fps), "frames")
    once = keyed.select("_x", "_g").distinct().withColumn("pair_id", F.concat_ws(" ", "_x", "_g"))
    side = lambda key, number: once.select(F.col(key).alias("key"), "pair_id").join(shots, "key").select("pair_id", F.lit(number).alias("side"), "k", "width", "gray")
    best = sequence.best_match(matrix(side("_x", 0).unionByName(side("_g", 1))))
    alike = best.select("pair_id", sequence.similarity(sequence.dtw_fold(F.col("rows"), F.col("cols")), F.size("rows"), F.size("cols"), SHARPNESS).alias("ssim_score"))
    line = shots.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda f: f["e"]).alias("line"))
    lines = once.join(line.select(F.col("key").alias("_x"), F.col("line").alias("a")), "_x").join(line.select(F.col("key").alias("_g"), F.col("line").alias("b")), "_g")
    near = lines.select("_x", "_g", "pair_id", sequence.similarity(sequence.dtw_fold(F.col("a"), F.col("b"), vectors.dot_distance), F.size("a"), F.size("b")).alias("visual_semantic_score"))
    scores = near.join(alike, "pair_id").drop("pair_id")
    return keyed.join(scores, ["_x", "_g"]).select(*pairs.columns, "ssim_score", "visual_semantic_score")
