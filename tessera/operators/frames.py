"""The similarity matrix of two films, frame by frame, a pair of films at a time.

A film's frames are binary rows. Those of a pair come to one task in order, the first film's before the second's: the task keeps the first's pixels and lets the second's
go by, a few at a time, so each frame is shuffled once for each pair that it is in. A first film beyond HELD bytes is cut into parts, each a task's work with all of the
second film."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import sequence
from tessera.shipping import ship

#: Bytes of pixels of a pair's first film that a task keeps.
HELD = 64 << 20
#: Bytes of numbers of the second film's frames, and of what is known of their windows, that go by together.
PASSING = 32 << 20


@F.pandas_udf(T.BinaryType())
def packed(pixels: pd.Series) -> pd.Series:
    """Arrays of gray values of 0 to 255 as bytes."""
    return pixels.map(lambda v: None if v is None else np.asarray(v).astype(np.uint8).tobytes())


def _fitting(frame: np.ndarray, shape: tuple[int, int], resize: bool) -> np.ndarray | None:
    if frame.shape == shape:
        return frame
    return np.rint(sequence.resize_area(frame, *shape)) if resize else None


class _Film:
    """What a task keeps of the first film, and the frames of the second that have yet to be compared."""

    def __init__(self, resize: bool):
        self.resize, self.kept, self.passing, self.room = resize, [], [], 0

    def add(self, side: int, k: int, frame: np.ndarray) -> bool:
        """Takes a frame; whether enough are waiting."""
        if side == 0:
            self.kept.append((k, frame))
            return False
        self.passing.append((k, frame))
        self.room += frame.size * 32
        return self.room >= PASSING

    def compared(self) -> Iterator[tuple[int, int, float]]:
        """(i, j, similarity) of all kept frames with those that wait, whose windows are summed once for each size of the first film's frames."""
        known: dict[tuple[int, int], list] = {}
        for i, x in self.kept:
            if x.shape not in known:
                fit = [(j, _fitting(y, x.shape, self.resize)) for j, y in self.passing]
                known[x.shape] = [(j, y if y is None else y[None].astype(np.float64)) for j, y in fit]
                known[x.shape] = [(j, y, None if y is None else sequence.moments(y)) for j, y in known[x.shape]]
            a = x[None].astype(np.float64)
            small = min(x.shape) < sequence.WINDOW
            of_a = None if small else sequence.moments(a)
            for j, y, of_y in known[x.shape]:
                yield i, j, float("nan") if small or y is None else float(sequence.ssim_known(a, of_a, y, of_y)[0])
        self.passing, self.room = [], 0


def matrix(frames: DataFrame, pair: str = "pair_id", resize: bool = True) -> DataFrame:
    """pair, i, j, ssim for all frames of side 0 with all of side 1 of each pair, from rows (pair, side, k, width, gray): gray values as bytes, row by row.

    A second frame of another size takes that of the first, each new pixel the mean of the area that it covers; without resize, and for frames smaller than a window, the similarity is NaN.
    A pair without frames on both sides, a null pair and frames without pixels have no rows; frames that share a number are each compared."""
    spark = frames.sparkSession
    ship(spark)
    rows = frames.where(F.col(pair).isNotNull() & (F.length("gray") > 0)).select(F.col(pair).alias("pair"), F.col("side").cast("int").alias("side"), F.col("k").cast("int").alias("k"), F.col("width").cast("int").alias("width"), "gray")
    part: Column = F.floor(F.col("k") / F.greatest(F.lit(1), F.floor(F.lit(HELD) / F.length("gray")))).cast("int")
    first, second = rows.where("side = 0").withColumn("part", part), rows.where("side = 1")
    parts = first.groupBy("pair").agg(F.collect_set("part").alias("parts"))
    both = first.unionByName(second.join(parts, "pair").select(*rows.columns, F.explode("parts").alias("part")))
    dealt = both.repartition("pair", "part").sortWithinPartitions("pair", "part", "side", "k")
    kind = dealt.schema["pair"].dataType
    schema = T.StructType([T.StructField(pair, kind), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("ssim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, film = None, _Film(resize)

        def found(key: tuple, of: pa.DataType) -> pa.RecordBatch:
            got = list(film.compared())
            columns = list(zip(*got, strict=True)) if got else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), of), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], [pair, "i", "j", "ssim"])

        of = None
        for batch in batches:
            names = {n: k for k, n in enumerate(batch.schema.names)}
            of = batch.schema.field(names["pair"]).type
            column = lambda n: batch.column(names[n])  # noqa: B023, E731
            for at in range(batch.num_rows):
                key = (column("pair")[at].as_py(), column("part")[at].as_py())
                if key != now:
                    if now is not None and film.passing:
                        yield found(now, of)
                    now, film = key, _Film(resize)
                pixels = np.frombuffer(column("gray")[at].as_buffer(), np.uint8).reshape(-1, column("width")[at].as_py()).copy()
                if film.add(column("side")[at].as_py(), column("k")[at].as_py(), pixels):
                    yield found(now, of)
        if now is not None and film.passing:
            yield found(now, of)

    return dealt.mapInArrow(run, schema)
