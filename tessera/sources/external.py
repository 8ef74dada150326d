"""Sources behind processes and networks: chat endpoints, renderers, media decoders, interface reflection.

Each is a mapInPandas stage around an injected callable, which is made once for each task and may hold a model, a session or a decoder.
"""

from __future__ import annotations

import glob
import inspect
import os
import re
import struct
import subprocess
import sys
import tempfile
import zlib
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import is_blank
from tessera.shipping import ship
from tessera.sources import calls

TIMED_OUT = "The generation took too long."
BLANK_RENDER = "There is no code to render."


def _extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def with_answers(df: DataFrame, make: Callable[[], Callable[[str], str]], request: str = "request", response: str = "response", timeout: float | None = None, in_flight: int = 8) -> DataFrame:
    """df with the answer to each request, and `timed_out`. An answer that takes too long is a sentinel text, and its call is ended.

    A task has `in_flight` requests on their way at a time: on threads, or in processes where there is a time limit (see calls.answers())."""
    ship(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = cache(make)  # once a task, or once in each child
        for part in parts:
            got = list(calls.answers(made, part[request], in_flight, timeout))
            yield part.assign(**{response: [TIMED_OUT if late else a for a, late in got], "timed_out": [late for _, late in got]})

    return df.mapInPandas(run, _extended(df, T.StructField(response, T.StringType()), T.StructField("timed_out", T.BooleanType())))


def chat_endpoint(base: str, model: str, post: Callable[..., Any], token: str = "</think>", timeout: float = 1800) -> Callable[[], Callable[[str], str]]:
    """A maker of callables for a chat completion endpoint. post(url, json, timeout) gives the decoded response.

    A time-out gives an empty answer; another failure, or a response without choices, is an error."""

    def make() -> Callable[[str], str]:
        def ask(text: str) -> str:
            try:
                got = post(f"{base.rstrip('/')}/chat/completions", json={"model": model, "messages": [{"role": "user", "content": text}]}, timeout=timeout)
            except TimeoutError:
                return ""
            except OSError as error:
                raise RuntimeError(f"the request failed: {error}") from error
            if not got.get("choices"):
                raise RuntimeError("the response has no choices")
            return got["choices"][0]["message"]["content"] or ""

        return ask

    return make


def run_script(code: str, command: list[str] | None = None, timeout: float = 300) -> tuple[bytes | None, bool, str, str]:
    """(artifact, success, output, errors) of a script run in a folder of its own, which goes afterwards.

    The artifact is the first .mp4 that it leaves, else the first .png; a non-zero exit, no artifact or a time-out is a failure."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "scene.py")
        with open(path, "w", encoding="utf-8") as f:
            f.write(code)
        try:
            done = subprocess.run([*(command or [sys.executable]), path], cwd=folder, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return None, False, "", f"The render took more than {timeout:g} s."
        if done.returncode:
            return None, False, done.stdout, done.stderr
        for ending in ("mp4", "png"):
            if found := sorted(glob.glob(os.path.join(folder, "**", f"*.{ending}"), recursive=True)):
                with open(found[0], "rb") as f:
                    return f.read(), True, done.stdout, done.stderr
        return None, False, done.stdout, "The script left no video or image."


def with_renders(df: DataFrame, render: Callable[[str], tuple[bytes | None, bool, str, str]] = run_script, code: str = "code", in_flight: int = 4) -> DataFrame:
    """df with artifact, success, info, errors. Blank code fails without a process. A task renders `in_flight` programs at a time; the renderer keeps its own time limit."""
    ship(df.sparkSession)
    fields = [T.StructField("artifact", T.BinaryType()), T.StructField("success", T.BooleanType()), T.StructField("info", T.StringType()), T.StructField("errors", T.StringType())]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [g for g, _ in calls.answers(lambda: render, part[code], in_flight)]
            yield part.assign(artifact=[g[0] for g in got], success=[g[1] for g in got], info=[g[2] for g in got], errors=[g[3] for g in got])

    blank = df.where(is_blank(F.col(code))).select("*", F.lit(None).cast("binary").alias("artifact"), F.lit(False).alias("success"), F.lit("").alias("info"), F.lit(BLANK_RENDER).alias("errors"))
    return df.where(~is_blank(F.col(code))).mapInPandas(run, _extended(df, *fields)).unionByName(blank)


#: Kind, width, height and greatest value; one white space ends it, and what follows are pixels, whatever they are.
_PNM_HEAD = re.compile(rb"(\S+)\s+(\d+)\s+(\d+)\s+\d+\s")


def decode_pnm(data: bytes) -> tuple[list[np.ndarray], float]:
    """Frames and frame rate of one portable gray or colour map (binary P5 or P6); a decoder that needs no library."""
    if not (head := _PNM_HEAD.match(data)):
        raise ValueError("no portable map")
    kind, width, height, rest = head[1], int(head[2]), int(head[3]), data[head.end() :]
    if kind == b"P5":
        return [np.frombuffer(rest[: width * height], np.uint8).reshape(height, width)], 0.0
    if kind == b"P6":
        rgb = np.frombuffer(rest[: 3 * width * height], np.uint8).reshape(height, width, 3)
        return [np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)], 0.0
    raise ValueError(f"unknown image kind {kind!r}")


_PNG = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by a PNG's colour type (grey, true colour, palette, grey and alpha, true colour and alpha), and the weights of red, green and blue in grey.
_SAMPLES, _GREY = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}, (0.299, 0.587, 0.114)


def decode_png(data: bytes) -> tuple[list[np.ndarray], float]:
    """The one frame of a PNG image of 8 bits a sample that is not interlaced, as gray; alpha is ignored."""
    if not data.startswith(_PNG):
        raise ValueError("no PNG image")
    at, packed, palette, head = len(_PNG), b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[2] != 8 or head[6] or head[3] not in _SAMPLES:
        raise ValueError("only PNG images of 8 bits a sample that are not interlaced are read")
    width, height, _, colour = head[:4]
    pixels = _unfiltered(zlib.decompress(packed), height, width, _SAMPLES[colour])
    if colour == 3:
        pixels = palette[pixels[:, :, 0]]
    gray = pixels[:, :, :3] @ np.array(_GREY) if pixels.shape[2] >= 3 else pixels[:, :, 0]
    return [np.rint(gray).astype(np.uint8)], 0.0


def _unfiltered(raw: bytes, height: int, width: int, samples: int) -> np.ndarray:
    """Pixels from a PNG's lines, each of which says how its bytes differ from what stands left (a), above (b) and above left (c)."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * samples)
    out = np.zeros((height + 1, width + 1, samples), np.int64)  # a border of zeros above and at the left
    for y in range(1, height + 1):
        how, line = int(lines[y - 1, 0]), lines[y - 1, 1:].reshape(width, samples).astype(np.int64)
        if how == 0:
            out[y, 1:] = line
        elif how == 2:
            out[y, 1:] = (line + out[y - 1, 1:]) & 255
        elif how == 1:
            out[y, 1:] = line.cumsum(0) & 255
        else:
            for x in range(1, width + 1):
                a, b, c = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    near = np.stack([np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)]).argmin(0)
                    guess = np.choose(near, [a, b, c])
                out[y, x] = (line[x - 1] + guess) & 255
    return out[1:, 1:]


def encode_png(frame: np.ndarray) -> bytes:
    """A gray frame as a PNG image."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = frame.shape
    lines = b"".join(b"\0" + row.tobytes() for row in frame.astype(np.uint8))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode_image(data: bytes) -> tuple[list[np.ndarray], float]:
    """The frame of a PNG image or a portable gray or colour map."""
    return decode_png(data) if data.startswith(_PNG) else decode_pnm(data)


_VIDEO = b"FRAMES 1\n"


def encode_frames(frames: list[np.ndarray], fps: float) -> bytes:
    """Moving gray frames, uncompressed: a stand-in for a video that needs no codec."""
    height, width = frames[0].shape if frames else (0, 0)
    return _VIDEO + struct.pack(">dIII", fps, len(frames), height, width) + b"".join(f.astype(np.uint8).tobytes() for f in frames)


def decode_frames(data: bytes) -> tuple[list[np.ndarray], float]:
    """Frames and rate of encode_frames(). What can't be opened, and a rate of 0, is an error."""
    if not data.startswith(_VIDEO):
        raise ValueError("the video can't be opened")
    fps, count, height, width = struct.unpack_from(">dIII", data, len(_VIDEO))
    if not fps > 0:
        raise ValueError("the video has no frame rate")
    pixels = np.frombuffer(data, np.uint8, count * height * width, len(_VIDEO) + 20)
    return list(pixels.reshape(count, height, width)), fps


def write_files(spark: SparkSession, folder: str, files: list[tuple[str, bytes]]) -> None:
    """Small files, by name, in a folder of any file system that Spark knows."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, data in files:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(base, name))
        out.write(bytearray(data))
        out.close()


Decode = Callable[[bytes], tuple[Iterable[np.ndarray], float]]
#: Bytes of pixels of sampled frames that a task holds at once.
RUN = 16 << 20
#: Frames after which a task lets rows go on, however small they are.
FRAMES = 1 << 13


def sampled(data: bytes, decode: Decode, name: str, target_fps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(number, frame) of those frames that target_fps takes, one after the other. What can't be decoded, moves without a rate or has no frame is an error that names it."""
    count = 0
    try:
        found, fps = decode(data)
        step = max(1, int(fps / target_fps))
        for f in found:
            count += 1
            if count == 2 and not fps > 0:
                break
            if (count - 1) % step == 0:
                yield count - 1, f
    except Exception as error:
        raise ValueError(f"could not load {name}: {error}") from error
    if not count:
        raise ValueError(f"no frames in {name}")
    if count > 1 and not fps > 0:
        raise ValueError(f"no frame rate in {name}")


def runs_of(shots: Iterable[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Frames in runs of at most RUN bytes of pixels, or of one frame."""
    run, room = [], 0
    for shot in shots:
        if run and room + shot[1].size > RUN:
            yield run
            run, room = [], 0
        run.append(shot)
        room += shot[1].size
    if run:
        yield run


def frame_rows(media: DataFrame, decode: Decode, target_fps: float = 5) -> DataFrame:
    """path, frame_idx, height, width, gray (bytes, row by row) of the sampled frames of media (path, content).

    A decoder that gives its frames one after the other never has a whole film in memory: a task holds runs of RUN bytes."""
    ship(media.sparkSession)
    names = ["path", "frame_idx", "height", "width", "gray"]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, room = [], 0
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for shots in runs_of(sampled(data.as_py(), decode, path, target_fps)):
                    size = sum(f.size for _, f in shots)
                    # Small runs go on together: a batch for each would cost more than its frames.
                    if rows and (room + size > RUN or len(rows) >= FRAMES):
                        yield told(rows)
                        rows, room = [], 0
                    rows += [(path, i, *f.shape, f.astype(np.uint8).tobytes()) for i, f in shots]
                    room += size
        if rows:
            yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("path", "content").mapInArrow(run, "path string, frame_idx int, height int, width int, gray binary")


def frames(spark: SparkSession, path: str, decode: Decode = decode_pnm, target_fps: float = 5) -> DataFrame:
    """Sampled gray frames of the media files under a path, their pixels as numbers. decode gives a file's frames and rate; a still image has one frame and rate 0.

    A file that can't be decoded, that moves without a rate, or that has no frame, is an error that says which."""
    found = frame_rows(spark.read.format("binaryFile").load(path), decode, target_fps)
    return found.withColumn("gray", pixels("gray"))


@F.arrow_udf(T.ArrayType(T.ShortType()))
def pixels(gray: pa.Array) -> pa.Array:
    """Bytes as numbers of 0 to 255."""
    whole = [b or b"" for b in gray.to_pylist()]
    ends = np.cumsum([0, *map(len, whole)])
    values = pa.array(np.frombuffer(b"".join(whole), np.uint8).astype(np.int16))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=gray.is_null())


class _Unknown(LookupError):
    """A dotted name that leads nowhere."""


def _class_members(kind: type) -> ChainMap:
    """The members of a class as an instance finds them."""
    return ChainMap(*(dict(vars(c)) for c in kind.__mro__))


def _member(owner: Any, name: str, last: bool) -> Any:
    """A step of a dotted name. Before the last one, what has properties of its own is read as a property: by the type that this returns."""
    try:
        value = getattr(owner, name)
    except AttributeError as error:
        raise _Unknown(name) from error
    if last or not any(isinstance(m, property) for m in (value, *_class_members(type(value)).values())):
        return value
    return inspect.get_annotations(value.fget).get("return") if isinstance(value, property) else None


def _lines_of(value: Any) -> tuple[str, str]:
    """(signature, documentation) of a value: for one that can't be called its type, for one without a text its class's text or a sentence."""
    kind = type(value).__name__
    text = inspect.getdoc(value) or inspect.getdoc(type(value))
    if not callable(value):
        return f": {kind}", text or f"An attribute of type {kind}."
    try:
        signature = str(inspect.signature(value))
    except (TypeError, ValueError):
        signature = "()"
    return signature, text or f"A callable of type {kind}."


def described(package: Any, name: str) -> tuple[str, str]:
    """(signature, documentation) of a dotted name of a package; a name that leads nowhere is said to have none."""
    from tessera.functions.templates import PLAIN

    *way, end = name.split(".")
    try:
        owner = reduce(lambda at, part: _member(at, part, last=False), way, package)
        return _lines_of(_member(owner, end, last=True))
    except (_Unknown, TypeError, ValueError):
        return "()", PLAIN["no_doc"].format(invalid_param=name)


def api_docs(spark: SparkSession, package: Any, names: list[str]) -> DataFrame:
    """A dimension (name, sig, doc) of a package's names, made on the driver: it has a row a name asked for."""
    return spark.createDataFrame([(n, *described(package, n)) for n in dict.fromkeys(names)], "name string, sig string, doc string")
