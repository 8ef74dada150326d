"""Quality classifier from positive and unlabelled text.

A linear model on style features is fitted by minimising the non-negative unbiased risk (Kiryo et al. 2017) with logistic loss:
prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]). Positives are trusted texts, the unlabelled are a draw of all
texts, and the class prior is estimated from these two by Elkan and Noto's ratio; no label of a bad text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import label_sample
from tessera.llm.textstats import COUNTS, stats
from tessera.shipping import ship

#: Positive texts, and unlabelled texts, to fit on at most.
POSITIVES, UNLABELLED = 4000, 4000
#: Byte classes: space, newline, lower, upper, digit, full stop, comma, other end marks, quotes and brackets, symbols, other ASCII, beyond ASCII.
_CLASSES = (b" \t", b"\n\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?;:", b"\"'()[]{}-", b"#*$%&|<>")
_N = len(_CLASSES) + 2
_CLASS = np.full(256, _N - 2, np.int64)
_CLASS[128:] = _N - 1
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
WIDTH = _N * _N + 15 - len(COUNTS)


def features(text: bytes | None) -> np.ndarray:
    """Ratios of textstats and the frequencies of neighbouring byte classes over the whole text; zeros when empty."""
    x = np.zeros(WIDTH, np.float32)
    if text:
        c = _CLASS[np.frombuffer(text, np.uint8)]
        pairs = np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)
        x[: _N * _N] = np.log1p(pairs * (1000.0 / max(1, len(text) - 1)))
        x[_N * _N :] = np.log1p(np.array(stats(text)[len(COUNTS) :]) * 10.0)
    return x


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, bool]:
    """The non-negative risk, and whether its negative part is above zero."""
    negative = _softplus(zu).mean() - prior * _softplus(zp).mean()
    return float(prior * _softplus(-zp).mean() + max(0.0, negative)), bool(negative >= 0)


def elkan_noto(p: np.ndarray, u: np.ndarray) -> float:
    """Prior as the mean of a positive-or-unlabelled classifier's odds over the unlabelled, relative to the positives."""
    m = _descend(p, u, 0.5, plain=True)
    gp, gu = m.scores(p), m.scores(u)
    return float(np.clip((gu / (1 - gu + 1e-6)).mean() / max(1e-6, (gp / (1 - gp + 1e-6)).mean()), 0.05, 0.95))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3, plain: bool = False) -> Model:
    centre, scale = u.mean(0), u.std(0) + 1e-2
    xp, xu = (np.clip((x - centre) / scale, -8, 8).astype(np.float64) for x in (p, u))
    w, b = np.zeros(p.shape[1]), 0.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        if plain:
            gp, gu = (sig(zp) - 1) / len(zp), sig(zu) / len(zu)
        elif risk(zp, zu, prior)[1]:
            gp, gu = prior * (sig(zp) - 1) / len(zp) - prior * sig(zp) / len(zp), sig(zu) / len(zu)
        else:  # the negative part fell below zero: step back out of it
            gp, gu = prior * sig(zp) / len(zp), -sig(zu) / len(zu)
        g = np.append(xp.T @ gp + xu.T @ gu + ridge * w, gp.sum() + gu.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(centre, scale, w, float(b), prior)


def learn(p: np.ndarray, u: np.ndarray, prior: float | None) -> Model:
    """A model from features of positives and of unlabelled texts. Without either, every score is the prior (0.5 if unknown)."""
    if not len(p) or not len(u):
        at = min(max(prior if prior is not None else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(at / (1 - at))), at)
    return _descend(p, u, prior if prior is not None else elkan_noto(p, u))


def _featured(docs: DataFrame, extra: list[Column]) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["k", "x"])

    rows = docs.select(F.struct(*extra).alias("k"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"k {rows.schema[0].dataType.simpleString()}, x binary").select("k.*", "x")


def _matrix(rows: list) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, WIDTH)


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> Model:
    """A model from trusted rows (labels: doc_id, quality; an id labelled both ways is not trusted) and texts for which `keep` over doc_id holds."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = F.broadcast(label_sample(labels, "quality", POSITIVES, keep, only=1))
    good = _one_each(_featured(ids.join(picked, "doc_id"), [F.col("doc_id"), F.xxhash64("text").alias("h")])).collect()
    n = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30))
    some = ids.where(keep & (draw < int(min(1.0, 0.9 * UNLABELLED / max(1, n)) * (1 << 30))))
    rest = _one_each(_featured(some, [F.col("doc_id"), F.xxhash64("text").alias("h")])).limit(UNLABELLED).collect()
    return learn(_matrix(good), _matrix(rest), None)


def _one_each(rows: DataFrame) -> DataFrame:
    """doc_id and x of one row of each doc_id, in order: that of the text with the smallest hash."""
    return rows.groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("s")).select("doc_id", "s.x").orderBy("doc_id")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (probability of good quality) for every row of docs; reads nothing but the text.

    Null or empty text: the score of zero features. Repeated rows, and texts that tie in all features, score alike. Very long texts are read whole; other columns, whatever
    their names, are ignored; a null doc_id stays null. Empty table: no rows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
