"""Toxicity by nearest labelled examples.

The examples are a bounded sample of labelled texts. Terms are whole words, all of them: every word of the examples is in the index.
A vector holds TF-IDF weights at unit length, each times the relevance of its term: FLOOR for a word of which the labels say nothing, up to 1 for one that
stands far more often in texts with label 1 than chance allows. Every text is compared with the examples by exact cosine. The inverted index is cut into
blocks of examples and keeps the largest weight of each common term in each block; blocks whose bound cannot reach the k-th best similarity are
skipped. The neighbours' votes, weighted by squared similarity and calibrated (a rising curve by
pooling) on the votes that labelled rows get from the other rows, are the score, and the neighbours are its evidence.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.language_id import normal
from tessera.llm.sampling import label_sample
from tessera.shipping import ship
from tessera.sources.store import dropped, written

#: Labelled examples at most, and (example, term) pairs at most: with these the index and its broadcast are bounded. Where the
#: examples hold more pairs than that, those come first whose id has the smaller hash.
EXAMPLES, POSTINGS = 4000, 4_000_000
#: Tasks that read the sampled texts, and that work out their votes, at most.
FIT_TASKS = 16
#: Examples in a block; blocks of best bound that are read before any is skipped; neighbours of a text.
BLOCK, FIRST, NEIGHBOURS = 64, 8, 25
#: A word of more than one example in COMMON is common: it is read by block. The lists of the others are short and read whole.
COMMON = 32
#: Weight of a term of which the labels say nothing, and the standard deviations from chance at which a term starts to weigh more and weighs fully.
FLOOR, LOW, HIGH = 0.04, 4.0, 9.0
#: Weight of the base rate against the neighbours' squared similarities.
SHRINK = 0.0025


def term_keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text as sorted 64-bit hashes, and how often each stands in it."""
    bag = Counter(normal(text).split())
    keys = np.fromiter(map(xxhash.xxh64_intdigest, bag), np.uint64, len(bag))
    order = np.argsort(keys)
    return keys[order], np.fromiter(bag.values(), np.int64, len(bag))[order]


def marks_of(text: str | None) -> list[int]:
    """A text's least word-triple hash by each of several hash functions."""
    salts = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64) | np.uint64(1)
    words = normal(text).split()
    triples = [b" ".join(w) for w in zip(words, words[1:], words[2:], strict=False)] or [b" ".join(words)]
    keys = np.array([zlib.crc32(t) for t in triples], np.uint64)
    return [int(((keys * salt) & np.uint64(0xFFFFFFFF)).min()) for salt in salts]


def distinct(marks: list[list[int]]) -> list[int]:
    """Places of the texts (by marks_of) that are no near copies of earlier ones: none of their marks has been seen.
    Copies would make every word of one text speak for its label."""
    seen: set[tuple[int, int]] = set()
    out = []
    for place, found in enumerate(marks):
        least = set(enumerate(found))
        if not least & seen:
            out.append(place)
        seen |= least
    return out


def relevance(df: np.ndarray, a: np.ndarray, n: int, pos: float) -> np.ndarray:
    """Of terms in df of n texts, a of them labelled 1 (pos in all): FLOOR, rising to 1 with the surplus over chance."""
    if not 0 < pos < n:
        return np.ones(len(df))
    rate = pos / n
    surplus = (a - df * rate) / np.sqrt(np.maximum(1e-9, df * rate * (1 - rate)))
    return FLOOR + (1 - FLOOR) * np.clip((surplus - LOW) / (HIGH - LOW), 0, 1)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of several runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def isotonic(votes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve from votes to the share of label 1, as points to interpolate between: neighbouring votes are pooled while their shares
    fall. A pool of n rows counts half a row of each label more. Without both labels the curve is the vote itself."""
    if not 0 < marks.sum() < len(marks):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    pools: list[list[float]] = []  # rows, rows with label 1, sum of votes
    for v, y in sorted(zip(votes.tolist(), marks.tolist(), strict=True)):
        pools.append([1.0, y, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    rows, ones, sums = np.array(pools).T
    return np.append(sums / rows, 1.0), np.append(np.maximum.accumulate((ones + 0.5) / (rows + 1)), (ones[-1] + 0.5) / (rows[-1] + 1))


class Index:
    """Labelled examples (id, text, label 0 or 1) by block."""

    def __init__(self, examples: list[tuple[int, str, int]]):
        examples = sorted(examples)
        self._fill([k for k, _, _ in examples], np.array([y for _, _, y in examples], float), [term_keys(t) for _, t, _ in examples], distinct([marks_of(t) for _, t, _ in examples]))

    @classmethod
    def of(cls, ids: list[int], labels: np.ndarray, bags: list, once: list[int]) -> Index:
        """An index of bags of terms (keys, counts); once: the examples that are no copies of others."""
        out = cls.__new__(cls)
        out._fill(ids, labels, bags, once)
        return out

    def _fill(self, ids: list[int], labels: np.ndarray, bags: list, once: list[int]) -> None:
        n = len(ids)
        self.base = (float(labels.sum()) + 1) / (n + 2)
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *[k for k, _ in bags]])
        counts = np.concatenate([np.zeros(0), *[c for _, c in bags]])
        owner = np.repeat(np.arange(n), [len(k) for k, _ in bags])
        self.terms, term = np.unique(keys, return_inverse=True)
        df = np.bincount(term, minlength=len(self.terms))
        single = np.isin(owner, once)
        seen = np.bincount(term[single], minlength=len(self.terms))
        a = np.bincount(term[single], labels[owner[single]], minlength=len(self.terms))
        # A word that every example holds still counts a little, so that no text with known words is without a vector.
        self.worth = np.log1p(n / np.maximum(1, df)) * relevance(seen, a, len(once), float(labels[once].sum()))
        weight = (1 + np.log(counts)) * self.worth[term]
        weight /= np.sqrt(np.bincount(owner, weight * weight, minlength=n))[owner]
        # Examples with the same heaviest term stand together, which keeps the bounds of the other blocks low.
        order = np.lexsort((term, -weight, owner))
        heaviest = np.full(n, len(self.terms))
        first = np.flatnonzero(np.diff(owner[order], prepend=-1))
        heaviest[owner[order][first]] = term[order][first]
        place = np.empty(n, np.int64)
        place[np.lexsort((np.arange(n), heaviest))] = np.arange(n)
        back = np.argsort(place)
        self.ids, self.marks = np.array(ids, np.int64)[back], labels[back]
        self.blocks = -(-n // BLOCK)
        at = place[owner]
        order = np.lexsort((at, term))
        self.example, self.weight = at[order].astype(np.int32), weight[order]
        run = np.flatnonzero((np.diff(term[order], prepend=-1) != 0) | (np.diff(at[order] // BLOCK, prepend=-1) != 0))
        # A run: the postings of one term in one block. head[t] to head[t + 1] are the runs of term t.
        self.start = np.append(run, len(order))
        self.run_block = (self.example[run] // BLOCK).astype(np.int32)
        most = np.maximum.reduceat(self.weight, run) if len(run) else np.zeros(0)
        self.head = np.searchsorted(term[order][run], np.arange(len(self.terms) + 1))
        self.common = np.full(len(self.terms), -1, np.int32)
        often = np.flatnonzero(df > n / COMMON)
        self.common[often] = np.arange(len(often))
        self.most = np.zeros((len(often), self.blocks))
        of_run = self.common[np.repeat(np.arange(len(self.terms)), np.diff(self.head))]
        self.most[of_run[of_run >= 0], self.run_block[of_run >= 0]] = most[of_run >= 0]
        # Of the commonest terms also whole rows, for one product with all examples.
        self.dense = np.flatnonzero(df > n / 4)
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[self.dense] = np.arange(len(self.dense))
        self.rows = np.zeros((len(self.dense), self.blocks * BLOCK))
        for r, t in enumerate(self.dense.tolist()):
            lo, hi = self.start[self.head[t]], self.start[self.head[t + 1]]
            self.rows[r, self.example[lo:hi]] = self.weight[lo:hi]
        self.curve = isotonic(np.zeros(0), np.zeros(0))

    def votes(self, some: np.ndarray) -> list[float]:
        """The votes that some examples get from all others."""
        return [self._vote(self.nearest(q, without=e)) for e, q in zip(some.tolist(), self._by_example(some), strict=True)]

    def calibrate(self, votes: list[float] | None = None) -> Index:
        """Fit the curve from votes to scores on the votes of all examples."""
        self.curve = isotonic(np.array(self.votes(np.arange(len(self.ids))) if votes is None else votes, float), self.marks)
        return self

    def _by_example(self, some: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        wanted = np.flatnonzero(np.isin(self.example, some))
        term = np.searchsorted(self.start[self.head], wanted, side="right") - 1
        order = np.argsort(self.example[wanted], kind="stable")
        wanted, term = wanted[order], term[order]
        lo, hi = np.searchsorted(self.example[wanted], some, side="left"), np.searchsorted(self.example[wanted], some, side="right")
        return [(term[i:j], self.weight[wanted[i:j]]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights at unit length) of a text; words that no example holds have no weight."""
        keys, counts = term_keys(text)
        at = np.searchsorted(self.terms, keys)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == keys[known]
        raw = (1 + np.log(counts[known])) * self.worth[at[known]]
        norm = math.sqrt(float(raw @ raw))
        return at[known], raw / norm if norm else raw

    def _read(self, got: np.ndarray, term: np.ndarray, weight: np.ndarray, blocks: np.ndarray | None) -> None:
        """Add what some common terms give to the examples of some blocks, or of all (None)."""
        if blocks is None:
            row = self.row[term]
            full = np.zeros(len(self.dense))
            full[row[row >= 0]] = weight[row >= 0]
            got += np.einsum("i,ij->j", full, self.rows)
            term, weight = term[row < 0], weight[row < 0]
            for lo, hi, w in zip(self.start[self.head[term]].tolist(), self.start[self.head[term + 1]].tolist(), weight.tolist(), strict=True):
                got[self.example[lo:hi]] += self.weight[lo:hi] * w
            return
        sizes = self.head[term + 1] - self.head[term]
        runs, factor = _flat(self.head[term], sizes), np.repeat(weight, sizes)
        now = blocks[self.run_block[runs]]
        got += self._lists(self.start[runs[now]], self.start[runs[now] + 1], factor[now])

    def _lists(self, lo: np.ndarray, hi: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Sums by example over some postings, each with the query's weight of its term."""
        at = _flat(lo, hi - lo)
        return np.bincount(self.example[at], self.weight[at] * np.repeat(factor, hi - lo), minlength=self.blocks * BLOCK).astype(float, copy=False)

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine as (cosine, example), ties by id. Exact: only blocks that cannot matter are skipped."""
        term, weight = query
        if not len(term) or not self.blocks:
            return []
        number = self.common[term]
        rare, often = number < 0, number >= 0
        got = self._lists(self.start[self.head[term[rare]]], self.start[self.head[term[rare] + 1]], weight[rare])
        # Plain products: small ones gain nothing from a library that starts threads of its own in every worker.
        bound = got.reshape(-1, BLOCK).max(1) + np.einsum("i,ij->j", weight[often], self.most[number[often]])
        term, weight = term[often], weight[often]
        best, todo = np.zeros(self.blocks, bool), np.ones(self.blocks, bool)
        if self.blocks > 2 * FIRST:
            best[np.argpartition(-bound, FIRST)[:FIRST]] = True
            short = got.copy()
            self._read(got, term, weight, best)
            inside = got.reshape(-1, BLOCK)[best].ravel()
            if without >= 0 and best[without // BLOCK]:
                inside = np.delete(inside, int(best[: without // BLOCK].sum()) * BLOCK + without % BLOCK)
            least = np.partition(inside, -k)[-k] if k < len(inside) else 0.0
            todo = ~best & (bound >= least - 1e-9)
        if 3 * todo.sum() > self.blocks:  # whole lists cost less than so many parts
            got = short if best.any() else got
            self._read(got, term, weight, None)
            todo[:] = True
        else:
            self._read(got, term, weight, todo)
        seen = np.repeat(best | todo, BLOCK)
        if without >= 0:
            seen[without] = False
        got = np.round(np.where(seen, got, 0.0)[: len(self.ids)], 12)
        able = np.flatnonzero(got > 0)
        if k < len(able):
            able = able[got[able] >= np.partition(got[able], -k)[-k]]
        order = able[np.lexsort((self.ids[able], -got[able]))][:k]
        return list(zip(got[order].tolist(), order.tolist(), strict=True))

    def _vote(self, near: list[tuple[float, int]]) -> float:
        weight = sum(s * s for s, _ in near)
        return float((sum(s * s * self.marks[e] for s, e in near) + SHRINK * self.base) / (weight + SHRINK))

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """Score from 0 to 1 and the neighbours."""
        near = self.nearest(self.vector(text))
        return float(np.interp(self._vote(near), *self.curve)), near


_BAG = "doc_id long, label int, marks array<long>, terms long, keys binary, counts binary"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label and whole text to _BAG: what an index needs of a text, a row at a time."""
    for batch in batches:
        for k, t, y in zip(*batch.columns, strict=True):
            text = t.as_py()
            keys, counts = term_keys(text)
            columns = [pa.array([k.as_py()], pa.int64()), pa.array([y.as_py()], pa.int32()), pa.array([marks_of(text)], pa.list_(pa.int64())), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.astype("<i4").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "marks", "terms", "keys", "counts"])


def fit(docs: DataFrame, labels: DataFrame, keep=None, examples: int = EXAMPLES, postings: int = POSTINGS) -> Index:
    """An index of at most `examples` labelled texts (labels: doc_id, toxic) for which `keep` over doc_id holds, with at most `postings` terms in all.

    Texts are read whole, in the executors; the driver gets the terms of those that the bounds let in. An id with several texts
    is read by the smallest, an id with several labels has the smaller."""
    spark = docs.sparkSession
    ship(spark)
    picked = label_sample(labels, "toxic", examples, keep)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).where("t IS NOT NULL").join(F.broadcast(picked), "doc_id")
    # Few rows, so few tasks and files whatever the number of shuffle partitions.
    one = rows.groupBy("doc_id").agg(F.min("t").alias("t"), F.min("label").alias("label")).select("doc_id", "t", "label").coalesce(FIT_TASKS)
    bags = written(one.mapInArrow(_bags, _BAG), "bags")
    sizes = bags.select("doc_id", F.col("terms").alias("n"), F.xxhash64("doc_id", F.lit(11)).alias("h")).collect()
    total, within = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["n"]
        if total > postings:
            break
        within.append((r["doc_id"],))
    held = bags if len(within) == len(sizes) else bags.join(F.broadcast(spark.createDataFrame(within, "doc_id long")), "doc_id")
    got = sorted(held.collect(), key=lambda r: r["doc_id"])
    dropped(bags)
    pairs = [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], "<i4")) for r in got]
    index = Index.of([r["doc_id"] for r in got], np.array([r["label"] for r in got], float), pairs, distinct([r["marks"] for r in got]))
    shared = spark.sparkContext.broadcast(index)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.votes(some), pa.float64())], ["id", "vote"])

    votes = spark.range(0, len(index.ids), 1, FIT_TASKS).mapInArrow(vote, "id long, vote double").collect()
    return index.calibrate([r["vote"] for r in sorted(votes, key=lambda r: r["id"])])


SCHEMA = "doc_id long, score double, evidence array<struct<doc_id: bigint, similarity: double, toxic: int>>"


def score(docs: DataFrame, index: Index, shown: int = 3) -> DataFrame:
    """doc_id, score, evidence (the nearest `shown` examples) for every row of docs; reads nothing but the text.

    Null or empty text, and text without a known word, has no neighbours and the score of the base rate; without labels every score is 0.5. Repeated rows score
    alike, ties go to the smaller example id. Very long texts are read whole; a null doc_id stays null; other columns, whatever their names, are ignored. Empty table: no rows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            scores, evidence = [], []
            for t in batch.column(1):
                s, near = ix.score(t.as_py())
                scores.append(s)
                evidence.append([{"doc_id": int(ix.ids[e]), "similarity": c, "toxic": int(ix.marks[e])} for c, e in near[:shown]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
