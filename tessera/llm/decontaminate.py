"""Benchmark decontamination by greedy string tiling.

Texts become lower-case word tokens; a script that writes no spaces gives a token for each character. A Karp-Rabin hash that runs over SEED tokens joins a
document with the test items that share a seed. For each such pair the longest common runs of tokens that are still unmarked are marked as tiles, again and again
(Wise 1993), so a reordered or edited passage still gives its pieces. The share of an item's tokens under tiles is its
coverage; at THRESHOLD the document is contaminated. An item shorter than a seed is its own seed: it has to stand in the document whole.

Pairs of seed positions are joined into runs where there are few of them; where a text repeats itself and they would grow with the product of both lengths, hashes over
runs of other lengths find the longest match instead. Both give the same tiles.

The items travel to the documents in blocks of bounded size, each a broadcast; documents are never shuffled or compared with each other.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import carried, text_column
from tessera.shipping import ship
from tessera.sources.store import written

#: Tokens of a seed, so of the shortest tile of an item that has as many.
SEED = 5
#: Share of an item's tokens under tiles from which a document counts as contaminated.
THRESHOLD = 0.5
#: Characters of test items in one broadcast; a worker's index of them takes some 100 MB.
BLOCK_CHARS = 24_000_000

#: Pairs of seed positions are enumerated while there are at most this many a token of text and item.
PAIRS = 16
#: Letters of scripts that write no spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_SPACED_TOKEN, _TOKEN = re.compile(r"\w+"), re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_BASE = 0x9E3779B97F4A7C15
_TABLE_BITS = 20


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return (_SPACED_TOKEN if text.isascii() or not _ANY_UNSPACED.search(text) else _TOKEN).findall(text.lower())


def running_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` values, modulo 2^64."""
    n = len(values) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_BASE)
        out += values[k : k + n]
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def tiles(item: list, text: list, seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, length) for seed hits (text position, item position): longest first, ties by
    item then text position; no token of either side is in two tiles."""
    diagonals: dict[int, list[int]] = defaultdict(list)
    for i, j in seeds:
        if text[i : i + size] == item[j : j + size]:
            diagonals[i - j].append(i)
    queue = []
    for d, at in diagonals.items():
        at.sort()
        start = prev = at[0]
        for i in [*at[1:], None]:
            if i is None or i > prev + 1:
                queue.append((start - prev - size, start - d, start))
                start = i
            prev = i
    heapq.heapify(queue)
    in_item, in_text, out = bytearray(len(item)), set(), []
    while queue:
        neg, j, i = heapq.heappop(queue)
        free, run = [], 0
        for k in range(-neg + 1):
            if k < -neg and not in_item[j + k] and i + k not in in_text:
                run += 1
                continue
            if run >= size:
                free.append((k - run, run))
            run = 0
        if free == [(0, -neg)]:
            out.append((j, i, -neg))
            in_item[j : j - neg] = b"\1" * -neg
            in_text.update(range(i, i - neg))
        else:
            for k, run in free:
                heapq.heappush(queue, (-run, j + k, i + k))
    return out


class _Prefixes:
    """Hashes of all runs of any length of some values, modulo 2^64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:-1], dtype=np.uint64)])
        self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]))

    def runs(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.back[starts]


def running_tiles(item: np.ndarray, text: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """tiles() from token values alone, in time that the lengths bound whatever the number of seed pairs.

    The greatest length at which an unmarked run of both sides has the same hash is found by halving; all tiles of that length are
    taken in one sweep, then the next length is looked for."""
    sides = [(_Prefixes(v), np.zeros(len(v), bool), v) for v in (item, text)]

    def free(marks: np.ndarray, length: int) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(marks)])
        return np.flatnonzero(before[length:] == before[:-length]) if length <= len(marks) else np.zeros(0, np.int64)

    def hashed(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for prefixes, marks, _ in sides:
            starts = free(marks, length)
            out.append((starts, prefixes.runs(starts, length)))
        return out

    def common(length: int) -> bool:
        (_, a), (_, b) = hashed(length)
        return bool(len(a) and len(b) and np.isin(a, b).any())

    out: list[tuple[int, int, int]] = []
    high = min(len(item), len(text))
    while high >= size and common(size):
        low = size
        while low < high:  # the greatest length is within [low, high]
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        (at_item, a), (at_text, b) = hashed(low)
        order = np.argsort(b, kind="stable")
        b, at_text = b[order], at_text[order]
        first, end = np.searchsorted(b, a, side="left"), np.searchsorted(b, a, side="right")
        hit = first < end
        reached: dict[int, int] = {}
        (_, in_item, _), (_, in_text, _) = sides
        for j, f, e in zip(at_item[hit].tolist(), first[hit].tolist(), end[hit].tolist(), strict=True):
            if in_item[j : j + low].any():
                continue
            at = reached.get(f, f)
            while at < e and in_text[at_text[at] : at_text[at] + low].any():
                at += 1
            reached[f] = at
            if at < e and np.array_equal(item[j : j + low], text[at_text[at] : at_text[at] + low]):
                i = int(at_text[at])
                out.append((j, i, low))
                in_item[j : j + low] = in_text[i : i + low] = True
        high = low - 1
    return out


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers from a to below b of each pair, one after the other."""
    sizes = b - a
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - ends + sizes, sizes)


def _rare(item: np.ndarray, place: np.ndarray, often: np.ndarray, lengths: np.ndarray, size: int, threshold: float) -> np.ndarray:
    """Which seeds of items (item, place, in order; how often the seed stands in all items) a covered item must have one of in common with the text.

    The other seeds of an item are its most frequent ones, as many levels of frequency as cover less than the threshold of its tokens together: an item that shares
    only those is not covered."""
    level = np.frexp(often.astype(np.float64))[1]
    rare = np.ones(len(item), bool)
    open_ = np.ones(len(lengths), bool)  # items whose frequent seeds do not cover the threshold yet
    for least in sorted(set(level.tolist()), reverse=True):
        frequent = np.flatnonzero(level >= least)
        of, at = item[frequent], place[frequent]
        step = np.where(np.diff(of, append=-1) == 0, np.minimum(np.diff(at, append=0), size), size)
        open_ &= np.bincount(of, step, len(lengths)) < threshold * lengths
        rare[(level == least) & open_[item]] = False
    return rare


class Seeds:
    """Some test items (id, word hashes) by the seeds of one size that are rare among them, as sorted arrays: 12 bytes a rare seed and 8 a token. Hashes are those of this
    process, so seeds are built where they are used.

    A text's candidates are the items of which it has a rare seed; each is then looked at with all its seeds. A stem that very many items share costs nothing."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int):
        self.size, self.keys, self.values = size, [k for k, _ in items], [v for _, v in items]
        self.rare: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _rare(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of rare seeds, sorted, their items, and a table of the first bits of the hashes."""
        if threshold not in self.rare:
            hashes = [running_hash(v, self.size) for v in self.values]
            counts = np.array([len(h) for h in hashes], np.int64)
            item = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            place = _numbers(np.zeros_like(counts), counts).astype(np.int32)
            every = np.concatenate([np.zeros(0, np.uint64), *hashes])
            _, which, times = np.unique(every, return_inverse=True, return_counts=True)
            kept = _rare(item, place, times[which], np.array([len(v) for v in self.values], np.int64), self.size, threshold)
            every, item = every[kept], item[kept]
            order = np.argsort(every, kind="stable")
            some = np.zeros(1 << _TABLE_BITS, bool)
            some[every >> np.uint64(64 - _TABLE_BITS)] = True
            self.rare[threshold] = every[order], item[order], some
        return self.rare[threshold]

    def matches(self, values: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        known, owners, some = self._rare(threshold)
        hashes = running_hash(values, self.size)
        seen = np.unique(hashes[some[hashes >> np.uint64(64 - _TABLE_BITS)]])
        lo, hi = np.searchsorted(known, seen, side="left"), np.searchsorted(known, seen, side="right")
        candidates = np.unique(owners[_numbers(lo, hi)])
        if not len(candidates):
            return
        every, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        by_hash = np.argsort(back, kind="stable")
        starts = np.concatenate([[0], np.cumsum(times)])
        for c in candidates.tolist():
            key, item = self.keys[c], self.values[c]
            own = running_hash(item, self.size)
            of = np.minimum(np.searchsorted(every, own), len(every) - 1)
            place = np.flatnonzero(every[of] == own)
            of = of[place]
            # What the seeds cover at most, marked or not.
            if np.minimum(np.diff(place, append=place[-1] + self.size), self.size).sum() < threshold * len(item):
                continue
            if int(times[of].sum()) <= PAIRS * (len(item) + len(values)):
                where = by_hash[_numbers(starts[of], starts[of + 1])]
                found = tiles(item.tolist(), values.tolist(), list(zip(where.tolist(), np.repeat(place, times[of]).tolist(), strict=True)), self.size)
            else:
                found = running_tiles(item, values, self.size)
            tiled = sum(t[2] for t in found)
            if tiled and tiled >= threshold * len(item):
                yield key, len(item), tiled, len(found), tiled / len(item)


class Index:
    """Test items by the size of their seeds."""

    def __init__(self, items: list[tuple[int, str]], size: int = SEED):
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for k, t in items:
            if words := tokens(t):
                by_size[min(size, len(words))].append((k, word_hashes(words)))
        self.seeds = [Seeds(found, n) for n, found in sorted(by_size.items())]

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(item id, item tokens, tiled tokens, tiles, coverage) for each item covered to the threshold."""
        values = word_hashes(tokens(text))
        return sorted(m for seeds in self.seeds for m in seeds.matches(values, threshold))


_indexes: dict[tuple[int, int, int], Index] = {}


def index_of(items: list[tuple[int, str]], size: int) -> Index:
    """The index of the block that a worker process reads now; it holds no other."""
    key = (zlib.crc32(repr(items).encode("utf-8", "replace")), len(items), size)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items, size)
    return _indexes[key]


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The test items (item_id, text) in blocks of about `most` characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // most))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted((r[0], r[1]) for r in part.collect())


_HIT = pa.struct([("item_id", pa.int64()), ("item_tokens", pa.int64()), ("tiled_tokens", pa.int64()), ("tiles", pa.int64()), ("coverage", pa.float64())])
_HIT_SQL = "array<struct<item_id: bigint, item_tokens: bigint, tiled_tokens: bigint, tiles: bigint, coverage: double>>"


def _with_hits(docs: DataFrame, items: list[tuple[int, str]], carry: Column | None, name: str, size: int, threshold: float) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = _HIT.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(shared.value, size)
        for batch in batches:
            hits = [[dict(zip(names, h, strict=True)) for h in index.matches(t.as_py(), threshold)] for t in text_column(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(_HIT))], [name, "hits"])

    rows = carried(docs, carry, name)
    return rows.mapInArrow(run, f"`{name}` {rows.schema[0].dataType.simpleString()}, hits {_HIT_SQL}")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_tokens, tiled_tokens, tiles, coverage: a row for each document and test item that it covers to the threshold.

    Null texts and texts without a word have no rows, nor have items with null id, null text or no word. An item of fewer tokens than a seed is found where it stands
    whole. A null doc_id stays null. Repeated documents give a row each, repeated items one. Very long texts are tiled whole, repetitive ones in near-linear time. Ties between
    tiles go by position. Other columns, whatever their names, are ignored. Either table empty: no rows."""
    out = None
    for items in blocks(benchmark):
        part = _with_hits(docs, items, F.col("doc_id").cast("long"), "doc_id", size, threshold).select("doc_id", F.inline("hits"))
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that cover no test item to the threshold, with all their columns, whatever their names.

    Null texts, texts without a word and rows with a null doc_id are judged by their text alone; repeated rows are kept or dropped together. Items, very
    long texts and ties: as in contaminated(). Benchmark empty: all rows; docs empty: none. Of several blocks of items each has a pass of its own over what the last one left, which
    is written in between, so that a task never holds two indexes."""
    left = 0
    for items in blocks(benchmark):
        docs = _with_hits(written(docs, "clean") if left else docs, items, None, "row", size, threshold).where(F.size("hits") == 0).select("row.*")
        left += 1
    return docs
