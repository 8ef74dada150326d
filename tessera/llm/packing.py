"""Harmonic packing of tokenised documents into fixed-capacity training sequences.

A document that fits a sequence has the class m of its length: it is longer than C/(m+1) and at most C/m, so m documents of the class
always fit one bin, and a bin of class m is given exactly m, without any search. Documents of at most C/CLASSES tokens share the last class, whose bins
take the next document until one doesn't fit. What a bin has left over is filled with tokens of documents longer than a sequence, which have to be cut
anyway. A bin for which there are none yet waits; where too many wait, or the input ends, documents that fit are cut as well. Every task
fills its own bins: no shuffle, no shared state. What is open when a task ends is closed as full sequences and sequences whose
lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

#: Code points for which both tokenizer libraries split words alike whatever Unicode version they were built with.
_PLAIN = re.compile("[^\x00-ɏ‐-‧€]")
#: The last class. Bins that wait for filling, and sequences' worth of cut tokens held to fill them, in a task at most.
CLASSES, WAITING, STOCK = 32, 64, 16
_encoders: dict = {}


class Encoder:
    """Ids as `tokenizers` gives them for a byte-level BPE file.

    The rank file beside it holds the same vocabulary for `tiktoken`, which is several times as fast. It takes the texts
    in which nothing can differ: Latin letters and common punctuation, without the special token's string."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        try:
            ranks_file = open(path.removesuffix(".json") + ".tiktoken", "rb")
        except FileNotFoundError:
            return
        import base64

        import tiktoken

        with ranks_file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _PLAIN.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def powers(total: int) -> list[int]:
    """The powers of two that sum to total, largest first."""
    return [1 << i for i in range(total.bit_length() - 1, -1, -1) if total >> i & 1]


class Packer:
    """The bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = 2048, classes: int = CLASSES, waiting: int = WAITING, stock: int = STOCK):
        self.capacity, self.classes, self.most_waiting, self.most_stock, self.next_id = capacity, classes, waiting, stock * capacity, first_id
        self.bins: dict[int, list] = {m: [] for m in range(1, classes + 1)}
        self.last_len = 0
        self.waiting: deque[tuple[list, int]] = deque()  # (pieces, tokens of space left)
        self.stock: deque = deque()
        self.stock_len = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list, lengths: list[int]) -> None:
        """Lay pieces end to end over sequences of these lengths, cutting a piece where a sequence ends."""
        sizes = iter(lengths)
        room = next(sizes)
        at = 0
        for doc_id, start, ids, n in pieces:
            while len(ids):
                if not room:
                    self.next_id += 1
                    room, at = next(sizes), 0
                take = min(room, len(ids))
                self.out.append((doc_id, start, take, zlib.crc32(ids[:take].tobytes()), n, self.next_id, at))
                ids, start, room, at = ids[take:], start + take, room - take, at + take
        self.next_id += 1

    def _taken(self, want: int) -> list:
        """Pieces of the stock with `want` tokens, or all of it."""
        got = []
        while want and self.stock:
            doc_id, start, ids, n = self.stock.popleft()
            take = min(want, len(ids))
            got.append((doc_id, start, ids[:take], n))
            if take < len(ids):
                self.stock.appendleft((doc_id, start + take, ids[take:], n))
            want -= take
            self.stock_len -= take
        return got

    def _fill(self) -> None:
        """Fill waiting bins, the longest waiting first, while there is stock for them; then keep the stock within its bound."""
        while self.waiting and self.stock:
            pieces, space = self.waiting.popleft()
            got = self._taken(space)
            space -= sum(len(p[2]) for p in got)
            if space:
                self.waiting.appendleft((pieces + got, space))
            else:
                self._close(pieces + got, [self.capacity])
        while self.stock_len > self.most_stock:
            self._close(self._taken(self.capacity), [self.capacity])

    def _supply(self, piece: tuple) -> None:
        self.stock.append(piece)
        self.stock_len += len(piece[2])
        self._fill()

    def _full(self, pieces: list, used: int) -> None:
        """A bin that has all its documents."""
        if used == self.capacity:
            self._close(pieces, [self.capacity])
        else:
            self.waiting.append((pieces, self.capacity - used))
            self._fill()

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        piece = (doc_id, 0, ids, n)
        if n > self.capacity or len(self.waiting) >= self.most_waiting:
            self._supply(piece)
            return
        m = min(self.classes, self.capacity // n)
        if m == self.classes:
            if self.last_len + n > self.capacity:
                self._full(self.bins[m], self.last_len)
                self.bins[m], self.last_len = [], 0
            self.last_len += n
            self.bins[m].append(piece)
            return
        self.bins[m].append(piece)
        if len(self.bins[m]) == m:
            self._full(self.bins[m], sum(len(p[2]) for p in self.bins[m]))
            self.bins[m] = []

    def finish(self) -> None:
        """Close what is open: the documents of bins that have not all theirs fill those that wait, and follow each other over the rest."""
        for m, pieces in self.bins.items():
            for piece in pieces:
                self.stock.append(piece)
                self.stock_len += len(piece[2])
            self.bins[m] = []
        self.last_len, self.most_stock = 0, float("inf")
        self._fill()
        left = [p for pieces, _ in self.waiting for p in pieces] + self._taken(self.stock_len)
        self.waiting.clear()
        if total := sum(len(p[2]) for p in left):
            self._close(left, [self.capacity] * (total // self.capacity) + powers(total % self.capacity))

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[] for _ in _ARROW]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack every document (doc_id, text) into sequences; one row per piece (SCHEMA).

    A document's ids are the tokenizer file's, then end_id. Null or empty text: end_id alone. Repeated rows are packed once each;
    a null doc_id stays null. A very long text is cut over many sequences; documents that fit one are cut only where no longer document's tokens are there to
    fill their bins. Documents of the same length follow each other as read. Other columns, whatever their names, are ignored. An empty table gives no rows. Sequence ids are unique, offsets within one are gapless from 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.array([*(enc.ids(text) if text else ()), end_id], dtype="<u4")
                packer.add(doc_id, ids)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
