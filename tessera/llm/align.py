"""Token alignment of two tokenizers over the same bytes, and how often each pair of ids is linked in a corpus.

The byte ends of both token rows, united (union1d), cut a text into elementary intervals; searchsorted names the token of either side that owns an interval, so
each interval is one overlap. Where an end is shared a group closes, and all pairs of a group's tokens are linked: its product is expanded.

A space between two letters or signs ends a token of both tokenizers, so a text is a row of units (words with the space before them) that are aligned by
themselves. A task aligns its new units together, in one pass over their joined ends, and remembers them. A pair's count is the number of documents that
hold it: the most frequent pairs, a bounded number, travel to every task; those beyond are joined on their key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import _PLAIN
from tessera.llm.sampling import heaviest
from tessera.shipping import ship
from tessera.sources.store import written

#: Pairs whose counts are sent to every task; units that a worker remembers; documents that are aligned together.
HEAD, UNITS, TOGETHER = 1 << 17, 1 << 19, 256
#: Characters between which a single space ends a token in both tokenizers.
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_SIMPLE = re.compile("[!-~À-ɏ]+")
_INNER = re.compile("[!-~À-ɏ](?s:.*[!-~À-ɏ])?")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def byte_of_sign() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte: itself where it is one, the next free sign from 256 on elsewhere."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A, a byte-level BPE file, and B, a piece model that puts a space before a text; and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        signs = byte_of_sign()
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        self.a_size, self.b_size = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)]
        # Ids as text, and what follows them within a group (first half) and at the end of a side.
        self.written = [np.array([f"{i}{e}" for e in ends for i in range(n)], object) for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))]
        # A piece that holds a space after another sign could reach from one unit into the next.
        self.apart = not any("▁" in p.lstrip("▁") for p in names)
        self.fast = _ranked(a_path)

    def a(self, text: str) -> list[int]:
        if self.fast is None or _PLAIN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def units(self, text: str) -> list[str]:
        """The text, which a space precedes, cut at the spaces where both tokenizers always cut."""
        return _CUT.split(text) if self.apart else [text]


def _ranked(path: str):
    """The same vocabulary for the faster library, from the rank file beside it, if there is one."""
    import base64

    import public_tokenizers
    import tiktoken

    try:
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    except FileNotFoundError:
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group, the number of A and of B tokens up to its end. Both rows of ends ascend and have the same last value."""
    bounds = np.union1d(a_ends, b_ends)
    a_owner, b_owner = np.searchsorted(a_ends, bounds), np.searchsorted(b_ends, bounds)
    closed = (a_ends[a_owner] == bounds) & (b_ends[b_owner] == bounds)
    return a_owner[closed] + 1, b_owner[closed] + 1


def expanded(a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of A and B of all pairs, group by group, and each pair's group."""
    a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
    wide, sizes = b_to - b_from, (a_to - a_from) * (b_to - b_from)
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a_from[group] + at // wide[group], b_from[group] + at % wide[group], group


class Aligned:
    """Aligned units: numbers by unit, and pair codes (A id * width + B id), unit after unit."""

    def __init__(self, tok: Tokenizers, texts: list[str]):
        simple, others = [], []
        for t in texts:
            (simple if _SIMPLE.fullmatch(t) else others).append(t)
        self.texts = simple + others
        sides = [_together(tok, simple) or _apart(tok, simple), _apart(tok, others)]
        a_ids, b_ids = np.concatenate([x[0] for x in sides]), np.concatenate([x[1] for x in sides])
        n_a, n_b = np.concatenate([x[2] for x in sides]), np.concatenate([x[3] for x in sides])
        # An odd unit has no tokens here; who meets it looks at the whole text.
        self.odd = np.concatenate([x[4] for x in sides])
        self.a_ids, self.b_ids, self.n_a, self.n_b = a_ids, b_ids, n_a, n_b
        none = np.zeros(0, np.int64)
        self.a_to, self.b_to = groups_of(np.cumsum(tok.a_size[a_ids]), np.cumsum(tok.b_size[b_ids])) if len(a_ids) else (none, none)
        last = np.searchsorted(self.a_to, np.cumsum(n_a), "right")  # groups up to a unit's end: a unit's last byte closes one
        self.n_groups = np.diff(last, prepend=0)
        x, y, group = expanded(self.a_to, self.b_to) if len(self.a_to) else (none, none, none)
        self.codes = a_ids[x] * len(tok.b_bytes) + b_ids[y]
        self.n_links = np.diff(np.searchsorted(group, last), prepend=0)

    def spelled(self, tok: Tokenizers) -> list[str]:
        """Each unit's groups as text: A ids, a bar, B ids; groups apart by semicolons."""
        a, b = np.arange(len(self.a_ids)), np.arange(len(self.b_ids))
        a_group, b_group = np.searchsorted(self.a_to, a, "right"), np.searchsorted(self.b_to, b, "right")
        signs = np.empty(len(a) + len(b), object)
        a_last, b_last = self.a_to[a_group] == a + 1, self.b_to[b_group] == b + 1
        signs[a + np.concatenate([[0], self.b_to])[a_group]] = tok.written[0][self.a_ids + a_last * len(tok.a_bytes)]
        signs[b + self.a_to[b_group]] = tok.written[1][self.b_ids + b_last * len(tok.b_bytes)]
        flat, at, out = signs.tolist(), 0, []
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(flat[at : at + n])[:-1])
            at += n
        return out


def _together(tok: Tokenizers, units: list[str]):
    """The units, none of which holds a space, encoded as one text, where each ends where the next begins; None if that isn't so."""
    if not units or not tok.apart:
        return None
    joined = " ".join(units)
    a, b = np.array(tok.a(" " + joined), np.int64), np.array(tok.pieces.encode(joined, num_threads=1), np.int64)
    raw = (" " + joined).encode()
    if b"".join([tok.a_bytes[i] for i in a.tolist()]) != raw or b"".join([tok.b_bytes[i] for i in b.tolist()]) != raw:
        return None
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw))
    a_ends, b_ends = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
    a_to, b_to = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    if (a_ends[a_to] != ends).any() or (b_ends[b_to] != ends).any():
        return None
    return a, b, np.diff(a_to + 1, prepend=0), np.diff(b_to + 1, prepend=0), np.zeros(len(units), bool)


def _apart(tok: Tokenizers, units: list[str]):
    """The units encoded one by one."""
    a, b = [tok.a(" " + t) for t in units], tok.pieces.encode(units, num_threads=1)
    odd = [not (b"".join([tok.a_bytes[i] for i in x]) == (" " + t).encode() == b"".join([tok.b_bytes[i] for i in y])) for x, y, t in zip(a, b, units, strict=True)]
    a, b = [[] if o else x for x, o in zip(a, odd, strict=True)], [[] if o else y for y, o in zip(b, odd, strict=True)]
    flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
    return *flat, *[np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)], np.array(odd, bool)


class Memory:
    """The units that a worker has aligned, as rows of arrays; forgotten together when there are too many."""

    FIELDS = ("n_a", "n_b", "n_groups", "n_links", "odd")

    def __init__(self, tok: Tokenizers, most: int = UNITS):
        self.tok, self.most = tok, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.table = {f: np.zeros(0, np.int64) for f in self.FIELDS}
        self.codes, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, texts: list[str]) -> None:
        new = Aligned(self.tok, texts)
        self.known.update(zip(new.texts, range(len(self.known), len(self.known) + len(texts)), strict=True))
        self.groups += new.spelled(self.tok)
        self.table = {f: np.concatenate([v, getattr(new, f).astype(np.int64)]) for f, v in self.table.items()}
        self.codes = np.concatenate([self.codes, new.codes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(new.n_links)])

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units' rows, text after text, and where each text's units end. A text whose bytes are not both tokenizers' has no units."""
        if len(self.known) > self.most:
            self.clear()
        # Most texts may be cut at every space; those with a part that begins or ends in another sign are cut again, with care.
        units = [t.split(" ") if t else [] for t in texts]
        parts = set().union(*units)
        unsafe = {u for u in parts if u not in self.known and not _INNER.fullmatch(u)} if self.tok.apart else parts
        for i, x in enumerate(units):
            if not unsafe.isdisjoint(x):
                units[i] = self.tok.units(texts[i])
        self._need(set().union(*units))
        rows = [list(map(self.known.__getitem__, x)) for x in units]
        if self.table["odd"].any():
            for i in [i for i, x in enumerate(rows) if self.table["odd"][x].any()]:
                self._need({texts[i]})
                whole = self.known[texts[i]]
                rows[i] = [] if self.table["odd"][whole] else [whole]
        return np.fromiter(chain.from_iterable(rows), np.int64), np.cumsum([len(x) for x in rows])

    def _need(self, units: set[str]) -> None:
        if new := [u for u in units if u not in self.known]:
            self._learn(new)

    def pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of these units, and which of the given rows each belongs to."""
        sizes = self.table["n_links"][rows]
        of = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.codes[self.starts[rows][of] + at], of


_memories: dict[tuple[str, str], Memory] = {}


def memory(a_path: str, b_path: str) -> Memory:
    """One per worker process and pair of files."""
    if (a_path, b_path) not in _memories:
        _memories[a_path, b_path] = Memory(Tokenizers(a_path, b_path))
    return _memories[a_path, b_path]


def _summed(of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by place; exact, as long as they are below 2**53."""
    return np.bincount(of, values, size).astype(np.int64)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _held(mem: Memory, rows: np.ndarray, of_text: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
    """For each text the codes of its linked pairs, ascending, and how often it has them."""
    units = max(1, len(mem.known))
    unit = np.sort(of_text * units + rows)
    first = _first(unit)
    unit, often = unit[first], np.diff(np.append(first, len(unit)))
    code, of = mem.pairs(unit % units)
    text = (unit // units)[of]
    order = np.lexsort((code, text))
    code, text, often = code[order], text[order], often[of][order]
    first = _first(text, code)
    times = np.add.reduceat(often, first) if len(first) else often
    offsets = pa.array(np.searchsorted(text[first], np.arange(size + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(code[first])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For every row of docs: doc_id (long), n_a, n_b, n_groups, n_links, groups, codes, times.

    groups is the alignment as text: `a1,a2|b1;a3|b2,b3`. codes are the linked pairs of ids (A id * B's size + B id), ascending, times how often each is linked in the text. Null or empty text,
    or one that a tokenizer does not give back byte for byte: zeros, an empty text and empty lists. Repeated rows are equal; a null doc_id stays null;
    a text of any length is aligned whole. Other columns, whatever their names, are ignored. Empty table: no rows."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem = memory(a_path, b_path)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                rows, ends = mem.rows(batch.column(1).to_pylist())
                of_text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                numbers = [_summed(of_text, mem.table[f][rows], len(ends)) for f in ("n_a", "n_b", "n_groups", "n_links")]
                spelled = list(map(mem.groups.__getitem__, rows.tolist()))
                texts = [";".join(spelled[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers), pa.array(texts, pa.string()), *_held(mem, rows, of_text, len(ends))], names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, codes array<long>, times array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(code, docs): for each linked pair of ids the number of rows that hold it. Counted within each task before the shuffle; repeated rows count once each."""
    return aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("docs"))


def _looked_up(keys: np.ndarray, values: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The values of codes among ascending keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(code), np.int64)
    at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
    return np.where(keys[at] == code, values[at], 0)


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def _column(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.toArrow()
    return [table[n].to_numpy() for n in names]


def counted(aligned: DataFrame, b_path: str, head: int = HEAD, **keep: Column) -> DataFrame:
    """For every row of align(): its numbers, n_best and count_sum, and the columns of `keep` in place of the alignment.

    A pair's count is the number of rows that hold it. count_sum adds the counts of all a row's links; n_best is how many of them count as much as any pair of the same A id.
    At most `head` most frequent pairs and the best count of each A id (the vocabulary bounds these) travel to every task; what they leave over is joined by
    code, and none of its pairs is frequent, so no key is hot."""
    spark = aligned.sparkSession
    ship(spark)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    rows = written(aligned.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *numbers, *[c.alias(k) for k, c in keep.items()], "codes", "times"), "aligned")
    counts = written(link_counts(rows), "links")
    size = _pieces(b_path)
    best = counts.groupBy(F.expr(f"code div {size}").alias("a")).agg(F.max("docs").alias("most"))
    keys, values = _column(heaviest(counts, "docs", head), "code", "docs")
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], values[order], *_column(best, "a", "most")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, a, most = shared.value
        best = np.zeros(int(a.max(initial=0)) + 1, np.int64)
        best[a] = most
        for batch in batches:
            lists = batch.column(1)
            code, times, n = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy(), batch.num_rows
            of = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
            found = _looked_up(keys, values, code)
            left = found == 0
            offsets = pa.array(np.searchsorted(of[left], np.arange(n + 1)).astype(np.int32))
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(code[left]), pa.array(times[left].astype(np.int64))], ["code", "n"]))
            hits = times * (~left & (found == best[code // size]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_summed(of, hits, n)), pa.array(_summed(of, times * found, n)), rest], ["_row", "n_best", "count_sum", "rest"])

    links = rows.select("_row", "codes", "times").mapInArrow(run, "_row long, n_best long, count_sum long, rest array<struct<code long, n long>>")
    rest = links.select("_row", F.explode("rest").alias("x")).select("_row", "x.code", "x.n", F.expr(f"x.code div {size}").alias("a")).join(counts, "code").join(best, "a")
    rest = rest.select("_row", F.when(F.col("docs") == F.col("most"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("docs")).alias("count_sum"))
    sums = links.drop("rest").unionByName(rest).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("codes", "times").join(sums, "_row").select("doc_id", *numbers, "n_best", "count_sum", *keep)
