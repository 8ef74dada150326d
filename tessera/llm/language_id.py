"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed against each automaton into phrases, each the longest
match with the labelled text from where the last one ended; phrases times log2 of the labelled length, per byte, estimate the cross
entropy (Ziv and Merhav 1993). The language that needs the fewest normalised phrases wins.

The automaton with its restarts is one dense table (state, byte) -> (state, did a phrase end), so a batch of texts runs through
all languages in lockstep, one table lookup per byte and language. Labelled text is bounded, and so is the broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import carried, text_column
from tessera.shipping import ship

#: Bytes of labelled text for a language, and for all languages together, at most.
EACH, ALL = 32_768, 1 << 20
#: Languages to learn at most: those with the most labelled texts, so that a noisy lang column bounds the model too. More than are written; they share ALL.
LANGS = 4096
#: Texts drawn from a language at first, times what would fill it if they were average; parts in which a language's excerpts are merged.
DRAWN, PARTS = 16, 32
#: Characters taken from one labelled text, so that a language's text comes from several.
EXCERPT = 4096
#: How sharply the score falls with the distance in bits a byte.
SHARPNESS = 6.0
UNKNOWN = "und"
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_RUNS = re.compile(rb"  +")


def normal(text: str | None) -> bytes:
    """Lower-case UTF-8 in which runs of other ASCII characters than letters are one space; empty without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return _RUNS.sub(b" ", text.lower().encode("utf-8", "replace").translate(_FOLD)).strip()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions by state (0 is the root) of the automaton of all substrings of text."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = now
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return nexts


class Model:
    """Languages, their labelled lengths, and one table of all their automata with restarts."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(k for k, v in texts.items() if v)
        self.bits = np.array([math.log2(max(2, len(texts[k]))) for k in self.langs])
        used = sorted(set().union(*[texts[k] for k in self.langs]))
        self.symbol = np.zeros(256, np.uint8)  # 0: a byte that no language has
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        tables, self.roots, base = [], [], 0
        for k in self.langs:
            nexts = suffix_automaton(texts[k])
            go = np.full((len(nexts), self.width), -1, np.int64)
            for s, out in enumerate(nexts):
                if out:
                    go[s, self.symbol[list(out)]] = list(out.values())
            restart = np.where(go[0] >= 0, go[0], 0)
            to = np.where(go >= 0, go, restart) + base
            tables.append(((to * self.width) << 1 | (go < 0)).astype(np.int32))
            self.roots.append(base * self.width)
            base += len(nexts)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language; the last, open one counts."""
        n, langs = len(texts), len(self.langs)
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        flat = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])[order] if n else np.zeros(0, np.int64)
        sorted_size = size[order]
        state = np.tile(np.array(self.roots, np.int32), (n, 1))
        count = np.zeros((n, langs), np.int32)
        longest = int(sorted_size[0]) if n else 0
        active = np.searchsorted(-sorted_size, -np.arange(longest), side="left")  # texts longer than t
        t = 0
        while t < longest and (k := active[t]) * langs >= 48:
            got = self.table[state[:k] + flat[starts[:k] + t][:, None]]
            count[:k] += got & 1
            state[:k] = got >> 1
            t += 1
        if t < longest:  # few long texts are left: a plain loop for each
            table = memoryview(self.table)
            for i in range(int(active[t])):
                rest = flat[starts[i] + t : starts[i] + sorted_size[i]].tolist()
                for j in range(langs):
                    s, c = int(state[i, j]), 0
                    for b in rest:
                        got = table[s + b]
                        c += got & 1
                        s = got >> 1
                    count[i, j] += c
        out = np.empty_like(count)
        out[order] = count + 1
        return out

    def rates(self, texts: list[bytes]) -> np.ndarray:
        """Bits a byte by language."""
        return self.phrases(texts) * self.bits / np.maximum(1, [len(t) for t in texts])[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score each; UNKNOWN and 0 where nothing can be said."""
        plain = [normal(t) for t in texts]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(plain) if t]
        if rows and self.langs:
            rate = self.rates([plain[i] for i in rows])
            best = rate.argmin(1)
            weight = np.exp(-SHARPNESS * (rate - rate.min(1, keepdims=True)))
            score[rows] = 1 / weight.sum(1)
            for i, b in zip(rows, best, strict=True):
                lang[i] = self.langs[b]
        return lang, score


def fit(docs: DataFrame, keep: Column) -> Model:
    """A model from labelled rows of docs (doc_id, text, lang) for which `keep` holds: at most LANGS languages, EACH bytes of each, ALL of all.

    A text gives at most EXCERPT characters, from a hashed place anywhere in it; copies of a text give theirs once. Excerpts are taken in the order of a hash until a language has its
    bytes, from a draw of its texts; where that doesn't fill it (short texts, or texts without letters), from all of them. That is the last pass. Executors normalise and
    merge; ALL bytes at most come to the driver."""
    ship(docs.sparkSession)
    labelled = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.least(F.length("text"), F.lit(EXCERPT))).alias("size")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    each = min(EACH, ALL // max(1, len(sizes)))
    shares = {r["lang"]: min(1.0, (DRAWN * math.ceil(each / max(1, r["size"])) + 2 * DRAWN) / r["n"]) for r in sizes}
    texts = _drawn(labelled, shares, each)
    if left := {k: 1.0 for k, share in shares.items() if share < 1 and len(texts.get(k, b"")) < each}:
        texts |= _drawn(labelled, left, each)
    return Model(texts)


def _drawn(labelled: DataFrame, shares: dict[str, float], each: int) -> dict[str, bytes]:
    """Up to `each` bytes of excerpts by language, from a hash draw of its share of the texts.

    A task keeps no more of a language than it can give, and nor do the tasks that merge: by language and part of the hash, then by language."""
    if not shares:
        return {}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, int(v * (1 << 30)))])
    # Copies of a text give the same excerpt.
    start = F.pmod(F.xxhash64("text", F.lit(9)), F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int") + 1
    picked = labelled.where(draw < share[F.col("lang")]).select("lang", draw.alias("h"), F.col("text").substr(start, F.lit(EXCERPT)).alias("t"))

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept(((k, h, normal(t)) for b in batches for k, h, t in zip(*[b.column(n).to_pylist() for n in ("lang", "h", "t")], strict=True)), each)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept((r for b in batches for r in zip(*[b.column(n).to_pylist() for n in ("lang", "h", "t")], strict=True)), each)

    schema = "lang string, h long, t binary"
    found = picked.mapInArrow(normalised, schema)
    found = found.groupBy("lang", F.pmod(F.xxhash64("t"), F.lit(PARTS))).applyInArrow(merged, schema).groupBy("lang").applyInArrow(merged, schema)
    texts: dict[str, bytes] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"], r["t"])):
        texts[r["lang"]] = (texts.get(r["lang"], b"") + b" " + bytes(r["t"]))[:each]
    return texts


def _kept(rows: Iterable[tuple[str, int, bytes]], each: int) -> Iterator[pa.RecordBatch]:
    """Of each language the texts of the smallest hashes, each once with the smallest of its copies, as many as give `each` bytes; never much more is held."""
    held: dict[str, dict[bytes, int]] = {}
    size: dict[str, int] = {}

    def first(lang: str) -> list[tuple[int, bytes]]:
        got, total = [], 0
        for h, t in sorted((h, t) for t, h in held[lang].items()):
            if total >= each:
                break
            got.append((h, t))
            total += len(t) + 1
        held[lang], size[lang] = {t: h for h, t in got}, total
        return got

    for lang, h, t in rows:
        if not t:
            continue
        mine = held.setdefault(lang, {})
        if t in mine:
            mine[t] = min(h, mine[t])
            continue
        mine[t] = h
        size[lang] = size.get(lang, 0) + len(t) + 1
        if size[lang] > 4 * each + EXCERPT:
            first(lang)
    for lang in held:
        some = first(lang)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([h for h, _ in some], pa.int64()), pa.array([t for _, t in some], pa.binary())], ["lang", "h", "t"])


def identify(docs: DataFrame, model: Model, carry: Column | None, name: str) -> DataFrame:
    """`carry` (or the whole row) as `name`, lang_pred, score for every row of docs; reads nothing but text.

    Null text or no letter: und, score 0; so is every text when no language was learned. Repeated rows and ties (the
    alphabetically first language) give equal results; very long texts are parsed whole; a null id stays null. With `carry` other columns are
    ignored, without it they travel inside the row's struct, so no name can clash. Empty table: no rows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lang, score = shared.value.predict(text_column(part).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], [name, "lang_pred", "score"])

    rows = carried(docs, carry, name)
    return rows.mapInArrow(run, f"`{name}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs with a language that wins by more than half of the score, with all their columns, whatever their names.

    Null texts and texts without a letter go; rows with a null doc_id are judged by their text; repeated rows stay or go together. Very long texts and ties: as
    in identify(). Empty table, or no language learned: no rows."""
    rows = identify(docs, model, None, "row")
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
