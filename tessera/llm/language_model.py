"""Log-probabilities of whole documents under a gated recurrent language model with a class-factored output.

A token's probability is that of its class, given the state, times that of the token within its class. Frequent words (FREQUENT of them) stand in classes of similar weight
and have a softmax of their own given the state. All other words stand in classes by their last bytes, where a word's share is its add-0.1 estimate from the counts of all training
tokens, with one place for what was never seen. So every word of the corpus counts, the network stays small, and probabilities sum to one.

The network learns in numpy by backpropagation truncated to windows, the state carried on from one window to the next: shards train apart in the
executors, and their weights are averaged. A few rounds over a bounded sample give the starting weights; from these every training text is learned, whole. To score, a task lays its documents end to end in lanes that run in lockstep; the state is
reset where a document begins and carried across windows, however long the document is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import heaviest
from tessera.shipping import ship
from tessera.sources.store import dropped, written

#: Words whose counts every task knows; those with an output of their own; their classes, and the classes of all other words.
WORDS, FREQUENT, CLASSES, ENDINGS = 1 << 18, 2048, 32, 64
#: Bytes at a word's end that say its class.
ENDING = 3
#: Size of the state.
STATE = 24
#: For the starting weights: training documents (on average), characters of each at most, shards, rounds, and tokens of a shard a round at most.
SAMPLE, EXCERPT, SHARDS, ROUNDS, TOKENS = 4000, 20_000, 4, 3, 200_000
#: Lanes and steps of a training window; step size.
LANES, STEPS, RATE = 64, 16, 0.15
#: Documents to a shard of all (on average), lanes of a window there at most, and parts in which weights are averaged.
APART, WIDE, PARTS = 4096, 512, 16
#: What is added to each count.
ADDED = 0.1
#: Words of a task that are counted together, at least; tokens of a scoring window, and of the texts whose lanes run together, at 4 bytes each (a longer text runs with those before it).
COUNTED, WINDOW, TOGETHER = 1 << 21, 1 << 15, 1 << 22
#: Tokens whose logits are worked on together, so that they stay near the processor.
ROWS = 1024
#: A row of the input table that stands in a window more often than this is a frequent one; sums of gradients are tested beyond it.
OFTEN = 12
#: How far apart the bounds of a softmax's largest logit may be, for its exponentials to need no maximum of their row.
SAFE = 60.0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, apart by ASCII white space."""
    return text.translate(_LOWER).split() if text else []


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words() of many texts, one text's behind another's, and how many each has; without a Python object a word."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, offsets = found.flatten(), found.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    if not len(full) or pc.all(full).as_py():
        return flat.cast(pa.binary()), np.diff(offsets)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full).cast(pa.binary()), np.diff(upto[offsets - offsets[0]])


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in order, about TOGETHER words at once; a longer text goes with those before it."""
    if len(texts):
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // (4 * TOGETHER)
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for start, end in zip([0, *ends], ends, strict=False):
            yield texts.slice(start, end - start)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    found = batch.column(column)
    return found.cast(pa.large_binary() if pa.types.is_large_string(found.type) else pa.binary()).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each word stands in the texts of docs; counted within each task before the shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for texts in _slices(batch.column(0)):
                held.append(words_of(texts)[0])
                n += len(held[-1])
                if n > COUNTED:
                    yield _pairs(held)
                    held, n = [], 0
        yield _pairs(held)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(held: list[pa.Array]) -> pa.RecordBatch:
    found = pa.chunked_array(held, pa.binary()).value_counts()
    return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])


class Places(dict):
    """Places of words in the tables. A word that isn't there has the place of its ending's class, and is noted."""

    def __init__(self, known: list[bytes], endings: list[bytes]):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.ending, self.other, self.missed = {e: len(known) + 1 + i for i, e in enumerate(endings)}, len(known), []

    def __missing__(self, word: bytes) -> int:
        self.missed.append(word)
        return self.ending.get(word[-ENDING:], self.other)


class Vocabulary:
    """Tables by place: known words first, then the classes of unknown ones, then a document's end.

    column: the row of the input table. group: the class. row: the row among frequent words, -1 for others. share: log of a word's part of its
    class (others only; without the count of an unknown word). base: log10 of count + ADDED. known: 1 where the count is above 0."""

    def __init__(self, known: list[bytes], counts: np.ndarray, ends: int, tokens: int, distinct: int, frequent: int, classes: int, endings: list[tuple[bytes | None, int, int]]):
        """endings: (last bytes, words' count, distinct words) of the classes, that of all other endings first, without its bytes."""
        # Words travel as one Arrow array: from a list, each shard and each task would make it anew.
        self.table, self.endings, self.ends, self.tokens, self.distinct = pa.array(known, pa.binary()), [e[0] for e in endings[1:]], ends, tokens, distinct
        n, k = len(known), min(frequent, len(known))
        weight = np.sqrt(np.maximum(counts[:k], 1.0))
        part = np.floor((np.cumsum(weight) - weight / 2) / max(1.0, weight.sum()) * classes).astype(np.int64)
        part = np.unique(part, return_inverse=True)[1]  # no empty class
        heads = int(part.max(initial=-1)) + 1
        self.bounds = np.searchsorted(part, np.arange(heads + 1))
        self.frequent, self.heads, self.groups = k, heads, 1 + heads + len(endings)
        place = Places([], self.endings)
        tail = np.fromiter((place.ending.get(w[-ENDING:], 0) for w in known[k:]), np.int64, n - k)
        size = np.array([e[1] for e in endings], float) + ADDED * (np.array([e[2] for e in endings], float) + 1)
        every = np.arange(len(endings))
        # Looked up for each token, so they are kept small.
        self.group = np.concatenate([1 + part, 1 + heads + tail, 1 + heads + every, [0]]).astype(np.int32)
        self.column = np.concatenate([np.arange(k), k + tail, k + every, [0]]).astype(np.int32)
        self.row = np.concatenate([np.arange(k), np.full(n - k + len(endings) + 1, -1)]).astype(np.int32)
        self.share = np.concatenate([np.zeros(k), np.log(counts[k:] + ADDED) - np.log(size[tail]), -np.log(size), [0.0]])
        self.base = np.concatenate([np.log10(counts + ADDED), np.zeros(len(endings)), [math.log10(ends + ADDED)]])
        self.known = np.concatenate([np.ones(n), np.zeros(len(endings)), [float(ends > 0)]])
        of_group = np.concatenate([[ends], np.add.reduceat(counts[:k], self.bounds[:-1]) if heads else [], [e[1] for e in endings]])
        self.group_weight, self.word_weight = np.log(of_group + 1.0), np.log(np.maximum(counts[:k], 1.0))
        self.end = n + len(endings)

    @property
    def words(self) -> list[bytes]:
        return self.table.to_pylist()

    def places(self) -> Places:
        return Places(self.words, self.endings)

    def finder(self) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """What places() says of many texts at once: the places of their tokens, one text's behind another's, their numbers of tokens, the words that are not in the tables, and
        where those stand."""
        known, endings = self.table, pa.array(self.endings, pa.binary())

        def find(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
            words, sizes = words_of(texts)
            at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            missing = np.flatnonzero(at < 0)
            missed = words.take(pa.array(missing))
            of_ending = pc.fill_null(pc.index_in(pc.binary_slice(missed, -ENDING), value_set=endings), -1).to_numpy()
            out = np.full(len(at) + len(sizes), self.end, np.int32)
            stand = np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)
            out[stand], missing = at, stand[missing]
            out[missing] = len(known) + 1 + of_ending
            return out, sizes + 1, missed, missing

        return find


class Network:
    """A gated recurrent unit over words (X: gate inputs by word, U: gates by state) and its output by class (C, c) and within the classes of frequent words (W, w)."""

    NAMES = ("X", "U", "C", "c", "W", "w")

    def __init__(self, vocabulary: Vocabulary, state: int = STATE):
        rng = np.random.default_rng(1)
        v, self.state, self.rooms = vocabulary, state, {}
        self.X = rng.normal(0, 0.1, (v.frequent + len(v.endings) + 1, 3 * state)).astype(np.float32)
        self.X[:, :state] -= 1.0  # states change slowly at first
        self.U = rng.normal(0, 0.5 / math.sqrt(state), (state, 3 * state)).astype(np.float32)
        self.C, self.c = np.zeros((state, v.groups), np.float32), v.group_weight.astype(np.float32)
        self.W, self.w = np.zeros((v.frequent, state), np.float32), v.word_weight.astype(np.float32)

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write on, whose memory the next of that name gets: large arrays made anew cost more than what is worked out in them."""
        size = math.prod(shape)
        held = self.rooms.get(name)
        if held is None or held.size < size or held.dtype != self.C.dtype:
            held = self.rooms[name] = np.empty(size, self.C.dtype)
        return held[:size].reshape(shape)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rooms": {}}

    def get(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and what led to it: update and reset gates, candidate, the gates' part from the state."""
        return tuple(found.T for found in self.turned_step(h.T, x.T, self.to_gates()))

    def to_gates(self) -> np.ndarray:
        """U, turned, what leads to the two gates with its sign changed, as turned_step() takes it."""
        out = np.ascontiguousarray(self.U.T)
        np.negative(out[: 2 * self.state], out=out[: 2 * self.state])
        return out

    @np.errstate(over="ignore")  # an infinite exponential is a gate that is shut
    def turned_step(self, h: np.ndarray, x: np.ndarray, to_gates: np.ndarray, a: np.ndarray | None = None, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """step() with lanes side by side, so that gates are whole rows: work on short pieces of rows costs more than the numbers in them. a and n: arrays to write on, for all gates
        and for the candidate. Exponentials take half as long as hyperbolic tangents."""
        s = self.state
        a = np.matmul(to_gates, h, out=a)
        gates, from_state = a[: 2 * s], a[2 * s :]
        gates -= x[: 2 * s]
        np.exp(gates, out=gates)
        gates += 1
        np.divide(1, gates, out=gates)
        z, r = gates[:s], gates[s:]
        n = np.multiply(r, from_state, out=n)
        n += x[2 * s :]
        n += n
        np.exp(n, out=n)
        n += 1
        np.divide(-2, n, out=n)
        n += 1
        ahead = n - h
        ahead *= z
        ahead += h
        return ahead, z, r, n, from_state

    def inputs(self, column: np.ndarray) -> np.ndarray:
        """Rows of the input table as columns, until the next call."""
        out = self.room("turned", self.X.shape[1], len(column))
        out[:] = np.take(self.X, column, axis=0, out=self.room("inputs", len(column), self.X.shape[1]), mode="clip").T
        return out

    def tables(self, v: Vocabulary, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The output by class and within classes as one matrix each, the constants as a last row or column, for states up to `reach` with a 1 behind them. Constants are lowered by
        what the logits of a softmax can be at most; whether no sum of exponentials can vanish then, so that no row's own maximum has to be found."""
        spread = reach @ np.abs(self.C)
        high, low = (self.c + spread).max(), (self.c - spread).max()
        by_class = np.concatenate([self.C, (self.c - high)[None]])
        if not v.heads:
            return by_class, np.zeros((0, self.state + 1), self.W.dtype), high - low < SAFE
        spread = np.abs(self.W) @ reach
        tops, lows = (np.maximum.reduceat(x, v.bounds[:-1]) for x in (self.w + spread, self.w - spread))
        within = np.concatenate([self.W, (self.w - np.repeat(tops, np.diff(v.bounds)))[:, None]], 1)
        return by_class, within, max(high - low, (tops - lows).max()) < SAFE

    def logs(self, v: Vocabulary, h: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log-probability of each token (its place in the tables) given the state before it."""
        group, row = v.group[place], v.row[place]
        out = v.share[place]
        by_class, within, safe = self.tables(v, np.maximum(h.max(0, initial=0), -h.min(0, initial=0)))
        states = self.room("states", len(h), self.state + 1)
        states[:, :-1], states[:, -1] = h, 1
        for at in range(0, len(place), ROWS):
            part = slice(at, at + ROWS)
            x = states[part]
            out[part] += _log_shares(np.matmul(x, by_class, out=self.room("p", len(x), len(self.c))), group[part], safe)
        order, pieces = _by_class(v, group, row)
        states, local, found = np.take(states, order, axis=0), row[order], np.empty(len(order), states.dtype)
        for part, low, high in pieces:
            x = states[part]
            found[part] = _log_shares(np.matmul(x, within[low:high].T, out=self.room("p", len(x), high - low)), local[part] - low, safe)
        out[order] += found
        return out

    def learn(self, v: Vocabulary, place: np.ndarray, first: np.ndarray, h: np.ndarray, squares: dict[str, np.ndarray], rate: float) -> tuple[float, np.ndarray]:
        """One window (steps, lanes) of truncated backpropagation with steps by Adagrad; the mean loss, and the state to carry on."""
        s, (steps, lanes) = self.state, place.shape
        column, kept, going = v.column[place], [], (~first).astype(self.C.dtype)
        before, states = self.room("before", steps, s, lanes), self.room("states", steps, lanes, s + 1)
        gates, candidates = self.room("gates", steps, 3 * s, lanes), self.room("candidates", steps, s, lanes)
        to_gates, h = self.to_gates(), h.T
        for t in range(steps):
            h = np.multiply(h, going[t], out=before[t])
            states[t, :, :s] = h.T
            after, *parts = self.turned_step(h, self.inputs(column[t]), to_gates, gates[t], candidates[t])
            kept.append((h, *parts))
            h = after
        states[:, :, s] = 1
        states, flat = states.reshape(-1, s + 1), place.ravel()
        group, row = v.group[flat], v.row[flat]
        by_class, within, safe = self.tables(v, np.maximum(before.max((0, 2)), -before.min((0, 2))))
        back, loss, outer, weights = self.room("back", flat.size, s), 0.0, 0, np.ascontiguousarray(self.C.T)
        for at in range(0, flat.size, ROWS):
            x = states[at : at + ROWS]
            p = np.matmul(x, by_class, out=self.room("p", len(x), len(self.c)))
            loss += _output(p, group[at : at + ROWS], safe)
            np.matmul(p, weights, out=back[at : at + ROWS])
            outer = outer + p.T @ x
        grads = {"C": np.ascontiguousarray(outer[:, :s].T), "c": outer[:, s]}
        order, pieces = _by_class(v, group, row)
        x, local, inner = np.take(states, order, axis=0), row[order], np.zeros_like(within)
        more = self.room("more", len(order), s)
        # What is done to each number is done for all classes at once: calls for one class cost more than their numbers.
        wide, many = np.array([(high - low, at.stop - at.start) for at, low, high in pieces], np.int64).reshape(-1, 2).T
        ends = np.cumsum(wide * many)
        logits = self.room("logits", int(ends[-1]) if len(ends) else 0)
        parts = [logits[end - w * m : end].reshape(m, w) for end, w, m in zip(ends.tolist(), wide.tolist(), many.tolist(), strict=True)]
        for (at, low, high), q in zip(pieces, parts, strict=True):
            np.matmul(x[at], within[low:high].T, out=q)
            if not safe:
                q -= q.max(1, keepdims=True)
        np.exp(logits, out=logits)
        total, ones = self.room("total", len(order)), np.ones(wide.max(initial=0), self.C.dtype)
        for (at, _, _), q in zip(pieces, parts, strict=True):
            np.matmul(q, ones[: q.shape[1]], out=total[at])
        step = np.repeat(wide, many)
        chosen = np.cumsum(step) - step + local - np.repeat(np.array([low for _, low, _ in pieces], np.int64), many)
        share = 1 / total
        loss -= np.log(logits[chosen] * share + 1e-30).sum()
        logits[chosen] -= total
        x *= share[:, None]
        for (at, low, high), q in zip(pieces, parts, strict=True):
            np.matmul(q, self.W[low:high], out=more[at])
            np.matmul(q.T, x[at], out=inner[low:high])
        more *= share[:, None]
        back[order] += more
        grads["W"], grads["w"] = np.ascontiguousarray(inner[:, :s]), inner[:, s]
        back = back.reshape(steps, lanes, s)
        ahead, grads["U"], to_state, to_input = np.zeros((s, lanes), self.C.dtype), 0, self.room("to_state", 3 * s, lanes), self.room("to_input", 3 * s, steps, lanes)
        for t in range(steps - 1, -1, -1):
            hp, z, r, n, a = kept[t]
            dn, dz, rest = ahead * z, n - hp, 1 - z
            dz *= rest
            np.multiply(dz, dn, out=to_state[:s])
            np.multiply(n, n, out=dz)
            np.subtract(1, dz, out=dz)
            dn *= dz
            np.multiply(dn, r, out=to_state[2 * s :])
            np.subtract(1, r, out=dz)
            dz *= a
            np.multiply(dz, to_state[2 * s :], out=to_state[s : 2 * s])
            to_input[: 2 * s, t], to_input[2 * s :, t] = to_state[: 2 * s], dn
            grads["U"] = grads["U"] + hp @ to_state.T
            ahead *= rest
            ahead += self.U @ to_state
            ahead += back[t].T
            ahead *= going[t]
        # Rows of X whose words are not in the window have no gradient, so they stay as they are.
        used, grads["X"] = _row_sums(column.ravel(), to_input.reshape(3 * s, -1).T, self.room("sums", flat.size, 3 * s))
        for name, g in grads.items():
            g /= lanes
            np.clip(g, -1, 1, out=g)
            held, square = getattr(self, name), squares[name]
            if name == "X":
                held, square = np.take(held, used, axis=0), np.take(square, used, axis=0)
            root = self.room("root", *g.shape)
            np.multiply(g, g, out=root)
            square += root
            np.sqrt(square, out=root)
            root += 1e-6
            g *= rate
            g /= root
            held -= g
            if name == "X":
                self.X[used], squares["X"][used] = held, square
        return float(loss) / flat.size, np.ascontiguousarray(h.T)


def _output(x: np.ndarray, at: np.ndarray, safe: bool) -> float:
    """The loss of the elements `at` of a softmax over each row of logits; x becomes its gradient by them. Sums over short rows are products with ones, which are faster."""
    flat = x.reshape(-1)
    chosen = np.arange(0, flat.size, x.shape[1]) + at
    _exponentials(x, safe)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    share = flat[chosen]
    flat[chosen] = share - 1
    return -np.log(share + 1e-30).sum()


def _row_sums(row: np.ndarray, values: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that occur, in order, and the sum of the values of each: column by column, so values are best given turned, and nothing is sorted."""
    there = np.zeros(row.max(initial=-1) + 1, bool)
    there[row] = True
    used, at = np.flatnonzero(there), (np.cumsum(there) - 1)[row]
    sums = room.reshape(-1)[: len(used) * values.shape[1]].reshape(values.shape[1], len(used))
    sums[:] = 0
    for total, of in zip(sums, values.T, strict=True):
        np.add.at(total, at, of)
    return used, np.ascontiguousarray(sums.T)


def _exponentials(x: np.ndarray, safe: bool) -> None:
    """In place; safe: of logits whose rows have no need of their maximum."""
    if not safe:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)


def _log_shares(x: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """The logarithm of one element's softmax a row; x is worked on in place."""
    if not safe:
        x -= x.max(1, keepdims=True)
    chosen = x.reshape(-1)[np.arange(len(x)) * x.shape[1] + at]
    np.exp(x, out=x)
    return chosen - np.log(x @ np.ones(x.shape[1], x.dtype))


def _by_class(v: Vocabulary, group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, int, int]]]:
    """The tokens of frequent words, class by class, and for each class that occurs: where they stand in that order, and its rows."""
    there = np.where(row >= 0, group, 0).astype(np.uint8 if v.groups < 256 else np.int64)
    order = np.argsort(there, kind="stable")
    ends = np.searchsorted(there[order], np.arange(1, v.heads + 2))
    order, ends = order[ends[0] :], (ends - ends[0]).tolist()
    return order, [(slice(ends[g], ends[g + 1]), int(v.bounds[g]), int(v.bounds[g + 1])) for g in range(v.heads) if ends[g] < ends[g + 1]]


def lanes_of(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt out to lanes, each to the shortest so far, longest text first; lanes by falling length."""
    heap = [(0, i) for i in range(lanes)]
    out: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, lane = heapq.heappop(heap)
        out[lane].append(i)
        heapq.heappush(heap, (n + int(sizes[i]), lane))
    return [out[lane] for n, lane in sorted(heap, key=lambda x: (-x[0], x[1])) if n]


def scores(net: Network, v: Vocabulary, texts: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Natural log-probability of each text (places, its end last), without the counts of unknown words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = np.zeros(len(texts))
    if not len(texts):
        return total
    lanes = lanes_of(sizes, int(np.clip(sizes.sum() // sizes.max(), 32, 1024)))
    order = list(chain.from_iterable(lanes))
    flat = np.concatenate([texts[i] for i in order])
    text = np.repeat(np.array(order, np.int32), sizes[order])
    first = np.zeros(len(flat), bool)
    first[np.cumsum(sizes[order]) - sizes[order]] = True
    length = np.array([int(sizes[x].sum()) for x in lanes])
    start = np.cumsum(length) - length
    column = v.column[flat]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than t
    h, to_gates = np.zeros((net.state, len(lanes)), np.float32), net.to_gates()
    states = np.empty((max(window, len(lanes)), net.state), np.float32)
    seen: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        at = np.concatenate(seen)
        total[:] += np.bincount(text[at], net.logs(v, states[:held], flat[at]), len(total))

    for t, k in enumerate(active.tolist()):
        if held + k > len(states):
            flush()
            seen, held = [], 0
        at = start[:k] + t
        h = h[:, :k] * ~first[at]
        states[held : held + k] = h.T
        seen.append(at)
        held += k
        h = net.turned_step(h, net.inputs(column[at]), to_gates)[0]
    flush()
    return total


class Model:
    """A vocabulary and its network: what a task needs, whose size the parameters bound."""

    def __init__(self, vocabulary: Vocabulary, network: Network):
        self.vocabulary, self.network = vocabulary, network

    def per_token(self) -> float:
        """log10 of what a count is divided by in the base score."""
        v = self.vocabulary
        return math.log10(v.tokens + ADDED * (v.distinct + 1))


def vocabulary_of(counts: DataFrame, documents: int, known: int = WORDS, frequent: int = FREQUENT, classes: int = CLASSES, endings: int = ENDINGS) -> Vocabulary:
    """From a written table of all words' counts. What is collected is bounded by the parameters."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = heaviest(counts, "n", known).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    names, n = top["word"].to_pylist(), top["n"].to_numpy().astype(float)
    k = min(frequent, len(names))
    # The frequent words go before the others by (count, word).
    others = counts if k == 0 else counts.where((F.col("n") < int(n[k - 1])) | ((F.col("n") == int(n[k - 1])) & (F.col("word") > F.lit(bytearray(names[k - 1])))))
    by_end = others.groupBy(F.expr(f"substring(word, -{ENDING}, {ENDING})").alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    ends = [(bytes(r["e"]), r["n"], r["v"]) for r in by_end.orderBy(F.desc("n"), "e").limit(endings).collect()]
    rest = others.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    other = (None, (rest["n"] or 0) - sum(e[1] for e in ends), rest["v"] - sum(e[2] for e in ends))
    return Vocabulary(names, n, documents, (total["n"] or 0) + documents, total["v"] + (documents > 0), frequent, classes, [other, *ends])


def _trained(flat: np.ndarray, v: Vocabulary, texts: list[bytes | None], tokens: int | None = None, lanes: int = LANES, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, int]:
    """Weights and sums of squares after one pass over a shard's texts (their first `tokens`), and how many tokens that were. More tokens run in more lanes; what is left over by them
    runs in fewer, so each token is learned once."""
    net, find = Network(v), v.finder()
    half = len(flat) // 2
    net.put(flat[:half])
    names = Network.NAMES
    squares, at = {}, half
    for n in names:
        shape = getattr(net, n).shape
        squares[n] = flat[at : at + math.prod(shape)].reshape(shape).astype(np.float32)
        at += math.prod(shape)
    found = [find(t)[:2] for t in _slices(pa.array(texts, pa.large_binary()).view(pa.large_string()))]
    place = np.concatenate([np.zeros(0, np.int32), *[f[0] for f in found]])
    first = np.zeros(len(place) + 1, bool)
    first[np.cumsum(np.concatenate([[0], *[f[1] for f in found]]))] = True
    place = place[:tokens]
    at = 0
    while at < len(place):
        left = len(place) - at
        width, height = int(np.clip(left // (steps * 64), lanes, max(lanes, WIDE))), min(steps, left)
        width = min(width, left // height)
        long = left // (width * height) * height
        x, f = (c[at : at + width * long].reshape(width, long).T for c in (place, first))
        h = np.zeros((width, net.state), np.float32)
        for t in range(0, long, height):
            _, h = net.learn(v, x[t : t + height], f[t : t + height], h, squares, rate)
        at += width * long
    return np.concatenate([net.get(), *[squares[n].ravel() for n in names]]).astype(np.float32), len(place)


def _round(shared):
    """What a shard does in a round: all its texts, from the weights of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t or b"" for b in batches for t in _texts(b, b.schema.get_field_index("text"))]
        weights, v = shared.value
        yield pa.RecordBatch.from_arrays([pa.array([_trained(weights, v, sorted(texts), TOKENS)[0].tobytes()], pa.binary()), pa.array([len(texts)])], ["weights", "n"])

    return run


def _pass(shared):
    """What a shard of all documents does: each text whole, from the starting weights; its weights in PARTS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, shard = [], 0
        for b in batches:
            texts += [t or b"" for t in _texts(b, b.schema.get_field_index("text"))]
            shard = b.column(b.schema.get_field_index("shard"))[0].as_py()
        weights, v = shared.value
        flat, n = _trained(weights, v, sorted(texts))
        parts = [x.tobytes() for x in np.array_split(flat, PARTS)]
        columns = [pa.array(range(PARTS), pa.int32()), *[pa.array([x] * PARTS, pa.int64()) for x in (shard, n)], pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "n", "weights"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of a part's weights over shards, by their tokens."""
    part, total, tokens = 0, 0.0, 0
    for b in batches:
        for row in b.to_pylist():
            part, tokens = row["part"], tokens + row["n"]
            total = total + row["n"] * np.frombuffer(row["weights"], np.float32).astype(float)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["part", "weights"])


def fit(docs: DataFrame, keep: Column, sample: int = SAMPLE, rounds: int = ROUNDS, **sizes: int) -> tuple[Model, DataFrame]:
    """A model from the rows of docs (doc_id, text) for which `keep` holds, and the written table of their words' counts.

    All of them are counted, and the network learns all of them whole. It starts from `rounds` over about `sample` of them, chosen by hash, EXCERPT characters of each from a hashed place.
    Null texts are empty documents. Shards are dealt by hash, so the weights don't depend on how the table lies in files.
    Without a training row every word is unknown, and the model says nothing of it."""
    spark = docs.sparkSession
    ship(spark)
    training = docs.where(keep)
    counts = written(word_counts(training), "words")
    documents = training.count()
    v = vocabulary_of(counts, documents, **sizes)
    net = Network(v)
    flat = np.concatenate([net.get(), np.full(net.get().size, 0.01)]).astype(np.float32)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("text", F.lit(9)), F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int") + 1
    drawn = training.where(draw < int(min(1.0, sample / max(1, documents)) * (1 << 30)))
    # Copies of a text teach once.
    drawn = written(drawn.select(F.col("text").substr(start, F.lit(EXCERPT)).alias("text")).distinct().withColumn("shard", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SHARDS))), "sample")
    for _ in range(rounds if documents else 0):
        shared = spark.sparkContext.broadcast((flat, v))

        # SHARDS rows of a size that the parameters bound.
        found = drawn.groupBy("shard").applyInArrow(_round(shared), "weights binary, n long").collect()
        if found:
            flat = np.average([np.frombuffer(r["weights"], np.float32) for r in found], axis=0, weights=[r["n"] for r in found]).astype(np.float32)
        shared.destroy()
    dropped(drawn)
    if documents:
        shared = spark.sparkContext.broadcast((flat, v))
        shards = max(SHARDS, -(-documents // APART))
        every = training.select("text", F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(shards)).alias("shard"))
        # PARTS rows to the driver, however many shards there are.
        found = every.groupBy("shard").applyInArrow(_pass(shared), "part int, shard long, n long, weights binary").groupBy("part").applyInArrow(_averaged, "part int, weights binary").collect()
        flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(found, key=lambda r: r["part"])])
        shared.destroy()
    net.put(flat[: len(flat) // 2])
    return Model(v, net), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """For every row of docs: doc_id (long), n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Null and empty texts are their end alone; repeated rows are equal; a null doc_id stays null; a text of any length is read whole, its state carried from its first word to its
    end. Words beyond the best known are joined with their counts by word: none of them is frequent, and each comes once a document. Other
    columns, whatever their names, are ignored. Empty table: no rows."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v = model.vocabulary
        find = v.finder()
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                yield told(model, batch.column(0).slice(at, len(texts)), *find(texts))
                at += len(texts)

    def told(model: Model, ids: pa.Array, place: np.ndarray, sizes: np.ndarray, missed: pa.Array, missing: np.ndarray) -> pa.RecordBatch:
        v = model.vocabulary
        start = np.cumsum(sizes) - sizes
        numbers = [pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat(v.known[place], start).astype(np.int64)), pa.array(np.add.reduceat(v.base[place], start))]
        found = scores(model.network, v, np.split(place, start[1:])) / math.log(10)
        # Each word that is not in the tables once a text, with how often it stands there.
        once = missed.dictionary_encode()
        code, n = np.unique((np.searchsorted(start, missing, "right") - 1) * max(1, len(once.dictionary)) + once.indices.to_numpy(), return_counts=True)
        text, word = np.divmod(code, max(1, len(once.dictionary)))
        pairs = pa.StructArray.from_arrays([once.dictionary.take(pa.array(word)), pa.array(n, pa.int64())], ["word", "n"])
        rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([ids, *numbers, pa.array(found), rest], names)

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "rest"]
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<struct<word binary, n long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rest = rows.select("_row", F.explode("rest").alias("x")).select("_row", "x.word", F.col("x.n").alias("times")).join(counts, "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED)) * F.col("times")
    rest = rest.groupBy("_row").agg(F.sum(log).alias("_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"))
    both = rows.drop("rest").join(rest, "_row", "left")
    log, known = F.coalesce("_log", F.lit(0.0)), F.coalesce("_known", F.lit(0).cast("long"))
    base = F.col("base_score") + log - F.col("n_tokens") * F.lit(model.per_token())
    tokens = F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens")
    return both.select("doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), tokens, base.alias("base_score"), (F.col("score") + log).alias("score"))
