"""Chat formatting: raw transcripts become canonical turns.

A transcript is the text of a conversation, whole or cut into chunks (conv_id, seq, text) between any two lines. A hidden Markov model reads its lines: hidden states
are a role and whether the line opens a turn, goes on with it or is blank; what is observed is the line's speaker marker or, without one, what kind of
line it is (blank, code, list, greeting, question, or how long). Where a chunk begins is no evidence. Probabilities start from fixed ones and are
learned from labelled transcripts. Viterbi recovers the roles; each turn is then rendered in one canonical form.

A conversation of any length is decoded exactly without being gathered in one task. A chunk's lines fold into one max-plus
matrix (best log-probability from the state before to the state after), in the pass over the text. Chunks are numbered in one order of all conversations, so a block of
BLOCK numbers holds no more than that of any. The matrices of a conversation in a block fold into one, and so on up while it has several; the states found at the joints are
handed back down, where each chunk is decoded alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import fold
from tessera.operators.columns import global_row_number
from tessera.shipping import ship
from tessera.sources.store import written

ROLES = ("system", "user", "assistant")
#: States: 3*r opens a turn of role r, 3*r+1 goes on with it, 3*r+2 is a blank line of it; the last one stands before the first line.
STATES = 3 * len(ROLES) + 1
BEGIN = STATES - 1
#: Chunks of a conversation that one task folds.
BLOCK = 1024
#: Turns of a conversation that as_transcripts() puts into one chunk at most, and turn numbers.
CHUNK_ROWS, CHUNK_TURNS = 256, 64
#: Labelled conversations and their turns to learn from at most.
LEARN_CONVERSATIONS, LEARN_TURNS = 2000, 20_000
#: Spellings of speaker markers, by role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model", "agent"),
}
_ROLE = {w: r for r, words in enumerate(MARKERS.values()) for w in words}
_WORDS = "|".join(sorted(_ROLE, key=lambda w: (-len(w), w)))
#: "User:", "### Assistant:", "[human]", "<|user|>", "<|im_start|>user", "**Bot**:", "User>".
_MARK = re.compile(
    rf"^[ \t]*(?:<\|im_start\|>[ \t]*(?P<a>{_WORDS})\b[ \t]*|<\|(?P<b>{_WORDS})\|>|\[(?P<c>{_WORDS})\]:?|(?:\#{{1,4}}[ \t]*|\*\*)?(?P<d>{_WORDS})(?:\*\*)?[ \t]*[:>](?:\*\*)?|\#{{2,4}}[ \t]*(?P<e>{_WORDS})[ \t]*$)[ \t]*",
    re.I,
)
_END = re.compile(r"[ \t]*<\|(?:im_end|end|eot_id)\|>[ \t]*$")
_LIST = re.compile(r"[ \t]*(?:[-*\u2022+]|\d{1,3}[.)])[ \t]")
_CODE = re.compile(r"(?:\t| {4}|[ \t]*(?:```|~~~))|.*[;{}]$")
#: Words that greet.
_GREETING = re.compile(r"[ \t]*(?:hi|hello|hey|dear|good (?:morning|evening|day)|hallo|bonjour|hola|sure|certainly|thanks|thank you)\b", re.I)
#: Kinds of lines without a marker, and the lengths that part the last ones.
KINDS = ("blank", "code", "list", "greeting", "question", "short", "medium", "long", "very long")
LENGTHS = (40, 100, 200)
#: Symbols: a marker of role r alone (2*r) or with words after it (2*r+1), then KINDS.
SYMBOLS = 2 * len(ROLES) + len(KINDS)
BLANK = 2 * len(ROLES)


def symbol(line: str) -> int:
    """What a line shows."""
    if not line or line.isspace():
        return BLANK
    if mark := _MARK.match(line):
        return 2 * _ROLE[next(g for g in mark.groups() if g).lower()] + (mark.end() < len(line.rstrip()))
    if _CODE.match(line):
        return BLANK + 1
    if _LIST.match(line):
        return BLANK + 2
    if _GREETING.match(line):
        return BLANK + 3
    if line.rstrip().endswith(("?", "\uff1f")):
        return BLANK + 4
    return BLANK + 5 + sum(len(line) >= n for n in LENGTHS)


# Fixed probabilities, where nothing has been learned.
_P_NEXT = {0: (0.01, 0.94, 0.05), 1: (0.01, 0.09, 0.90), 2: (0.01, 0.94, 0.05)}
_P_BEGIN = (0.3, 0.6, 0.1)
#: Of a line, by the state before: that it opens a turn, goes on with the last, is blank.
_P_AFTER = ((0.25, 0.65, 0.1), (0.2, 0.7, 0.1), (0.5, 0.4, 0.1))
#: Of a line that opens a turn: that it has its role's marker, another's, none. Of one that goes on: that it has a marker.
_P_OWN, _P_OTHER, _P_BARE, _P_INNER = 0.8, 0.005, 0.195, 0.002
_TINY = 1e-9


def _fixed() -> tuple[np.ndarray, np.ndarray]:
    """Transition and emission probabilities."""
    go, show = np.full((STATES, STATES), _TINY), np.full((STATES, SYMBOLS), _TINY)
    plain = np.full(len(KINDS) - 1, 1 / (len(KINDS) - 1))
    for s in range(BEGIN):
        role, kind = divmod(s, 3)
        opens, goes, blank = _P_AFTER[kind]
        go[s, 0:BEGIN:3] = opens * np.array(_P_NEXT[role])
        go[s, 3 * role + 1], go[s, 3 * role + 2] = goes, blank
        if kind == 0:
            show[s, :BLANK] = _P_OTHER / BLANK
            show[s, 2 * role : 2 * role + 2] = _P_OWN / 2
            show[s, BLANK + 1 :] = _P_BARE * plain
        elif kind == 1:
            show[s, :BLANK] = _P_INNER / BLANK
            show[s, BLANK + 1 :] = plain
        else:
            show[s, BLANK] = 1.0
    go[BEGIN, 0:BEGIN:3] = 0.97 * np.array(_P_BEGIN)
    go[BEGIN, 2:BEGIN:3] = 0.01
    return go, show


@dataclass
class Model:
    """One max-plus matrix a symbol: log-probability of the state after and of what the line shows, by the state before."""

    steps: np.ndarray

    @classmethod
    def of(cls, go: np.ndarray, show: np.ndarray) -> Model:
        go, show = (m / m.sum(1, keepdims=True) for m in (np.maximum(go, _TINY), np.maximum(show, _TINY)))
        steps = np.log(go)[None, :, :] + np.log(show).T[:, None, :]
        steps[:, :, BEGIN] = -np.inf
        return cls(steps)

    def __post_init__(self) -> None:
        self.known: dict[tuple[int, ...], np.ndarray] = {}

    def folded(self, symbols: list[int]) -> np.ndarray:
        """The product over some lines; short runs are remembered, for there are not many different ones."""
        out = None
        for at in range(0, len(symbols), 4):
            key = tuple(symbols[at : at + 4])
            run = self.known.get(key)
            if run is None:
                run = self.steps[key[0]]
                for k in key[1:]:
                    run = times(run, self.steps[k])
                if len(self.known) > 20_000:
                    self.known.clear()
                self.known[key] = run
            out = run if out is None else times(out, run)
        return np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf) if out is None else out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def path(mats: list[np.ndarray], before: int, after: int | None) -> list[int]:
    """The best states after each of a run of matrices, between the state before and the state after (None: the best)."""
    score, back = np.full(STATES, -np.inf), []
    score[before] = 0.0
    for m in mats:
        via = score[:, None] + m
        back.append(via.argmax(0))
        score = via.max(0)
    states = [int(score.argmax()) if after is None else after]
    for b in back[:0:-1]:
        states.append(int(b[states[-1]]))
    return states[::-1]


def labelled_states(turns: list[tuple[int, list[int]]]) -> tuple[list[int], list[int]]:
    """(states, symbols) of the lines of a labelled transcript: (role, symbols of its lines) of each turn, in order."""
    states, symbols, before = [], [], None
    for role, shown in turns:
        opened = False
        for k in shown:
            if k == BLANK:
                states.append(3 * (role if opened or before is None else before) + 2)
            else:
                states.append(3 * role + (1 if opened else 0))
                opened = True
            symbols.append(k)
        before = role if opened else before
    return states, symbols


def learn(transcripts: list[list[tuple[int, list[int]]]], weight: float = 20.0) -> Model:
    """A model from labelled transcripts; the fixed probabilities count like `weight` lines a state."""
    go, show = _fixed()
    go, show = go / go.sum(1, keepdims=True) * weight, show / show.sum(1, keepdims=True) * weight
    for turns in transcripts:
        before = BEGIN
        for s, k in zip(*labelled_states(turns), strict=True):
            go[before, s] += 1
            show[s, k] += 1
            before = s
    return Model.of(go, show)


def fit(conversations: DataFrame, keep: Column | None = None) -> Model:
    """A model from the transcripts that as_transcripts() makes of at most LEARN_CONVERSATIONS labelled conversations (LEARN_TURNS turns) for which `keep` holds.

    Turns of other roles, and without conv_id, turn or text, teach nothing. Empty table: the fixed probabilities."""
    ship(conversations.sparkSession)
    rows = spelled(conversations).where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    rows = rows if keep is None else rows.where(keep)
    draw = F.xxhash64("conv_id", F.lit(17))
    picked = rows.select("conv_id").distinct().orderBy(draw, "conv_id").limit(LEARN_CONVERSATIONS)
    some = rows.join(F.broadcast(picked), "conv_id").orderBy(draw, "conv_id", "turn", F.xxhash64("text")).limit(LEARN_TURNS)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[symbol(line) for line in t.as_py().split("\n")] for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["conv_id", "turn", "role", "shown"])

    got = some.select("conv_id", "turn", F.lower("role").alias("role"), "text").mapInArrow(shown, "conv_id long, turn long, role string, shown array<int>").collect()
    by: dict[int, list[tuple[int, list[int]]]] = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["turn"], r["shown"])):
        if r["role"] in ROLES:
            by.setdefault(r["conv_id"], []).append((ROLES.index(r["role"]), r["shown"]))
    return learn(list(by.values()))


def strip_marker(line: str) -> str:
    m = _MARK.match(line)
    return line[m.end() :] if m else line


def parts(text: str, states: list[int]) -> list[tuple[str, bool, str]]:
    """(role, whether the turn began in an earlier chunk, lines but for the marker) of the turns in a chunk."""
    out: list[list] = []
    for line, s in zip(text.split("\n"), states, strict=True):
        if s % 3 == 0 or not out:
            out.append([ROLES[s // 3], s % 3 != 0, [strip_marker(line) if s % 3 == 0 else line]])
        else:
            out[-1][2].append(line)
    return [(role, going, "\n".join(body)) for role, going, body in out]


def _content(body: str) -> str:
    return _END.sub("", body.strip("\n"))


def turns(text: str, states: list[int]) -> list[tuple[str, bool, str]]:
    """(role, whether the turn began in an earlier chunk, content) of the turns in a chunk."""
    return [(role, going, _content(body)) for role, going, body in parts(text, states)]


#: What a reader of the canonical form, or of a near one, could take for a control token: `<|name|>`.
_CONTROL = re.compile(r"<(?=\|[^\s|<>]{1,64}\|>)")


def escaped(content: str) -> str:
    """Content in which nothing reads as a control token: a zero-width space parts the two signs that would open one."""
    return _CONTROL.sub("<\u200b", content)


def render(role: str, body: str, going: bool, ends: bool = True) -> str:
    """Canonical form of a turn, or of a part of one: the parts of a turn, one after the other, give that of the whole turn.

    A part that began earlier (going) follows a line break; one that goes on in a later chunk (not ends) is not closed. White space and an end mark go at a turn's
    start and end; a blank line at a cut within a turn stays, also where the cut parts it from the turn's start or end. Control tokens in it are escaped()."""
    said = body if going else body.lstrip()
    if ends:
        said = _END.sub("", said.rstrip("\n")).rstrip()
    return ("\n" if going else f"<|im_start|>{role}\n") + escaped(said) + ("<|im_end|>\n" if ends else "")


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of the rows of sorted batches by their first columns."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for key, group in groupby(rows, lambda row: row[:keys]):
        yield key, list(group)


_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}


def _stream(df: DataFrame, schema: str, fn: Callable[[tuple, list[tuple]], list[tuple]]) -> DataFrame:
    """fn over the rows of each (conv_id, block), in the order of n; its rows in one table."""
    dealt = df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "n")
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        for key, rows in _by_key(batches, 2):
            out += fn(key, rows)
            if len(out) > 5000:
                yield batch()
                out = []
        yield batch()

    return dealt.mapInArrow(run, schema)


def _square(flat: list[float]) -> np.ndarray:
    return np.array(flat).reshape(STATES, STATES)


def _product(mats: list[np.ndarray]) -> list[float]:
    out = mats[0]
    for m in mats[1:]:
        out = times(out, m)
    return out.ravel().tolist()


def _joints(states: list[int], before: int) -> list[tuple[int, int]]:
    """(state before, state after) at each place of a path."""
    return list(zip([before, *states[:-1]], states, strict=True))


def chunk_states(chunks: DataFrame) -> DataFrame:
    """conv_id, n, before, after: the states around each chunk (conv_id, n, mat) of a conversation, in the order of n.

    A conversation within one block of n is solved there. Blocks of the others are folded, solved as chunks themselves, and opened again; so no task
    holds more than a block of a conversation, and each level has at most a BLOCK-th of the rows."""
    rows = chunks.select("conv_id", F.floor(F.col("n") / BLOCK).cast("long").alias("block"), "n", "mat")
    spans = rows.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select(F.col("conv_id").alias("c2"))
    several = written(spans, "several")
    begin, none = F.lit(BEGIN), F.lit(None).cast("int")
    if several.isEmpty():
        held = rows.select("conv_id", "block", "n", begin.alias("before"), none.alias("after"), "mat")
    else:
        long = rows.join(several, F.col("conv_id").eqNullSafe(F.col("c2")), "left_semi")
        folded = _stream(long, "conv_id long, n long, mat array<double>", lambda key, group: [(*key, _product([_square(r[3]) for r in group]))])
        ends = chunk_states(written(folded, "blocks")).select(F.col("conv_id").alias("c2"), F.col("n").alias("b2"), "before", "after")
        joined = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("block") == F.col("b2")), "left")
        held = joined.select("conv_id", "block", "n", F.coalesce("before", begin).alias("before"), "after", "mat")
    return _stream(held, "conv_id long, n long, before int, after int",
                   lambda key, group: [(key[0], r[2], *j) for r, j in zip(group, _joints(path([_square(r[5]) for r in group], group[0][3], group[0][4]), group[0][3]), strict=True)])


SCHEMA = "conv_id long, seq long, part long, role string, continues boolean, content string, rendered string"


def format_transcripts(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """A row (SCHEMA) for each turn, or part of a turn, in each chunk (conv_id, seq, text) of a transcript. Without a model the fixed probabilities hold.

    Chunks of a conversation are read in order of seq (null first, ties by a hash of the text); those with the same seq and text are one
    chunk to the model and are returned once for each row. A turn over several chunks is opened once and closed once: the parts' `rendered`, in order, are the turn's. Null or empty text: no turns. Rows with a null conv_id are one conversation. Very long
    texts are read whole; other columns, whatever their names, are ignored. Empty table: no rows."""
    spark = chunks.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model or Model.of(*_fixed())).steps)
    rows = chunks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL AND text != ''")

    def fold_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Model(shared.value)
        for batch in batches:
            mats = [hmm.folded([symbol(line) for line in t.as_py().split("\n")]).ravel().tolist() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mats, pa.list_(pa.float64()))], ["conv_id", "seq", "h", "mat"])

    each = rows.mapInArrow(fold_lines, "conv_id long, seq long, h long, mat array<double>").groupBy("conv_id", "seq", "h").agg(F.first("mat").alias("mat"))
    folded = written(global_row_number(each, "n", "conv_id", "seq", "h"), "chunks")
    states = written(chunk_states(folded.select("conv_id", "n", "mat")).select("n", "before", "after"), "states")
    named = states.join(folded.select("n", F.col("conv_id").alias("c2"), F.col("seq").alias("s2"), F.col("h").alias("h2")), "n")
    same: Column = F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("seq").eqNullSafe(F.col("s2")) & (F.col("h") == F.col("h2"))
    joined = rows.join(named, same).select("conv_id", "seq", "text", "before", "after", "n")
    joined = _with_open(joined, folded, shared)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "seq", "part", "role", "continues", "content", "rendered"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string())
        for batch in batches:
            out = []
            for conv, seq, text, before, after, open_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                states = path([shared.value[symbol(line)] for line in text.split("\n")], before, after)
                found = parts(text, states)
                for part, (role, going, body) in enumerate(found):
                    out.append((conv, seq, part, role, going, _content(body), render(role, body, going, not (open_ and part == len(found) - 1))))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return joined.mapInArrow(decode, SCHEMA)


def _with_open(rows: DataFrame, folded: DataFrame, shared: Broadcast) -> DataFrame:
    """conv_id, seq, text, before, after of the chunks (and n, their number) with `open`: whether a chunk's last turn goes on in the next one.

    That is told by the state of the next chunk's first line. Chunks that are not the first of their conversation are decoded for it, and only their numbers go on; where each conversation is one chunk
    nothing is decoded twice."""
    spans = folded.groupBy("conv_id").agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low < high").select(F.col("conv_id").alias("c2"), "low")
    several = written(spans, "spans")
    columns = [F.col(c) for c in ("conv_id", "seq", "text", "before", "after")]
    if several.isEmpty():
        return rows.select(*columns, F.lit(False).alias("open"))
    later = folded.select("conv_id", "n").join(several, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("n") > F.col("low"))).select("n")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [n for n, text, before, after in zip(*[c.to_pylist() for c in batch.columns], strict=True) if path([shared.value[symbol(line)] for line in text.split("\n")], before, after)[0] % 3]
            yield pa.RecordBatch.from_arrays([pa.array([n - 1 for n in got], pa.int64())], ["n2"])

    # Rows that repeat are one chunk.
    open_ = rows.join(later, "n", "left_semi").select("n", "text", "before", "after").mapInArrow(first, "n2 long").distinct()
    return rows.join(open_, F.col("n") == F.col("n2"), "left").select(*columns, F.col("n2").isNotNull().alias("open"))


#: Fixed value: the spellings of as_transcripts() after whose turns a blank line follows, as Markdown has it.
SPACED = (1, 4)


def spelled(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns as the web has them; a role outside the three gets a marker that the model does not know, so its turn reads as part of the one before. The spelling of the markers goes by conversation, one turn in four has
    none, and some spellings set turns apart by a blank line."""
    style = F.pmod(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.lit(5))
    role = F.lower("role")
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(F.initcap("role"))
    mark = F.when(style == 0, F.concat(F.initcap("role"), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), human, F.lit(":\n"))).when(style == 2, F.concat(F.lit("["), role, F.lit("] "))).when(style == 3, F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("**"), human, F.lit(":** ")))
    bare = F.col("role").isNull() | (F.pmod(F.coalesce(F.col("turn").cast("long"), F.lit(3)), F.lit(4)) == 3)
    text = F.concat(F.when(bare, F.lit("")).otherwise(mark), F.col("text"), F.when(style.isin(*SPACED), F.lit("\n")).otherwise(F.lit("")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts (conv_id, seq, text) of turns (conv_id, turn, role, text): the turns of a conversation follow each other in one text.

    Only a conversation with a turn number beyond CHUNK_TURNS comes in several chunks, and where more than CHUNK_ROWS rows share a conversation and a range of
    turns, each of them is a chunk: no task gathers an unbounded text. Turns without a text are left out; ties of a turn number go by the text. The transcripts are
    written once, for they are read twice. Empty table: no rows."""
    rows = spelled(conversations).where("text IS NOT NULL").withColumn("range", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK_TURNS))
    crowded = written(rows.groupBy("conv_id", "range").agg(F.count("*").alias("rows")).where(F.col("rows") > CHUNK_ROWS).select(F.col("conv_id").alias("c2"), F.col("range").alias("r2")), "crowded")
    same = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("range") == F.col("r2"))
    none = crowded.isEmpty()
    few = rows if none else rows.join(crowded, same, "left_anti")
    together = few.groupBy("conv_id", "range").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    out = together.select("conv_id", F.col("t")[0]["turn"].alias("seq"), F.array_join(F.col("t")["text"], "\n").alias("text"))
    if not none:
        out = out.unionByName(rows.join(crowded, same, "left_semi").select("conv_id", F.col("turn").alias("seq"), "text"))
    return written(out, "transcripts")


def learned_from(conv_id: Column) -> Column:
    """Whether a conversation may be learned from; the others are held out."""
    return fold(conv_id, 5) != 0
