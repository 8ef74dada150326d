"""Near-duplicate groups by SimHash fingerprints linked through BK-trees.

1. One pass over the texts gives each document a 64-bit fingerprint. Equal fingerprints are one node from here on, so
   exact copies cost nothing more.
2. Two fingerprints within radius r differ in at most r of b bit blocks, so they agree on some b-r blocks. Each choice of
   those blocks and their value names a shard. A shard that grows beyond SHARD fingerprints is dealt
   into trees of at most about that size, and each tree meets each part of the shard's queries in a work unit of its own.
3. In a unit, a BK-tree (children keyed by their Hamming distance to the parent) is filled and queried, following only
   edges within the radius. What a unit emits is a spanning star for each local component, never all pairs.
4. Alternating large-star and small-star rounds join the stars; each round is written to the shared folder.

Shard trees reach their queries through the shuffle: a broadcast would take all documents' fingerprints through the driver.

one_of_each() links texts by the similarity of their sets of five-word shingles instead. 64 bits are too few to tell 0.8 from less, so its fingerprints have 2,048, and its
shards are named by least hashes of the shingles, for bits that differ leave no whole block alike; trees, work units and stars are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import byte_texts, carried
from tessera.shipping import ship
from tessera.sources.store import dropped, written

#: Fingerprints to a tree, and so at most about twice that to a work unit.
SHARD = 4096


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split() if text else []  # on bytes both touch ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), 42)
    counts = np.zeros(64, np.int64)
    n = len(words) - size + 1
    for at in range(0, n, 65536):
        part = words[at : at + 65536 + size - 1]
        hashes = np.array([digest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(size)), strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, carry: Column | None, name: str, size: int = 3) -> DataFrame:
    """`carry` (or the whole row) as `name`, and its fingerprint as a signed long in `_fp`."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), size) for t in byte_texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], [name, "_fp"])

    rows = carried(docs, carry, name)
    return rows.mapInArrow(run, f"`{name}` {rows.schema[0].dataType.simpleString()}, _fp long")


class BKTree:
    """Fingerprints whose children are keyed by integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        """The node of value, added if it is new."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            if not d:
                return node
            child = self.children[node].get(d)
            if child is None:
                self.children[node][d] = new = len(self.values)
                self.values.append(value)
                self.children.append({})
                return new
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most radius away."""
        if not self.values:
            return []
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            below = children[node]
            if below:
                low, high = d - radius, d + radius
                todo += [c for e, c in below.items() if low <= e <= high]
        return found


def local_stars(tree: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root) for the links between queries and tree, or within the tree where queries is None."""
    bk, parent = BKTree(), {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent[p]
            x = p
        return x

    def link(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if queries is None:
        for v in tree:
            for node in bk.within(v, radius):
                link(v, bk.values[node])
            bk.insert(v)
    else:
        for v in tree:
            bk.insert(v)
        for v in queries:
            for node in bk.within(v, radius):
                link(v, bk.values[node])
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def blocks_for(n: int, radius: int) -> int:
    """As many bit blocks as keep a shard of n evenly spread fingerprints near a thousand, up to radius + 4."""
    for extra in (1, 2, 3):
        if n / 2.0 ** (64 * extra / (radius + extra)) <= 1024:
            return radius + extra
    return radius + 4


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """The shards of a fingerprint: the value of each choice of blocks-radius blocks, and which choice that is."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in chosen]) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))])


_UNIT = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _unit_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of work units that come sorted by (shard, tree, part). role: 0 a tree's own row, 1 its queries."""
    held: list[np.ndarray] | None = None

    def links(columns: list[np.ndarray]) -> tuple[list, list]:
        a, b = [], []
        shard, tree, part, role, fp = columns
        n = len(fp)
        if n < 2:
            return a, b
        edge = (shard[1:] != shard[:-1]) | (tree[1:] != tree[:-1]) | (part[1:] != part[:-1])
        starts = np.concatenate([[0], np.flatnonzero(edge) + 1, [n]])
        many = np.flatnonzero(np.diff(starts) > 1)
        unsigned = fp.view(np.uint64)
        for i in many:
            lo, hi = starts[i], starts[i + 1]
            values, asks = unsigned[lo:hi], role[lo:hi] == 1
            if tree[lo] == part[lo]:
                stars = local_stars(values.tolist(), None, radius)
            else:
                stars = local_stars(values[~asks].tolist(), values[asks].tolist(), radius)
            for x, r in stars:
                a.append(x)
                b.append(r)
        return a, b

    def batch(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], schema=_UNIT)

    for got in batches:
        now = [got.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(now[0]):
            continue
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [c[cut:] for c in now]
        if cut:
            yield batch(*links([c[:cut] for c in now]))
    if held is not None:
        yield batch(*links(held))


def links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(a, b) whose components are those of all pairs of distinct fingerprints `_fp` within radius."""
    blocks = blocks_for(fps.count(), radius)
    keyed = fps.select("_fp", F.explode(shard_keys(F.col("_fp"), blocks, radius)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").withColumn("trees", F.ceil(F.col("n") / shard).cast("int"))
    whole = keyed.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("_fp", F.lit(7)), F.col("trees")).cast("int"))
    # A tree's rows meet the parts from its own on; a part's rows meet the trees up to its own. The meeting with itself is one row.
    dealt = whole.select(
        "shard", "_fp",
        F.explode(
            F.concat(
                F.transform(F.sequence(F.col("own"), F.col("trees") - 1), lambda i: F.struct(F.col("own").alias("tree"), i.alias("part"), F.lit(0).alias("role"))),
                F.transform(F.filter(F.sequence(F.lit(0), F.col("own")), lambda j: j < F.col("own")), lambda j: F.struct(j.alias("tree"), F.col("own").alias("part"), F.lit(1).alias("role"))),
            )
        ).alias("u"),
    )
    units = dealt.select("shard", "u.tree", "u.part", "u.role", "_fp").repartition("shard", "tree", "part").sortWithinPartitions("shard", "tree", "part", "_fp")
    return units.mapInArrow(lambda it: _unit_links(it, radius), "a long, b long")


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, m): each node of a component but its smallest, and that smallest. Alternating stars, a written table a round."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    mark = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)))
    before = None
    for _ in range(most_rounds):
        now = edges.agg(mark.alias("x")).first()["x"]
        if now == before or not now[0]:
            out = edges.withColumnRenamed("v", "m")
            out._written_at = edges._written_at
            return out
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old = edges
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
        dropped(old)
    raise RuntimeError("components have not settled")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """doc_id, _fp, component_id for every row of docs: component_id is the smallest doc_id reachable through
    fingerprints at most radius bits apart, its own included.

    Null or wordless text: fingerprint 0, linked like any other. Repeated rows are returned once each. A null doc_id takes part but
    is never a component's id, unless the whole component has none. Very long texts are read whole. Empty table: no rows.
    Columns beyond doc_id and text are ignored."""
    prints = written(with_fingerprints(docs, F.col("doc_id").cast("long"), "doc_id", size), "fingerprints")
    nodes = prints.groupBy("_fp").agg(F.min("doc_id").alias("least"))
    star = stars(links(nodes.select("_fp"), radius))
    # The linked fingerprints, each with its component's smallest node, then that component's smallest doc_id.
    member = star.select(F.col("u").alias("_fp"), "m").union(star.select(F.col("m").alias("_fp"), "m").distinct())
    named = member.join(nodes, "_fp")
    best = named.groupBy("m").agg(F.min("least").alias("component"))
    renamed = written(named.join(best, "m").select("_fp", "component"), "components")
    # Written, so that both sides of the last join are plain scans and a fingerprint with very many copies can be split.
    label = written(nodes.join(renamed, "_fp", "left").select("_fp", F.coalesce("component", "least").alias("component_id")), "labels")
    for done in (star, renamed):
        dropped(done)
    return prints.join(label, "_fp").select("doc_id", "_fp", "component_id")


#: Bits of a wide fingerprint, and the distance at which two are linked. Sets of shingles with a Jaccard similarity J differ by BITS * acos(2J / (1 + J)) / pi bits on average, by 311
#: at 0.8 and 353 at 0.75, give or take 16.
BITS, RADIUS = 2048, 318
#: A shard of wide fingerprints is a run of ROWS least hashes that two texts share; each text is in BANDS shards.
BANDS, ROWS = 8, 3
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SEEDS = mixed(np.arange(1, BITS // 64 + BANDS * ROWS + 1, dtype=np.uint64) * _STEP)
_TIES = np.unpackbits(_SEEDS[: BITS // 64].astype("<u8").view(np.uint8), bitorder="little")


def wide_fingerprint(text: bytes | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(a SimHash of BITS bits as signed longs, shard keys) of the set of a text's word shingles.

    A text of fewer words has one shingle, a wordless text an empty one. Even splits take a fixed bit."""
    words = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    grams = np.unique(np.fromiter((digest(b" ".join(s), 42) for s in (zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words])), np.uint64, n))
    counts, least = np.zeros(BITS, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 255):  # as many as a byte counts
        part = grams[at : at + 255]
        bits = mixed(part[:, None] ^ _SEEDS[None, : BITS // 64])
        counts += np.unpackbits(bits.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
        least = np.minimum(least, mixed(part[None, :] ^ _SEEDS[BITS // 64 :, None]).min(1))
    halves = 2 * counts - len(grams)
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = mixed(key * _STEP + least[r::ROWS])
    return np.packbits((halves > 0) | ((halves == 0) & (_TIES > 0)), bitorder="little").view("<i8"), key.view(np.int64)


_NODE = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("_fp", pa.int64()), ("_wide", pa.list_(pa.int64())), ("_bands", pa.list_(pa.int64()))])


def wide_prints(docs: DataFrame, size: int = 5) -> DataFrame:
    """_id (doc_id), _th (a hash of the text), _fp (a hash of the wide fingerprint), _wide, _bands for every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, bands = zip(*(wide_fingerprint(t.as_py(), size) for t in batch.column(2)), strict=True) if batch.num_rows else ((), ())
            fps = pa.array(np.array([xxhash.xxh64_intdigest(w.tobytes(), 7) for w in wide], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, pa.array(list(wide), pa.list_(pa.int64())), pa.array(list(bands), pa.list_(pa.int64()))], schema=_NODE)

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "_id long, _th long, _fp long, _wide array<long>, _bands array<long>")


def apart(a: Column, b: Column) -> Column:
    """Bits in which two wide fingerprints differ."""
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def _wide_units(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of work units that come sorted by (shard, tree, part): their queries (role 1) are looked up in a tree of the others."""

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        value = lambda wide: int.from_bytes(np.array(wide, "<i8").tobytes(), "little")
        names = {value(w): fp for *_, fp, w in rows}
        stars = local_stars([value(w) for *_, role, _, w in rows if role == 0], [value(w) for *_, role, _, w in rows if role == 1], radius)
        return [names[x] for x, _ in stars], [names[r] for _, r in stars]

    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for _, group in groupby(rows, lambda row: row[:3]):
        a, b = links(list(group))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b)], schema=_UNIT)


def wide_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) whose components are those of all pairs of nodes (_fp, _wide, _bands) that share a shard and are within radius.

    First every node is compared with one of its shard, which ties a group of near copies of any size together in one pass. What is left are shards that
    hold several components. The nodes beside the largest component are looked up in BK-trees of all, however full the shard is: work units of about `shard` nodes bound
    a task's memory, not what is compared, so the links don't depend on the input's size or on `shard`."""
    keyed = nodes.select("_fp", F.explode("_bands").alias("shard"))
    firsts = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.min("_fp").alias("first")).where("n > 1").select("shard", "first")
    shared = written(keyed.join(firsts, "shard"), "shared")
    wide = nodes.select("_fp", "_wide")
    asked = shared.where("_fp != first").select("_fp", "first").distinct()
    both = asked.join(wide, "_fp").join(wide.select(F.col("_fp").alias("first"), F.col("_wide").alias("_first")), "first")
    near = stars(both.where(apart(F.col("_wide"), F.col("_first")) <= radius).select(F.col("_fp").alias("a"), F.col("first").alias("b")))
    member = near.select(F.col("u").alias("_fp"), "m")
    # A node's component, by its smallest node.
    parted = written(shared.select("shard", "_fp").join(member, "_fp", "left").withColumn("m", F.coalesce("m", "_fp")), "parted")
    sizes = parted.groupBy("shard", "m").agg(F.count("*").alias("n")).groupBy("shard").agg(F.sum("n").alias("all"), F.max(F.struct("n", "m")).alias("top"), F.count("*").alias("components"))
    mixed_shards = sizes.where("components > 1").select("shard", F.col("top.m").alias("top"), (F.col("all") - F.col("top.n")).alias("rest"))
    units = parted.join(mixed_shards, "shard").join(sizes.select("shard", "all"), "shard")
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / shard)).cast("int")
    units = units.withColumn("trees", cut("all")).withColumn("parts", cut("rest"))
    own = lambda n: F.pmod(F.xxhash64("_fp", F.lit(7)), F.col(n)).cast("int")
    tree = units.select("shard", own("trees").alias("tree"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "_fp")
    asks = units.where("m != top").select("shard", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), own("parts").alias("part"), F.lit(1).alias("role"), "_fp")
    dealt = tree.unionByName(asks).join(wide, "_fp").select("shard", "tree", "part", "role", "_fp", "_wide").repartition("shard", "tree", "part").sortWithinPartitions("shard", "tree", "part", "role", "_fp")
    found = dealt.mapInArrow(lambda it: _wide_units(it, radius), "a long, b long")
    return near.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(found)


def one_of_each(docs: DataFrame, radius: int = RADIUS, size: int = 5, shard: int = SHARD) -> DataFrame:
    """docs with one row of each near-duplicate group, with all its columns, whatever their names: that of the group's smallest doc_id.

    Groups are components of wide fingerprints of five-word shingles within radius, which stands for a Jaccard similarity of 0.8. Null or wordless
    texts are copies of each other. Of several texts with the smallest doc_id, and of rows that repeat it, one stays; a null doc_id is chosen only in a group that has no other. Very long
    texts are read whole. Empty table: no rows. Texts are fingerprinted once and shuffled once."""
    prints = written(wide_prints(docs, size), "prints")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_th")
    nodes = written(prints.groupBy("_fp").agg(F.min(order).alias("least"), F.first("_wide").alias("_wide"), F.first("_bands").alias("_bands")), "nodes")
    star = stars(wide_links(nodes, radius, shard))
    member = star.select(F.col("u").alias("_fp"), "m")
    best = nodes.select("_fp", "least").join(member, "_fp", "left").groupBy(F.coalesce("m", "_fp").alias("m")).agg(F.min("least").alias("least"))
    picked = best.select(F.col("least._id").alias("_i"), F.col("least._th").alias("_t"), F.lit(True).alias("_picked"))
    pairs = prints.groupBy("_id", "_th").agg(F.count("*").alias("n"))
    verdict = pairs.join(picked, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    out = written(verdict.where("_picked IS NULL OR n > 1").select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), F.col("_picked").isNotNull().alias("_several")), "dropped")
    for done in (prints, nodes, star):
        dropped(done)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("_id", F.col("row.doc_id").cast("long")).withColumn("_th", F.xxhash64("row.text"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))
    # Texts are shuffled once at every size: what is dropped grows with the input, and a plan that sends it around would be gone on larger tables.
    kept = rows.join(out.hint("merge"), same, "left_anti").select("row.*")
    several = out.where("_several")
    if several.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.xxhash64(F.to_json("row"))))
    return kept.unionByName(rows.join(several, same, "left_semi").withColumn("_first", first).where("_first = 1").select("row.*"))
