"""Merkle manifest of a dataset: a digest for every row, every source and the whole, and each row's proof of membership.

The rows of a source are the leaves of a tree in which every run of `fan` consecutive nodes becomes one node, its digest; the sources' roots are the leaves
of a last tree. A tree of any size is cut into aligned blocks of fan**DEPTH leaves. A block is traversed in postorder by one recursion, which returns the
subtree's digest and appends the siblings at each level to the leaves below while it unwinds. The blocks' roots are the leaves of the next,
equally distributed traversal, until one node is left. Proofs then go down the same way: a block receives the proof of its root, and adds its own levels.
A task holds one block, whatever the size of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.columns import global_row_number
from tessera.shipping import ship
from tessera.sources.store import written

#: Children of a node, and levels of a block.
FAN, DEPTH = 16, 3
#: For each level from the leaf up, the digests of the other nodes of its run: those before it and those after it, joined.
PROOF = "array<struct<left string, right string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def heights(nodes: int, fan: int = FAN, depth: int = DEPTH) -> int:
    """Levels that a block of a tree of so many nodes has: as many as lead to one node, at most depth."""
    n = 0
    while nodes > 1 and n < depth:
        nodes, n = -(-nodes // fan), n + 1
    return n


def traverse(nodes: list[str], height: int, fan: int = FAN, proofs: list[list] | None = None) -> str:
    """The digest over a block's nodes, `height` levels above them; with `proofs`, a list for each node, its siblings are appended there."""

    def visit(low: int, high: int, level: int) -> str:
        if not level:
            return nodes[low]
        step = fan ** (level - 1)
        starts = range(low, high, step)
        below = [visit(a, min(a + step, high), level - 1) for a in starts]
        if proofs is not None:
            for i, a in enumerate(starts):
                siblings = ("".join(below[:i]), "".join(below[i + 1 :]))
                for leaf in range(a, min(a + step, high)):
                    proofs[leaf].append(siblings)
        return digest(*below)

    return visit(0, len(nodes), height)


def field(column: Column) -> Column:
    """A value as text that no other value shares: its bytes are counted, null is a dash."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def proof_digest(proof: Column) -> Column:
    """One digest for all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(proof, start, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]).cast("binary"), 256))


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["idx"].to_numpy(), kind="stable")))


def _raised(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """One node for each block of nodes (tree, idx, digest, total)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _ordered(pa.Table.from_batches(batches))
        total, block = rows["total"][0].as_py(), rows["block"][0].as_py()
        root = traverse(rows["digest"].to_pylist(), heights(total, fan, depth), fan)
        yield pa.RecordBatch.from_pylist([{"tree": rows["tree"][0].as_py(), "idx": block, "digest": root, "total": -(-total // fan**depth)}], _NODES)

    blocks = nodes.select("tree", "idx", "digest", "total", F.expr(f"idx div {fan**depth}").alias("block")).groupBy("tree", "block")
    return blocks.applyInArrow(one, "tree long, idx long, digest string, total long")


_NODES = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("digest", pa.string()), ("total", pa.int64())])


def _lowered(fan: int, depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block's nodes and the proof of its root: every node with its proof."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        rows = _ordered(nodes)
        proofs: list[list] = [[] for _ in range(rows.num_rows)]
        traverse(rows["digest"].to_pylist(), heights(rows["total"][0].as_py(), fan, depth), fan, proofs)
        rest = [(x["left"], x["right"]) for x in above["proof"][0].as_py()]
        columns = {"tree": rows["tree"], "idx": rows["idx"], "digest": rows["digest"], "proof": pa.array([p + rest for p in proofs], _PROOF)}
        columns["root"] = pa.array([above["root"][0].as_py()] * rows.num_rows, pa.string())
        return pa.table(columns | ({"payload": rows["payload"]} if "payload" in rows.column_names else {}))

    return run


class Forest:
    """The traversals from leaves (tree, idx, digest, total) to one root a tree; each is written, so a lost executor repeats one at most."""

    def __init__(self, leaves: DataFrame, fan: int, depth: int):
        self.fan, self.depth, self.layers = fan, depth, [leaves]
        while True:
            up = written(_raised(self.layers[-1], fan, depth), "nodes")
            self.layers.append(up)
            if (up.agg(F.max("total").alias("most")).first()["most"] or 1) == 1:
                break

    @property
    def roots(self) -> DataFrame:
        return self.layers[-1]

    def proofs(self, above: DataFrame) -> DataFrame:
        """(tree, idx, digest, proof, root, payload if there is one) of every leaf, given (tree, idx, proof, root) of the roots."""
        for layer in self.layers[-2::-1]:
            carried = f", payload {layer.schema['payload'].dataType.simpleString()}" if "payload" in layer.columns else ""
            nodes = layer.withColumn("block", F.expr(f"idx div {self.fan**self.depth}")).groupBy("tree", "block")
            blocks = above.select("tree", F.col("idx").alias("block"), "proof", "root").groupBy("tree", "block")
            above = nodes.cogroup(blocks).applyInArrow(_lowered(self.fan, self.depth), f"tree long, idx long, digest string, proof {PROOF}, root string{carried}")
            if layer is not self.layers[0]:
                above = written(above, "proofs")
        return above


def manifest(rows: DataFrame, digest_of: Column, key: str = "doc_id", by: str = "source", fan: int = FAN, depth: int = DEPTH, **carry: Column) -> DataFrame:
    """Of every row: key (long), by, position (in its source, from 0), leaf, proof, subroot, root, and the columns of `carry`.

    Leaves ascend by key, null keys first; rows with the same key by digest, so that repeated rows are leaves of their own in a defined order. Null is a
    source like any other, the first; sources ascend by their UTF-8 bytes. A text of any length, null or empty, is hashed whole by Spark's own functions before any
    shuffle, which then moves digests. Other columns, whatever their names, are ignored. A source of one row has that leaf as its root. Empty table: no rows."""
    ship(rows.sparkSession)
    source, ident = F.col(f"`{by}`").cast("string"), F.col(f"`{key}`").cast("long")
    payload = F.struct(ident.alias("key"), source.alias("by"), *[c.alias(f"carry_{k}") for k, c in carry.items()])
    ranked = global_row_number(rows.select(source.alias("by"), ident.alias("key"), digest_of.alias("digest"), payload.alias("payload")), "place", "by", "key", "digest")
    # A source is named by its first row's place, so names ascend as sources do and none is null.
    sources = written(ranked.groupBy(F.col("by").alias("of")).agg(F.min("place").alias("tree"), F.count("*").alias("total")), "sources")
    leaves = ranked.join(sources, ranked["by"].eqNullSafe(sources["of"])).select("tree", (F.col("place") - F.col("tree")).alias("idx"), "digest", "total", "payload")
    trees = Forest(leaves, fan, depth)
    subroots = global_row_number(trees.roots.select(F.col("tree").alias("payload"), "digest"), "idx", "payload")
    top = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), "idx", "digest", F.lit(sources.count()).cast("long").alias("total"), "payload"), fan, depth)
    of_sources = top.proofs(top.roots.select("tree", "idx", F.expr(f"CAST(array() AS {PROOF})").alias("proof"), F.col("digest").alias("root")))
    found = trees.proofs(of_sources.select(F.col("payload").alias("tree"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("root")))
    root = top.roots.first()
    columns = [F.col("payload.key").alias(key), F.col("payload.by").alias(by), F.col("idx").alias("position"), F.col("digest").alias("leaf"), "proof", F.col("root").alias("subroot")]
    return found.select(*columns, F.lit(root["digest"] if root else None).cast("string").alias("root"), *[F.col(f"payload.carry_{k}").alias(k) for k in carry])
