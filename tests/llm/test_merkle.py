import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

DOCS = "doc_id long, source string, text string, leaf string, root int"


def plain_tree(leaves, fan):
    """Root and, for each leaf, the siblings level by level."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i // fan * fan
            proofs[k].append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + fan])))
            at[k] = i // fan
        nodes = [hashlib.sha256("".join(nodes[a : a + fan]).encode()).hexdigest() for a in range(0, len(nodes), fan)]
    return nodes[0], proofs


def plain_manifest(rows, fan):
    """{(source, place): (doc_id, leaf, subroot, root, proof)} of rows (doc_id, source, text)."""
    def item(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), hashlib.sha256("".join(map(item, r)).encode()).hexdigest(), r[0]))
    trees = {s: plain_tree([x[1] for x in sorted(v)], fan) for s, v in by.items()}
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    root, above = plain_tree([trees[s][0] for s in order], fan)
    return {(s, i): (x[2], x[1], trees[s][0], root, trees[s][1][i] + above[order.index(s)]) for s in by for i, x in enumerate(sorted(by[s]))}


@pytest.mark.parametrize("fan,depth,sizes", [(2, 1, {"a": 9, "b": 1}), (3, 2, {"a": 40, None: 9, "é": 10, "": 1}), (16, 3, {"a": 70, "z": 17})])
def test_against_a_plain_tree(spark, fan, depth, sizes):
    rows = [(i, s, f"Text {i}") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(3)
    got = merkle.manifest(docs, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text")), fan=fan, depth=depth)
    found = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("digest", merkle.proof_digest(F.col("proof"))).collect()
    want = plain_manifest(rows, fan)
    assert len(found) == len(rows)
    for r in found:
        doc_id, leaf, subroot, root, proof = want[r["source"], r["position"]]
        assert (r["doc_id"], r["leaf"], r["subroot"], r["root"]) == (doc_id, leaf, subroot, root)
        assert [tuple(x) for x in r["proof"]] == proof and r["folded"] == root
        assert r["digest"] == hashlib.sha256("".join(a + b for a, b in proof).encode()).hexdigest()


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None), (None, "s", ""), (1, "s", "x"), (1, "s", "x"), (1, "s", "y"), (2, "s", "é" * 300_000), (-5, "s", None)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    found = merkle.manifest(docs, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text")), fan=2, depth=2).collect()
    want = plain_manifest(rows, 2)
    assert sorted((str(r["source"]), r["position"], r["leaf"], r["root"]) for r in found) == sorted((str(k[0]), k[1], v[1], v[3]) for k, v in want.items())


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, "s", t, None, None) for i, t in enumerate(["Some", "none", None, "A"] * 10)], DOCS)
    seen = merkle.leaf(F.col("doc_id"), F.lower("text"))
    found = merkle.manifest(docs, merkle.leaf(F.col("doc_id"), F.col("text")), seen=seen)
    found = found.select("doc_id", (merkle.folded(F.col("seen"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert {r["doc_id"]: r["same"] for r in found} == {i: i % 4 in (1, 2) for i in range(40)}


def test_values_cannot_run_into_each_other(spark):
    one = spark.sql("SELECT 'a' x, 'b1:c' y UNION ALL SELECT 'ab', '1:c' UNION ALL SELECT 'a1:b', 'c' UNION ALL SELECT NULL, '-' UNION ALL SELECT '-', NULL")
    assert one.select(merkle.leaf(F.col("x"), F.col("y"))).distinct().count() == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert merkle.manifest(docs, merkle.leaf(F.col("text"))).count() == 0


def test_query_against_sql(spark):
    import duckdb

    from tessera.llm import registry

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    found = registry.op12_merkle_manifest(spark, folder)
    want = db.execute(registry.op12_sql())
    names = [x[0] for x in want.description]
    rows = found.select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    assert {r["doc_id"] for r in rows if not r["verified"]} <= {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
