import sys

from tessera.llm import decontaminate, language_id, quality_rules, registry, simhash
from tessera.llm.sampling import fold


def test_stages_and_their_effects(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    left = {r["doc_id"]: r for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.judge(now, quality_rules.fit(now, labels)).collect() if r["kept"]}
        elif name == "language_id":
            found = language_id.identify(now, language_id.fit(now, fold(now["doc_id"], 5) != 0), now["doc_id"], "doc_id").collect()
            want = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
        elif name == "simhash_near_dedup":
            rows = now.collect()
            fps = [int.from_bytes(simhash.wide_fingerprint(r["text"].encode())[0].tobytes(), "little") for r in rows]
            low = {r["doc_id"]: r["doc_id"] for r in rows}
            moved = True
            near = [(rows[i]["doc_id"], rows[j]["doc_id"]) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS]
            while moved:
                moved = False
                for a, b in near:
                    if low[a] != low[b]:
                        low[a] = low[b] = min(low[a], low[b])
                        moved = True
            want = set(low.values())
        else:
            want = {r["doc_id"] for r in now.collect()} - {r["doc_id"] for r in decontaminate.contaminated(now, bench).collect()}
        got = [r["doc_id"] for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) < len(left)
        left = {k: left[k] for k in want}
        now = out
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(left)


def test_queries_are_registered():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    sys.path.insert(0, "/root/repo")
    import __spark_entry__

    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stages_on_edge_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, very long and empty texts, an empty table, and columns named like those the stages make."""
    import corpus_pipeline

    words = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when".split()
    text = " ".join(w + c for c in ("", "x", "yz") for w in words)
    long = " ".join(f"{w}{i}" for i in range(2000) for w in words)
    item = " ".join(f"item{i}" for i in range(30))
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, stat string, _fp long, hits string, score double, lang_pred string, doc string, _key string"
    rest = (None, "r", "s", 1, "h", 0.5, "l", "d", "k")
    rows = [(1, text, "en", "a", *rest), (1, text, "en", "a", *rest), (2, text + " more", None, None, *rest), (3, None, None, None, *rest), (4, "", "en", "a", *rest), (None, text + " null id here", "en", "a", *rest)]
    rows += [(5, long, "en", "a", *rest), (6, " ".join(reversed(text.split())) + " " + item, "en", "a", *rest), (7, "der die das und " * 3 + " ".join(f"wort{i}en" for i in range(60)), "de", "a", *rest)]
    docs = spark.createDataFrame(rows, names)
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (1, item), (None, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for at, table in (("full", docs), ("none", docs.limit(0))):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{at}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{at}/{name}")
            if name != "packing":
                assert out.columns == docs.columns
                if at == "full":
                    left = sorted((r["doc_id"] or 0) for r in out.collect())
                    assert left == {"quality_rules": [0, 1, 1, 2, 5, 6, 7], "language_id": [0, 1, 1, 2, 5, 6, 7]}.get(name, left), name
                    assert len(left) == len(set(left)) or name in ("quality_rules", "language_id")
            now = out
        got = {r["doc_id"] for r in now.collect()}
        assert got == set() if at == "none" else {1, 5, 7} <= got and 6 not in got
