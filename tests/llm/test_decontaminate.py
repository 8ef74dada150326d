import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate as D

WORDS = [f"t{i}" for i in range(400)]


def plain_tiles(item, text, size):
    """Greedy string tiling as published: scan everything, mark the longest runs, repeat."""
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n >= size:
                    best.append((-n, i, j))
        if not best:
            return out
        n, i, j = min(best)
        out.append((i, j, -n))
        for k in range(-n):
            a[i + k] = b[j + k] = True


def seeds(item, text, size):
    return [(j, i) for i in range(len(item) - size + 1) for j in range(len(text) - size + 1) if item[i : i + size] == text[j : j + size]]


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=20))
@settings(max_examples=300, deadline=None)
def test_tiles_are_those_of_the_plain_algorithm(item, text):
    got = D.tiles(item, text, seeds(item, text, 2), 2)
    assert sorted(got) == sorted(plain_tiles(item, text, 2))


@given(st.lists(st.sampled_from("abc"), max_size=24), st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 4))
@settings(max_examples=400, deadline=None)
def test_running_tiles_are_those_of_the_plain_algorithm(item, text, size):
    assert D.running_tiles(D.word_hashes(item), D.word_hashes(text), size) == plain_tiles(item, text, size)


@given(st.lists(st.text("ab 漢字", min_size=1, max_size=30), max_size=6), st.text("ab 漢字", max_size=60))
@settings(max_examples=300, deadline=None)
def test_matches_are_those_of_the_plain_algorithm(items, text):
    words, want = D.tokens(text), []
    for k, t in enumerate(items):
        if item := D.tokens(t):
            found = plain_tiles(item, words, min(D.SEED, len(item)))
            tiled = sum(n for _, _, n in found)
            if tiled and tiled >= 0.5 * len(item):
                want.append((k, len(item), tiled, len(found), tiled / len(item)))
    assert D.Index(list(enumerate(items))).matches(text, 0.5) == want


def test_short_and_unspaced_items_are_found_whole():
    long = "请问地球到太阳的平均距离大约是多少公里请选择正确的答案并说明理由"
    index = D.Index([(1, "what is two plus"), (2, long), (3, "ok"), (4, "?!")])
    assert index.matches("what is two plus", 0.5) == [(1, 4, 4, 1, 1.0)]
    assert index.matches(f"前言{long}后记", 0.5) == [(2, len(long), len(long), 1, 1.0)]
    assert index.matches(f"他说{long[16:]}又说{long[:16]}", 0.5) == [(2, len(long), len(long), 2, 1.0)]
    assert index.matches("two plus what is", 0.5) == [] == index.matches("okay ?!", 0.5)
    assert index.matches("it is OK.", 0.5) == [(3, 1, 1, 1, 1.0)]
    assert D.tokens("abc 漢字def ภา") == ["abc", "漢", "字", "def", *D.tokens("ภา")]


def test_repetitive_texts_take_near_linear_time():
    for item, text in (("a " * 800, "a " * 8000), ("a b " * 400, "b a " * 4000), ("a a b " * 300, "a b " * 20_000)):
        index = D.Index([(1, item)])
        began = time.perf_counter()
        got = index.matches(text, 0.5)
        assert time.perf_counter() - began < 0.5
        assert (len(got) == 1) == (item.split()[:3] != ["a", "a", "b"])


@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=14), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=40), st.sampled_from([0.0, 0.3, 0.5, 0.8, 1.0]))
@settings(max_examples=300, deadline=None)
def test_rare_seeds_lose_nothing(items, text, threshold):
    """Items that share most of their seeds, at several thresholds, with seeds of two tokens."""
    want = []
    for k, item in enumerate(items):
        found = plain_tiles(item, text, min(2, len(item)))
        tiled = sum(n for _, _, n in found)
        if tiled and tiled >= threshold * len(item):
            want.append((k, len(item), tiled, len(found), tiled / len(item)))
    assert D.Index([(k, " ".join(i)) for k, i in enumerate(items)], 2).matches(" ".join(text), threshold) == want


def test_a_stem_that_all_items_share_costs_nothing():
    rng = random.Random(3)
    names = [f"n{k}" for k in range(30_000)]
    stem = "which of the following statements about"
    items = [(k, f"{stem} {' '.join(rng.choices(names, k=9))}") for k in range(50_000)]
    index = D.Index(items)
    assert index.matches(f"{stem} {items[7][1][len(stem) :]}", 0.5)[0][0] == 7
    began = time.perf_counter()
    for _ in range(20):
        assert index.matches(f"someone asked {stem} the moon is true", 0.5) == []
    assert (time.perf_counter() - began) / 20 < 0.005
    assert [m[0] for m in index.matches(f"{stem} as {items[31][1]} said", 0.5)] == [31]


def test_reordered_and_edited_passages():
    item = WORDS[:40]
    index = D.Index([(9, " ".join(item))])
    around = WORDS[100:200]
    mixed = [*around[:30], *item[20:40], *around[30:60], *item[:20]]
    assert index.matches(" ".join(mixed), 0.5) == [(9, 40, 40, 2, 1.0)]
    edited = [w if i % 9 else "zz" for i, w in enumerate(item)]
    assert index.matches("x, " + ", ".join(edited).upper(), 0.5)[0][0] == 9
    assert index.matches(" ".join(around + item[:12]), 0.5) == []
    assert index.matches(" ".join(reversed(item)), 0.5) == []


def test_blocks_say_the_same(spark):
    rng = random.Random(5)
    bench = spark.createDataFrame([(k, " ".join(rng.choices(WORDS, k=30))) for k in range(20)], "item_id long, text string")
    whole = [b for b in D.blocks(bench)]
    parts = list(D.blocks(bench, 700))
    assert len(whole) == 1 and len(parts) > 3 and sorted(x for p in parts for x in p) == whole[0]


def test_several_blocks_clean_alike(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(r["doc_id"] for r in D.clean(docs, bench).collect())
    found = sorted(D.contaminated(docs, bench).collect())
    real = D.blocks
    monkeypatch.setattr(D, "blocks", lambda b: real(b, 2000))
    assert len(list(D.blocks(bench))) > 2
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == whole and sorted(D.contaminated(docs, bench).collect()) == found


def test_against_plain_on_the_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: D.tokens(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        words = D.tokens(r["text"])
        have = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for k, item in items.items():
            if any(tuple(item[i : i + 5]) in have for i in range(len(item) - 4)):
                tiled = sum(t[2] for t in D.tiles(item, words, seeds(item, words, 5), 5))
                if tiled >= 0.5 * len(item):
                    want.add((r["doc_id"], k, len(item), tiled))
    got = {(r["doc_id"], r["item_id"], r["item_tokens"], r["tiled_tokens"]) for r in D.contaminated(docs, bench).collect()}
    assert got == want
    assert {r["doc_id"] for r in D.clean(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - {k for k, *_ in want}


def test_edge_rows(spark):
    item = " ".join(WORDS[:20])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "too short"), (4, "")], "item_id long, text string")
    rows = [(1, item, "h"), (1, item, "h"), (2, None, "h"), (3, "", "h"), (None, item, "h"), (4, "filler " * 200_000 + item, "h"), (5, "too short", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in D.contaminated(df, bench).collect()) == [(0, 1), (1, 1), (1, 1), (4, 1), (5, 3)]
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0
    assert D.clean(df, bench.limit(0)).count() == len(rows)
