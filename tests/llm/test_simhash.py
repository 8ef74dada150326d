import math
import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash as S
from tessera.llm.simhash import BKTree, blocks_for, fingerprint, links, near_duplicates, one_of_each, stars


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, radius=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return [least[find(i)] for i in range(len(fps))]


@given(st.text(alphabet="aAbÄé \t\n\x0b\x1f\x85\xa0", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_bk_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:40]:
        assert {tree.values[n] for n in tree.within(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_with_split_shards(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        v = b
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    want = plain_components(values, [signed(v) for v in values])
    df = spark.createDataFrame([(signed(v),) for v in values], "_fp long")
    for shard in (4, 4096):
        got = {r["u"]: r["m"] for r in stars(links(df, 3, shard)).collect()}
        assert [got.get(signed(v), signed(v)) for v in values] == want


def test_blocks_grow_with_the_table():
    assert [blocks_for(n, 3) for n in (0, 10**6, 10**9, 10**11)] == [4, 4, 5, 6]


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], zip(map(signed, fps), plain_components(fps, [r["doc_id"] for r in rows]), strict=True), strict=True))
    assert {r[0]: (r[1], r[2]) for r in near_duplicates(docs).collect()} == want


def jaccard(a, b):
    sets = []
    for t in (a, b):
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def kept_by_brute_force(rows, linked):
    low = [k for k, _ in rows]
    moved = True
    near = [(i, j) for i in range(len(rows)) for j in range(i) if linked(rows[i][1], rows[j][1])]
    while moved:
        moved = False
        for i, j in near:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                moved = True
    return sorted(set(low))


def wide(text):
    return int.from_bytes(S.wide_fingerprint(text.encode())[0].tobytes(), "little")


def test_one_of_each_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = {t: wide(t) for _, t in rows}
    want = kept_by_brute_force(rows, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= S.RADIUS)
    for shard in (3, 4096):
        kept = one_of_each(docs, shard=shard)
        assert kept.columns == docs.columns
        got = sorted(r["doc_id"] for r in kept.collect())
        assert got == want if shard > 3 else len(set(got) ^ set(want)) <= 2  # a cut shard is searched by further least hashes
    exact = kept_by_brute_force(rows, lambda a, b: a[:20] == b[:20] and jaccard(a, b) >= 0.8)
    assert abs(len(exact) - len(want)) <= 0.01 * len(rows)


def test_distance_tells_similarity():
    rng = random.Random(11)
    for edits, size in ((2, 400), (8, 400), (10, 400), (20, 400), (3, 100)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        near = list(base)
        for i in rng.sample(range(size), edits):
            near[i] = "changed"
        a, b = " ".join(base), " ".join(near)
        j, d = jaccard(a, b), (wide(a) ^ wide(b)).bit_count()
        expected = S.BITS * math.acos(2 * j / (1 + j)) / math.pi
        assert abs(d - expected) < 75, (j, d, expected)
    assert wide("") == wide(" \n") != wide("a") and wide("one two three") == wide("ONE two  three")


def test_near_copies_in_one_shard_are_tied_in_one_pass(spark):
    """Hundreds of near copies beside hundreds of texts that share but a passage with them."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    base = passage + [word() for _ in range(140)]
    rows = []
    for k in range(300):
        edited = list(base)
        edited[rng.randrange(len(base))] = word()
        rows.append((k, " ".join(edited)))
    rows += [(1000 + k, " ".join(passage + [word() for _ in range(60)])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (50, 4096):
        assert sorted(r["doc_id"] for r in one_of_each(docs, shard=shard).collect()) == [0, *range(1000, 1300)]


def test_rows_that_repeat_the_kept_one(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(4, text, "x", {"k": 1}), (4, text, "x", {"k": 1}), (4, text, "y", {"k": 2}), (4, other, "z", None), (9, other, "z", None), (None, text, "n", None), (None, text.replace("a", "q"), "n", None), (None, text.replace("a", "q"), "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _th string, _i map<string, int>")
    a, b = ([tuple(r) for r in one_of_each(docs.repartition(n)).orderBy("doc_id", "text").collect()] for n in (1, 5))
    assert a == b and [(r[0], r[1]) for r in a] == [(None, text.replace("a", "q")), (4, text), (4, other)]


def test_edge_rows(spark):
    text = "one two three four five"
    rows = [(5, None, 1), (3, "", 1), (9, " \n", 1), (7, text, 1), (7, text, 1), (None, text, 1), (2, "w " * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(2, 2), (3, 3), (5, 3), (7, 7), (7, 7), (9, 3)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [7]
    assert sorted(r["doc_id"] for r in one_of_each(df).collect()) == [2, 3, 7]
    empty = df.limit(0)
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_full_shards_lose_no_link(spark):
    """Texts that share one shard and nothing else: who is linked doesn't depend on how full the shard is."""
    rng = random.Random(13)
    wides = [[rng.getrandbits(64) - (1 << 63) for _ in range(S.BITS // 64)] for _ in range(60)]
    rows = [(i, w, [7] + [1000 * i + k for k in range(1, S.BANDS)]) for i, w in enumerate(wides)]
    rows += [(100 + i, [w[0] ^ 5, *w[1:]], [7] + [1000 * (100 + i) + k for k in range(1, S.BANDS)]) for i, w in enumerate(wides)]
    nodes = spark.createDataFrame(rows, "_fp long, _wide array<long>, _bands array<long>")
    for shard in (4, 4096):
        found = {tuple(sorted((r["a"], r["b"]))) for r in S.wide_links(nodes, shard=shard).collect()}
        assert found == {(i, 100 + i) for i in range(60)}
