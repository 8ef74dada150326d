import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import align
from tessera.llm.registry import op11_token_alignment, piece_path, tokenizer_path

DOCS = "doc_id long, text string, groups int, code int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def plain(texts):
    """The rows by byte sets, text by text; no unit, no array."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    signs = align.byte_of_sign()
    links, done = [], []
    for text in texts:
        rows = ([], [])
        if text:
            a = [(i, bytes(signs[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in two.encode(text):
                p = two.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                rows = (a, b)
        ends = []
        for side in rows:
            at, found = 0, []
            for _, x in side:
                at += len(x)
                found.append(at)
            ends.append(found)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(([x for x, _ in rows[0][i:p]], [x for x, _ in rows[1][j:q]]))
            i, j = p, q
        links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
        done.append((len(rows[0]), len(rows[1]), len(groups), ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)))
    held = Counter(p for x in links for p in x)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(n, best.get(a, 0))
    return [(d[0], d[1], d[2], sum(x.values()), sum(n for p, n in x.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in x.items()), d[3]) for d, x in zip(done, links, strict=True)]


def found(spark, rows, **bounds):
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], DOCS)
    return align.counted(align.align(docs, tokenizer_path(), piece_path()), piece_path(), groups=F.col("groups"), **bounds).select(*COLUMNS).collect()


TEXTS = [
    "Hello there, world's end. Hello", "a  b\tc\n\n d ", " lead", "né à Zürich “quoted” – 日本語 🙂", "x <|endoftext|> y <s> </s> <unk> z", "it's we'll 's", None, "", " ", "\x00\x01 \x1c y",
    "word " * 3000, "=" * 5000, "é ﬁ ｆ   ​ 　x", "▁ under ▁▁ line", "Hello there, world's end. Hello", "ÀÈ ɏɐ Ωμέγα", "1234567 8 9,10", "don't 'em ''s", "﻿bom x", "<0x41> <0x0A>",
]


@pytest.mark.parametrize("head", [align.HEAD, 7, 0])
def test_against_byte_sets(spark, head):
    got = {r["doc_id"]: tuple(r)[1:] for r in found(spark, enumerate(TEXTS), head=head)}
    want = plain(TEXTS)
    for i, row in enumerate(want):
        assert got[i] == row, (i, TEXTS[i])


def test_documents_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    for r, want in zip(rows, plain([r["text"] for r in rows]), strict=True):
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS[1:-1]) == want[:-1]
        assert got[r["doc_id"]]["groups_sha256"] == (hashlib.sha256(want[-1].encode()).hexdigest() if want[0] else "")


def test_units_are_whole_texts(spark):
    """Units aligned one by one are the text aligned as one."""
    import random

    tok = align.Tokenizers(tokenizer_path(), piece_path())
    assert tok.apart
    rng = random.Random(5)
    signs = "abcdefgé'.,!?#<>-_0159 \n\tΩ日 ﬁ" + " " * 12
    for _ in range(400):
        text = "".join(rng.choices(signs, k=rng.randrange(1, 60)))
        assert [i for u in tok.units(text) for i in tok.a(" " + u)] == tok.slow.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in tok.units(text) for i in tok.pieces.encode(u)] == tok.pieces.encode(text)


def test_groups_and_products():
    a, b = align.groups_of(np.array([2, 4, 7, 9]), np.array([1, 4, 9]))
    assert (a.tolist(), b.tolist()) == ([2, 4], [2, 3])
    x, y, g = align.expanded(a, b)
    assert list(zip(x.tolist(), y.tolist(), g.tolist(), strict=True)) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (2, 2, 1), (3, 2, 1)]


def test_a_small_memory_changes_nothing():
    tok = align.Tokenizers(tokenizer_path(), piece_path())
    small, large = align.Memory(tok, most=3), align.Memory(tok)
    for text in [t for t in TEXTS if t]:
        (r, _), (s, _) = small.rows([text]), large.rows([text])
        assert [small.groups[i] for i in r] == [large.groups[i] for i in s]
        assert small.pairs(r)[0].tolist() == large.pairs(s)[0].tolist()


def test_null_ids_repeats_and_empty_table(spark):
    rows = found(spark, [(None, "same text"), (1, "same text"), (1, "same text")])
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0]["count_sum"] == 3 * rows[0]["n_links"]
    assert found(spark, []) == []
