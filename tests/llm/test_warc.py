import base64
import gzip
import hashlib
import os
import random

import pytest

from tessera.llm import warc as W
from tessera.sources.store import shared_path

PAGES = "page_id long, url string, html string, payload_digest string"


def want(pages):
    best = {}
    for k, html in pages:
        best[html or ""] = max(best.get(html or "", -1), -1 if k is None else k)
    out = []
    for k, html in pages:
        body = (html or "").encode()
        top = best[html or ""]
        again = top != (-1 if k is None else k)
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


def sample():
    rng = random.Random(6)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(5000))
    pages = [(k, f"<html>{k} {noise[k * 7 :]}</html>") for k in range(40)] + [(50, "same"), (51, "same"), (7, "same"), (60, None), (61, ""), (62, ""), (None, "same"), (None, "only this"), (51, "same")]
    # Payloads that look like archives themselves.
    inner = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n").decode("latin-1")
    return pages + [(70, inner * 50), (71, "\x1f\x8b\x08" * 300), (72, "a\r\n\r\nWARC/1.1\r\n" * 20)]


@pytest.mark.parametrize("size", [997, 4096, W.RANGE])
def test_round_trip_in_ranges(spark, size):
    pages = sample()
    df = spark.createDataFrame([(k, f"http://x/{k} a", h, "z") for k, h in pages], PAGES)
    path = W.write(df, shared_path(spark, "warc"))
    got = W.read(spark, path, size)
    assert rows(got) == want(pages)
    kept = {(r["page_id"], bytes(r["payload"])) for r in got.where("record_type = 'response'").collect()}
    assert (70, dict(pages)[70].encode()) in kept and (60, b"") not in kept
    # The files are plain gzip to anyone else.
    local = path.removeprefix("file:")
    texts = [gzip.open(os.path.join(local, f)).read() for f in os.listdir(local) if f.endswith(".warc.gz") and os.path.getsize(os.path.join(local, f))]
    assert sum(t.count(b"WARC-Record-ID: ") for t in texts) == len(pages)


def test_stored_members_that_look_like_records(spark):
    """Uncompressed members: an inner archive stands byte for byte in the outer one."""
    rng = random.Random(8)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    inner = gzip.compress(W.record(5, "u", raw, W.digest32(raw), None, False), 0)
    path = shared_path(spark, "stored").removeprefix("file:")
    os.makedirs(path)
    outer = b""
    for k in range(20):
        body = inner * (k % 3)
        outer += W.member(W.record(k, "u", body, W.digest32(body), None, False), 0)
    with open(f"{path}/a.warc.gz", "wb") as f:
        f.write(outer)
    whole = [(at, head["warc-record-id"]) for at, head, _ in W.records(W._Ranged(open(f"{path}/a.warc.gz", "rb"), len(outer)), 0, len(outer))]
    assert [k for _, k in whole] == [f"<urn:page:{k}>" for k in range(20)]


def test_large_records_and_records_of_several_members(spark):
    big = "".join(random.Random(9).choices("abcdefgh é", k=9_000_000))
    df = spark.createDataFrame([(1, None, big, ""), (2, None, big, ""), (3, None, "x", "")], PAGES)
    path = W.write(df, shared_path(spark, "warc"), level=1)
    assert rows(W.read(spark, path, 1 << 20)) == want([(1, big), (2, big), (3, "x")])
    # Others cut a record into several members.
    cut = shared_path(spark, "cut").removeprefix("file:")
    os.makedirs(cut)
    with open(f"{cut}/a.warc.gz", "wb") as f:
        for k in range(3):
            data = W.record(k, "u", big[: 40_000 * k].encode(), W.digest32(big[: 40_000 * k].encode()), None, False)
            for at in range(0, len(data), 15_000):
                f.write(W.member(data[at : at + 15_000]))
    assert rows(W.read(spark, cut, 1 << 12)) == want([(k, big[: 40_000 * k]) for k in range(3)])


def test_only_archives_of_the_manifest_count(spark):
    df = spark.createDataFrame([(k, None, f"page {k}", "") for k in range(20)], PAGES).repartition(4)
    path = W.write(df, shared_path(spark, "warc"))
    local = path.removeprefix("file:")
    names = [f for f in os.listdir(local) if f.endswith(".warc.gz")]
    assert sorted(names) == sorted(n for n, _ in W._archives(spark, path)) and all(os.path.getsize(f"{local}/{n}") == size for n, size in W._archives(spark, path))
    with open(f"{local}/part-00000-left.warc.gz", "wb") as f:  # of a task that was lost
        f.write(W.member(W.record(99, "u", b"x", W.digest32(b"x"), None, False)))
    assert rows(W.read(spark, path)) == want([(k, f"page {k}") for k in range(20)])


def test_table_and_edges(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert rows(W.round_trip(pages)) == want([(r["page_id"], r["html"]) for r in pages.collect()])
    assert W.round_trip(pages.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", "")], PAGES)
    path = W.write(df, shared_path(spark, "warc"), smallest=3)
    assert {r["record_type"] for r in W.read(spark, path).collect()} == {"response"}
