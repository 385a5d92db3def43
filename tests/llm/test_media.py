import hashlib
import os
import struct
import tarfile

import pytest

from siftwell.llm import media

SCHEMA = "page_id long, html string, Digest string, h int, payload_of int, width string"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + os.urandom(3000)


def jpeg(w, h):
    app = b"\xff\xe1" + struct.pack(">H", 40_002) + os.urandom(40_000)
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + os.urandom(3000)


def payload(b, codec="raw"):
    reads = []

    def ranged(at, n):
        reads.append(n)
        return b[at : at + n]

    return media.Payload(ranged, len(b), codec), reads


@pytest.mark.parametrize("b, want", [
    (png(640, 480), ("image/png", 640, 480, None, None)),
    (jpeg(300, 200), ("image/jpeg", 300, 200, None, None)),
    (b"\xff\xd8\xff", ("image/jpeg", None, None, None, None)),
    (b"GIF89a" + struct.pack("<HH", 7, 9), ("image/gif", 7, 9, None, None)),
    (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), ("image/webp", 100, 50, None, None)),
    (b"", ("application/x-empty", None, None, None, None)),
    (b"plain text " * 100, ("text/plain", None, None, None, None)),
    ("ü".encode() * 700, ("text/plain", None, None, None, None)),
    (bytes(range(256)), ("application/octet-stream", None, None, None, None)),
    (b"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><style>" + b"x" * 9000 + "</style><title>A \n ü</title></head><body>".encode() + b"y" * 90_000, ("text/html", None, None, "utf-8", "A ü")),
    (b"<html><head><meta charset='nonsense'><title>t</title><body>", ("text/html", None, None, "nonsense", "t")),
])
def test_headers(b, want):
    p, reads = payload(b)
    assert media.describe(p) == want
    assert sum(reads) <= len(b)


def test_only_headers_are_read():
    p, reads = payload(png(1, 2) + bytes(5_000_000))
    media.describe(p)
    assert sum(reads) == media.HEADER_BYTES


def test_store_and_fill(spark, tmp_path):
    page = "<html><head><title>T%d</title></head><body>" + "words and words " * 400
    texts = [page % (i % 7) for i in range(60)] + [page % i for i in range(100, 130)] + [None, "", "", None, "long " * 200_000]
    rows = [(i % 90, t, "x", 1, 2, "w") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    root = "file://" + str(tmp_path)
    got = media.media_columns(df, root=root, shard_bytes=3000).collect()
    assert len(got) == len(texts)
    assert set(got[0].asDict()) == {"page_id", "h", "payload_of", *media.PLACE, *media.META}
    assert sorted((r.page_id, r.digest or "") for r in got) == sorted((i % 90, hashlib.sha256(t.encode()).hexdigest() if t is not None else "") for i, t in enumerate(texts))
    places = {}
    for r in got:
        if r.digest is None:
            assert r.shard is r.offset is r.media_type is None
            continue
        b = media.load(r.shard, r.offset, r.length, r.codec)
        assert hashlib.sha256(b).hexdigest() == r.digest and len(b) == r.n_bytes
        assert places.setdefault(r.digest, (r.shard, r.offset)) == (r.shard, r.offset)
        if b.startswith(b"<html>"):
            assert r.media_type == "text/html" and f"<title>{r.title}</title>".encode() in b
    # the shards are tar files that hold each payload once, by its digest
    members = [m.name.removesuffix(".zst") for s in tmp_path.glob("*.tar") for m in tarfile.open(s).getmembers()]
    assert sorted(members) == sorted(places) and len({s for s, _ in places.values()}) > 1


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).collect() == []
