"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

Payloads leave the table for tar shards in a shared folder; rows carry the SHA-256 digest,
the shard, and the offset and length of the stored bytes. Payloads whose hash stands once are written
by the task that reads them, without a shuffle; only possibly repeated ones (two-pass
Bloom filtering) shuffle, and each different one of them is stored once. Metadata columns are
filled by reading the first bytes of each payload from its shard, and further ranges
only where a header goes on.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, shared_path, written
from .exact import possibly_repeated

#: A task begins another shard once one has reached this size.
SHARD_BYTES = 1 << 30
#: Bytes of the first range read of a payload; later ones double.
HEADER_BYTES = 1024
_BLOCK = 512
PLACE = ["digest", "n_bytes", "codec", "shard", "offset", "length"]
META = ["media_type", "width", "height", "charset", "title"]
#: Signatures at a payload's start.
_MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"%PDF-", "application/pdf"),
    (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"), (b"ID3", "audio/mpeg"), (b"\x1aE\xdf\xa3", "video/webm"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"),
]
_CHARSET = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_TITLE = re.compile(rb"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
_HEAD_OVER = re.compile(rb"</head\s*>|<body[\s>]", re.I)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as both Spark and Arrow understand it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return re.sub(r"^file:/+", "file:///", uri)


class ShardWriter:
    """Tar shards of one task attempt; a repeated digest in one task is stored once."""

    def __init__(self, root: str, name: str, most: int = SHARD_BYTES):
        self.fs, self.dir = pafs.FileSystem.from_uri(root)
        self.root, self.name, self.most, self.number, self.out = root, name, most, 0, None

    def add(self, payload: bytes, digest: str) -> tuple[str, str, int, int]:
        """(codec, shard, offset, length) of the stored bytes: compressed where that is much shorter."""
        small = zstandard.ZstdCompressor(level=3).compress(payload)
        codec = "zstd" if len(small) < 0.9 * len(payload) else "raw"
        data = small if codec == "zstd" else payload
        if self.out is not None and self.at >= self.most:
            self.close()
        if self.out is None:
            self.shard = f"{self.root}/{self.name}-{self.number}.tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.dir}/{self.name}-{self.number}.tar"), 0
            self.number += 1
        info = tarfile.TarInfo(digest + (".zst" if codec == "zstd" else ""))
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.GNU_FORMAT))
        self.out.write(data)
        self.out.write(bytes(-len(data) % _BLOCK))
        place = (codec, self.shard, self.at + _BLOCK, len(data))
        self.at += _BLOCK + len(data) + -len(data) % _BLOCK
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * _BLOCK))
            self.out.close()
            self.out = None


def _stored(df: DataFrame, names: list[str], root: str, tag: str, shard_bytes: int) -> DataFrame:
    """``df`` (columns names and last the payload) with PLACE instead of the payload. To be written before it is read twice."""
    schema = T.StructType([*df.schema.fields[: len(names)], *(T.StructField(c, T.LongType() if c in ("n_bytes", "offset", "length") else T.StringType()) for c in PLACE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = TaskContext.get()
        w = ShardWriter(root, f"{tag}-{c.partitionId()}-{c.taskAttemptId()}", shard_bytes)
        for b in batches:
            rows = []
            for x in b.column(len(names)):
                v = x.as_py()
                if v is None:
                    rows.append((None,) * len(PLACE))
                    continue
                v = v.encode() if isinstance(v, str) else v
                digest = hashlib.sha256(v).hexdigest()
                rows.append((digest, len(v), *w.add(v, digest)))
            types = [pa.int64() if k in ("n_bytes", "offset", "length") else pa.string() for k in PLACE]
            cols = [pa.array(list(k), t) for k, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *cols], names=[*b.schema.names[: len(names)], *PLACE])
        w.close()

    return df.mapInArrow(run, schema)


def store(df: DataFrame, payload: str = "html", root: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``df`` with PLACE (digest, n_bytes, codec, shard, offset, length) in place of ``payload``.

    ``payload`` is a string (stored as UTF-8) or binary column. Equal payloads are stored once, with
    one place for all their rows; empty ones too, with length 0. Null payloads have null in
    all six. Other columns named like one of the six are replaced. Rows are as many as before,
    in any order. ``root`` is the shards' folder, by default a new one in the shared folder. What a
    lost task attempt has written is referred to by no row.
    """
    spark = df.sparkSession
    root = qualified(spark, root or shared_path(spark, "media"))
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    low = {payload.lower(), *PLACE}
    names = [c for c in df.columns if c.lower() not in low]
    h, flag, v, d = fresh(df, "h", "flag", "payload_of", "digest_of")
    src = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{payload}`").alias(v))
    src = possibly_repeated(src.withColumn(h, F.when(F.col(v).isNotNull(), F.xxhash64(v))), h, flag)
    keep = [F.col(f"`{c}`") for c in names]
    single = written(_stored(src.where(~F.col(flag)).select(*keep, v), names, root, "a", shard_bytes), "media-places")
    digest = F.sha2(F.col(v).cast("binary"), 256).alias(d)
    # equal payloads meet on the map side: each task sends one of them
    first = src.where(F.col(flag)).groupBy(digest).agg(F.first(v).alias(v))
    places = written(_stored(first, [d], root, "b", shard_bytes), "media-repeated")
    rows = src.where(F.col(flag)).select(*keep, digest)
    return single.unionByName(rows.join(places, d).select(*keep, *PLACE))


class Payload:
    """The raw bytes of one stored payload, read from the front by ranges."""

    def __init__(self, ranged: Callable[[int, int], bytes], length: int, codec: str, first: int = HEADER_BYTES):
        self.ranged, self.length, self.step, self.read, self.raw = ranged, length, first, 0, b""
        self.loose = zstandard.ZstdDecompressor().decompressobj() if codec == "zstd" else None

    def more(self) -> bool:
        """Reads another range; false at the end."""
        n = min(self.step, self.length - self.read)
        if n <= 0:
            return False
        got = self.ranged(self.read, n)
        self.read += n
        self.step *= 2
        self.raw += self.loose.decompress(got) if self.loose else got
        return True

    def head(self, n: int) -> bytes:
        while len(self.raw) < n and self.more():
            pass
        return self.raw[:n]

    def until(self, what: re.Pattern[bytes]) -> bytes:
        """From the start to a match's end, or everything."""
        while not (m := what.search(self.raw)):
            if not self.more():
                return self.raw
        return self.raw[: m.end()]


def describe(p: Payload) -> tuple[str, int | None, int | None, str | None, str | None]:
    """META of a payload from its header: type by signature, sizes of images, charset and title of HTML.

    Ranges are read as far as the header goes: for JPEG to the frame header, for HTML to the
    end of the head. A broken header leaves its values null.
    """
    b = p.head(32)
    kind = next((t for m, t in _MAGIC if b.startswith(m)), None)
    if b[:4] == b"RIFF" and b[8:12] in (b"WEBP", b"WAVE"):
        kind = "image/webp" if b[8:12] == b"WEBP" else "audio/wav"
    elif b[4:8] == b"ftyp":
        kind = "video/mp4"
    size: tuple[int | None, int | None] = (None, None)
    if kind == "image/png" and len(b) >= 24:
        size = struct.unpack(">II", b[16:24])
    elif kind == "image/gif" and len(b) >= 10:
        size = struct.unpack("<HH", b[6:10])
    elif kind == "image/bmp" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        size = (w, abs(h))
    elif kind == "image/webp" and len(b) >= 30:
        size = _webp(b)
    elif kind == "image/jpeg":
        size = _jpeg(p)
    if kind:
        return kind, *size, None, None
    if not b:
        return "application/x-empty", None, None, None, None
    text = p.head(512).lstrip(b"\xef\xbb\xbf \t\r\n\x0c").lower()
    if text.startswith((b"<!doctype html", b"<html", b"<head", b"<body")):
        head = p.until(_HEAD_OVER)
        c, t = _CHARSET.search(head), _TITLE.search(head)
        charset = c[1].decode("ascii").lower() if c else None
        try:
            title = t and re.sub(r"\s+", " ", t[1].decode(charset or "utf-8", "replace")).strip()
        except LookupError:
            title = re.sub(r"\s+", " ", t[1].decode("utf-8", "replace")).strip()
        return "text/html", None, None, charset, title or None
    try:
        # a character may be cut at the end of the range
        plain = b"\0" not in text and (p.raw[:512].decode("utf-8", "strict") is not None)
    except UnicodeDecodeError as e:
        plain = b"\0" not in text and e.start >= len(p.raw[:512]) - 3
    return ("text/plain" if plain else "application/octet-stream"), None, None, None, None


def _webp(b: bytes) -> tuple[int | None, int | None]:
    if b[12:16] == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if b[12:16] == b"VP8L":
        n = int.from_bytes(b[21:25], "little")
        return 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF)
    if b[12:16] == b"VP8 ":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None, None


def _jpeg(p: Payload) -> tuple[int | None, int | None]:
    at = 2
    while len(s := p.head(at + 9)[at:]) == 9 and s[0] == 0xFF:
        if s[1] == 0xFF:
            at += 1  # fill byte
        elif 0xC0 <= s[1] <= 0xCF and s[1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", s[5:9])
            return w, h
        elif s[1] in (0xD9, 0xDA):
            break
        else:
            at += 2 + int.from_bytes(s[2:4], "big")
    return None, None


def fill(df: DataFrame, first: int = HEADER_BYTES) -> DataFrame:
    """``df`` (of ``store``) with META (media_type, width, height, charset, title), by header-only range reads.

    Rows without a place have null in all five; columns of these names are replaced. Narrow: no shuffle.
    """
    names = [c for c in df.columns if c.lower() not in META]
    src = df.select([F.col(f"`{c}`") for c in names])
    schema = T.StructType([*src.schema.fields, *(T.StructField(c, T.IntegerType() if c in ("width", "height") else T.StringType()) for c in META)])
    place = [names.index(c) for c in ("shard", "offset", "length", "codec")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str | None, pa.NativeFile | None] = (None, None)
        for b in batches:
            rows = []
            for shard, offset, length, codec in zip(*(b.column(i).to_pylist() for i in place)):
                if shard is None:
                    rows.append((None,) * len(META))
                    continue
                if opened[0] != shard:
                    if opened[1] is not None:
                        opened[1].close()
                    fs, path = pafs.FileSystem.from_uri(shard)
                    opened = (shard, fs.open_input_file(path))
                f = opened[1]
                rows.append(describe(Payload(lambda at, n: f.read_at(n, offset + at), length, codec, first)))
            types = [pa.int32() if k in ("width", "height") else pa.string() for k in META]
            cols = [pa.array(list(k), t) for k, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *META])
        if opened[1] is not None:
            opened[1].close()

    return src.mapInArrow(run, schema)


def load(shard: str, offset: int, length: int, codec: str) -> bytes:
    """A payload by its place."""
    fs, path = pafs.FileSystem.from_uri(shard)
    with fs.open_input_file(path) as f:
        data = f.read_at(length, offset)
    return zstandard.ZstdDecompressor().decompress(data) if codec == "zstd" else data


def media_columns(df: DataFrame, payload: str = "html", root: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``store``, then ``fill``."""
    return fill(store(df, payload, root, shard_bytes))
