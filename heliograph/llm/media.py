"""Media columns with content-defined chunks.

A text's UTF-8 bytes, padded with spaces to a multiple of 192, become the samples of an 8-bit mono WAV file. The file is
cut where a rolling gear hash says so; a chunk store keeps each distinct chunk once; a medium is its ordered list of
chunk digests. Reading joins the lists with the store, puts the chunks together, checks the medium's digest and computes
features of the samples that were read. Equal media are read once.

A gear hash is ``h = (h << 1) + gear[byte]`` in 32 bits, hence depends on the last 32 bytes, and is computed for all
bytes at once by doubling. A cut lies where its top ``bits`` bits are zero, at least ``least`` and at most ``most`` bytes
after the last one.

Defined results: a null or empty text is one block of 192 spaces; a null doc_id is kept; repeated rows give repeated
results; an empty table gives no rows. A medium whose digest differs after reading raises an error.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, RATE, PAD = 192, 8000, b" "
#: Digests of chunks that a task has already sent; when full it is emptied, and a chunk may be sent again.
SENT_KEPT = 500_000


def gear_table(seed: bytes = b"gear") -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(seed + bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


GEAR = gear_table()


def cuts(data: bytes, least: int, most: int, bits: int) -> list[int]:
    """Ends of the chunks of ``data``."""
    h, step = GEAR[np.frombuffer(data, np.uint8)], 1
    while step < 32:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    ends, at, n = [], 0, len(data)
    for c in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least:
            at = c
            ends.append(at)
    while n - at > most:
        at += most
        ends.append(at)
    if n > at:
        ends.append(n)
    return ends


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data + PAD * (-len(data) % BLOCK or BLOCK * (not data))


def stored(payload: bytes) -> bytes:
    """The WAV file of a payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def features(payload: bytes) -> str:
    """Whole-number features of 8-bit samples: sum, sum of squares, extremes, crossings of the middle, and counts by level."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 5, minlength=8)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"sum={int(x.sum(dtype=np.int64))};squares={int(np.square(x, dtype=np.int64).sum())};min={x.min()};max={x.max()};crossings={crossings};levels={'-'.join(map(str, levels))}"


def manifest(df: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """doc_id, n_bytes, media_sha256, media_bytes and the ordered chunk digests of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, payload = payload_of(text)
                media, at, digests = stored(payload), 0, []
                for end in cuts(media, least, most, bits):
                    digests.append(hashlib.sha256(media[at:end]).digest())
                    at = end
                rows.append((doc_id, n, hashlib.sha256(media).hexdigest(), len(media), digests))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["doc_id", "n_bytes", "media_sha256", "media_bytes", "chunks"])

    return common.map_arrow(common.texts(df), run, "doc_id long, n_bytes long, media_sha256 string, media_bytes long, chunks array<binary>")


def chunks(df: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """digest and data (zstd) of the chunks of every row, each once per task at best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            digests, data = [], []
            for text in batch.column("text").to_pylist():
                media, at = stored(payload_of(text)[1]), 0
                for end in cuts(media, least, most, bits):
                    part = media[at:end]
                    at, digest = end, hashlib.sha256(part).digest()
                    if digest not in sent:
                        if len(sent) >= SENT_KEPT:
                            sent.clear()
                        sent.add(digest)
                        digests.append(digest)
                        data.append(pack(part))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])

    return common.map_arrow(common.texts(df).select("text"), run, "digest binary, data binary")


def read_back(media: DataFrame) -> DataFrame:
    """media_sha256, media_bytes, parts (array of place and data) -> what the samples say, after checking the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for key, parts in zip(batch.column("media_sha256").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                data = b"".join(unpack(p["data"]) for p in sorted(parts, key=lambda p: p["place"]))
                if hashlib.sha256(data).hexdigest() != key:
                    raise ValueError(f"medium {key} was not read back as stored")
                payload = samples(data)
                rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), features(payload)))
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return common.map_arrow(media, run, "key string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


def media_columns(df: DataFrame, least: int = 2048, most: int = 32768, bits: int = 13) -> DataFrame:
    """Store every row's medium in chunks and read it back: one row of digests, sizes and features per row.

    Only small rows (ids, digests) are shuffled by medium. Chunk data goes by digest once, and a second time only for
    media of more than one chunk.
    """
    listed = common.written(manifest(df, least, most, bits), "manifest")
    distinct = listed.groupBy("media_sha256").agg(F.first("chunks").alias("chunks"))
    pieces = distinct.select("media_sha256", F.size("chunks").alias("n"), F.posexplode("chunks").alias("place", "digest"))
    store = chunks(df, least, most, bits).groupBy("digest").agg(F.first("data").alias("data"))
    found = pieces.join(store, "digest").select("media_sha256", "n", F.struct("place", "data").alias("part"))
    whole = found.where("n = 1").select("media_sha256", F.array("part").alias("parts"))
    cut_up = found.where("n > 1").groupBy("media_sha256").agg(F.collect_list("part").alias("parts"))
    read = read_back(whole.unionByName(cut_up))
    docs = listed.select("doc_id", "n_bytes", "media_sha256")
    return docs.join(read, docs["media_sha256"] == read["key"]).drop("key")
