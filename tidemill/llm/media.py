"""Media columns: content-defined chunks, deduplicated by their digests, and media put together from them.

A payload is stored as 8-bit PCM samples in a WAV container. A gear hash rolls over the container's
bytes and cuts where its upper bits vanish, so equal passages give equal chunks wherever they stand. A
first pass lists each medium's chunk digests. Joins on the digests tell the chunks that
several media share. A second pass stores the bytes: a medium with no shared chunk as one
row with its own chunks, each once; of all others, each chunk once for all media that have it.
What is shared is made known to the tasks as a bit set of fixed size: a chunk that it holds by chance
only goes the way of the shared ones, and when it is full, all do, with the same result.

Reading back joins the ordered digest lists with the stored chunks, puts the media together, and verifies
their SHA-256 before anything is computed from them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches, materialize, release, texts

UNIT = 576
PAD = 255
RATE = 8000
LEAST, MOST, BITS = 512, 16384, 11
#: Bits of the set of shared digests (8 MB).
SHARED_BITS = 1 << 26
#: A number for each byte value, by rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)


def payload(text: str) -> tuple[int, bytes]:
    """Bytes without padding, and the padded payload."""
    raw = text.encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw.ljust(size, bytes([PAD]))


def wav(samples: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples(media: bytes) -> bytes:
    """The samples of a WAV container: its data chunk, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks. The hash of the last 32 bytes, sum of GEAR[byte] << age, is built by doubling spans."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint32(span)
        h = h + older
    ends = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    out, start, n = [], 0, len(data)
    while n - start > least:
        i = bisect_left(ends, start + least)
        end = min(n, start + most, ends[i] if i < len(ends) else n)
        out.append(end)
        start = end
    return [*out, n] if start < n else out


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    ends = cuts(data)
    return [(hashlib.blake2b(part, digest_size=16).digest(), part) for a, b in zip([0, *ends[:-1]], ends, strict=True) if (part := data[a:b])]


def squeeze(part: bytes) -> bytes:
    """A chunk as it travels to the media that share it."""
    return zstandard.ZstdCompressor(level=9).compress(part)


def bit_of(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "little") % SHARED_BITS


def describe(media_sha256: str, media: bytes) -> tuple:
    """What is computed from stored media; fails if the bytes are not those that were stored."""
    if hashlib.sha256(media).hexdigest() != media_sha256:
        raise ValueError(f"media {media_sha256} were read back with other bytes")
    data = samples(media)
    x = np.frombuffer(data, np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    energy = int(np.square(x.astype(np.int32) - 128).mean())
    feature = f"frames={len(x) // UNIT};energy={energy};crossings={crossings};levels=" + ",".join(map(str, levels))
    return media_sha256, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), feature


FEATURES = pa.schema([("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def listing(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_sha256 and the digests of the medium of each document, in order."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("digests", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                n, data = payload(text)
                media = wav(data)
                rows.append((doc_id, n, hashlib.sha256(media).hexdigest(), [d for d, _ in chunks(media)]))
            yield as_batch(rows, schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media_sha256 string, digests array<binary>")


def shared_set(listed: DataFrame) -> bytes:
    """The bit set of the digests that more than one document has, by way of its words that are not zero."""
    media = listed.groupBy("media_sha256").agg(F.count("*").alias("n"), F.first("digests").alias("digests"))
    each = media.select("n", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = each.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    # The first four bytes as a little-endian number, of which SHARED_BITS takes the lower bits.
    byte = lambda i: F.conv(F.hex(F.substring("digest", i + 1, 1)), 16, 10).cast("long")
    bit = (byte(0) + byte(1) * (1 << 8) + byte(2) * (1 << 16) + byte(3) * (1 << 24)) % SHARED_BITS
    words = shared.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    found = words.toPandas()  # at most SHARED_BITS / 64 rows
    out = np.zeros(SHARED_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8).tobytes()


STORE = pa.schema([("digest", pa.binary()), ("media_sha256", pa.string()), ("digests", pa.list_(pa.binary())), ("place", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("bytes", pa.binary())])


def store(docs: DataFrame, shared: bytes) -> DataFrame:
    """The chunk bytes. Rows with media_sha256 and bytes: a medium of its own chunks (each once, in `place` order);
    with media_sha256 and digests: the list of another medium; with digest: one of its chunks, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            rows: list[tuple] = []
            for text in texts(batch):
                media = wav(payload(text)[1])
                name, parts = hashlib.sha256(media).hexdigest(), chunks(media)
                if any(shared[(bit := bit_of(d)) >> 3] >> (bit & 7) & 1 for d, _ in parts):
                    if (key := name.encode()) not in done:
                        rows.append((None, name, [d for d, _ in parts], None, None, None))
                        done.add(key)
                    for d, part in parts:
                        if d not in done:
                            rows.append((d, None, None, None, None, squeeze(part)))
                            done.add(d)
                    if len(done) > 1_000_000:
                        done.clear()
                else:
                    own = dict(parts)
                    place = {d: i for i, d in enumerate(own)}
                    rows.append((None, name, None, [place[d] for d, _ in parts], [len(x) for x in own.values()], b"".join(own.values())))
            yield as_batch(rows, STORE)

    return map_batches(docs.select("text"), run, "digest binary, media_sha256 string, digests array<binary>, place array<int>, sizes array<int>, bytes binary")


def read_back(stored: DataFrame) -> DataFrame:
    """FEATURES of each medium of the store, once."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                name, place, sizes, data = (batch.column(j)[i].as_py() for j in range(4))
                ends = np.cumsum(sizes).tolist()
                parts = [data[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                rows.append(describe(name, b"".join(parts[p] for p in place)))
            yield as_batch(rows, FEATURES)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = (b"".join(map(zstandard.decompress, batch.column(1)[i].as_py())) for i in range(batch.num_rows))
            yield as_batch([describe(batch.column(0)[i].as_py(), media) for i, media in enumerate(whole)], FEATURES)

    schema = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
    alone = map_batches(stored.filter("place IS NOT NULL").select("media_sha256", "place", "sizes", "bytes"), own, schema)
    bytes_of = stored.filter("digest IS NOT NULL").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    lists = stored.filter("digests IS NOT NULL").groupBy("media_sha256").agg(F.first("digests").alias("digests"))
    each = lists.select("media_sha256", F.posexplode("digests").alias("at", "digest")).join(bytes_of, "digest")
    whole = each.groupBy("media_sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bytes"))), lambda x: x["bytes"]).alias("parts"))
    return alone.unionByName(map_batches(whole, joined, schema))


def media_features(docs: DataFrame) -> DataFrame:
    """Stores the text of each row of docs (doc_id, text; others are ignored) as media, reads them back, and returns
    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature.

    A null text is empty: one unit of padding. Equal texts share all chunks and have equal
    values; repeated rows and null ids stay; texts are stored whole; an empty table gives an
    empty result. A medium that does not come back as it was stored fails the job.
    """
    listed = materialize(listing(docs), "media-listing")
    shared = shared_set(listed.select("media_sha256", "digests"))
    stored = materialize(store(docs, shared), "media-store", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"})
    release(docs.sparkSession)
    return listed.select("doc_id", "n_bytes", "media_sha256").join(read_back(stored), "media_sha256").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
