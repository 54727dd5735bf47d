"""Harmonic packing of tokenized documents into sequences of one capacity.

A length l belongs to class k = floor(C / l), so C/(k+1) < l <= C/k: k items of class k fit into
one bin whatever their exact lengths are. Each worker numbers the items of its share of a class;
the shares' sizes give the first number of each, and number i of class k goes to bin i // k. No
worker needs to know what another has put where. Documents are cut first, into pieces of exactly C,
C/2, C/4, ... down to `least` tokens and one short rest, so that the bins of the large classes are
full to the last token and those of rests to at least k/(k+1), k > C / least.

Where the order of the documents counts, the shares are ranges of positions, so that a class fills its
bins in that order, and all bins are numbered by the first piece in them: the sequences before any one hold every
piece up to its first, and beyond that at most one open bin of each class.

The last bin of a class may lack items. Those items (less than k of each class, so at most about
C * ln C altogether whatever the input) are packed by first fit, longest first, in one small task.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import WordCache, map_batches, materialize, on_worker, texts

CAPACITY = 2048
END_ID = 1
#: Shorter pieces than this are only made as a document's last one.
LEAST = 64
#: Items that one worker numbers; the number of lanes follows the input.
LANE_ITEMS = 20_000


def cut(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths that add up to n: capacities, then halves of it for each binary digit, then the rest below `least`."""
    out, part = [capacity] * (n // capacity), capacity // 2
    n %= capacity
    while part >= least:
        if n >= part:
            out.append(part)
            n -= part
        part //= 2
    return [*out, n] if n else out


LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
#: A word of letters, perhaps with punctuation after it: the vocabulary's patterns always part them there.
WORD = re.compile(LETTERS)
ENDED = re.compile(b"(" + LETTERS + rb")([.,;:!?]+)")
#: Second bytes of the letters from U+00C0 to U+00DE, and those of the same letters in lower case.
LOWER = bytes(b + 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Encoder:
    """Token ids as little-endian unsigned 32-bit, by way of a bounded cache of words.

    The vocabulary drops white space before it looks for words, and none of its patterns spans
    white space, so a text's ids are those of its words one after the other. It lower-cases too, so
    A-Z go first; not so where that could make a special token or join a letter and a mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letter = byte_letters().__getitem__
        self.cache = WordCache(self.word)

    def word(self, word: bytes) -> bytes:
        if parts := ENDED.fullmatch(word):
            return self.cache[parts[1]] + self.cache[parts[2]]
        if WORD.fullmatch(word):  # one piece that normalization leaves as it is, but for the case
            ids = [token.id for token in self.merge("".join(map(self.letter, word.translate(LOWER))))]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        return b"".join(map(self.cache.__getitem__, raw.split()))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) for each piece of each document, and _pos where docs have it."""
    placed = "_pos" in docs.columns
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = on_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            rows: list[tuple] = []
            places = batch.column(2).to_pylist() if placed else [None] * batch.num_rows
            for doc_id, text, at in zip(batch.column(0).to_pylist(), texts(batch), places, strict=True):
                ids, start = encode(text) + end, 0
                view = memoryview(ids)
                for length in cut(len(ids) // 4, capacity, least):
                    part = view[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4) + ((at,) if placed else ()) + ((part.cast("I").tolist(),) if with_ids else ()))
                    start += length
                if len(rows) >= 20_000 or with_ids and rows:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    longs = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["_pos"] * placed
    names = longs + ["ids"] * with_ids
    kinds = [pa.int64()] * len(longs) + [pa.list_(pa.int64())] * with_ids

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(docs.select("doc_id", "text", *["_pos"] * placed), run, ", ".join(f"{n} long" for n in longs) + ", ids array<long>" * with_ids, keep=True)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length, which come longest first."""
    free: list[int] = []
    out = []
    for n in lengths:
        at = next((i for i, room in enumerate(free) if room >= n), len(free))
        if at == len(free):
            free.append(capacity)
        out.append((at, capacity - free[at]))
        free[at] -= n
    return out


def positioned(docs: DataFrame) -> DataFrame:
    """doc_id, text and _pos, which ascends in the order of the written rows: by file name, then by row in the file."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not a table in files
        return positioned(materialize(docs.select("doc_id", "text"), "packing-documents"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))  # one row for each file
    before = F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1))
    files = materialize(files.withColumn("_before", F.coalesce(before, F.lit(0))), "packing-files")
    return rows.join(F.broadcast(files), "_file").select("doc_id", "text", (F.col("_before") + F.col("_row")).alias("_pos"))


def harmonic_pack(items: DataFrame, keys: list[str], capacity: int = CAPACITY, position: str | None = None) -> DataFrame:
    """items (a written table) with sequence_id and offset; `length` is 1 to capacity, keys order equal classes.

    Sequence ids are dense from 0. An empty table gives an empty one. Rows that agree in all keys
    are packed once each. With `position`, the first of the keys, a long, sequences follow it: they ascend by the first item in them.
    """
    lanes = max(64, items.count() // LANE_ITEMS)
    clash = [c for c in items.columns if c in ("_k", "_lane", "_n", "_first", "_all", "_base", "_i", "_bin")]
    if clash:
        raise ValueError(f"columns with names that the packing uses: {clash}")
    lane = F.pmod(F.xxhash64(*keys, "length"), F.lit(lanes))
    if position:
        lanes_of = F.lit(lanes) / F.lit((items.agg(F.max(position)).first()[0] or 0) + 1)
        lane = F.floor(F.col(position) * lanes_of)
    items = items.withColumns({"_k": F.floor(F.lit(capacity) / F.col("length")), "_lane": lane})
    share = items.groupBy("_k", "_lane").agg(F.count("*").alias("_n"))
    share = share.withColumn("_first", F.sum("_n").over(W.partitionBy("_k").orderBy("_lane")) - F.col("_n"))
    whole = share.groupBy("_k").agg(F.sum("_n").alias("_all"))
    full = F.expr("_all div _k")
    # At most one row for each class, of which there are less than 2 * sqrt(capacity).
    whole = whole.withColumns({"_base": F.sum(full).over(W.orderBy("_k")) - full, "_bins": F.sum(full).over(W.partitionBy())})
    numbered = (
        items.withColumn("_i", F.row_number().over(W.partitionBy("_k", "_lane").orderBy(*keys)))
        .join(share.drop("_n"), ["_k", "_lane"])
        .withColumn("_i", F.col("_i") + F.col("_first") - 1)
        .join(F.broadcast(whole), "_k")
    )
    numbered = materialize(numbered.drop("_first", "_lane"), "packing-numbered")
    names = [c for c in items.columns if c not in ("_k", "_lane")]
    bin_ = F.expr("_i div _k")
    packed = numbered.filter(bin_ < full).withColumn("_bin", F.col("_base") + bin_)
    upto = W.partitionBy("_bin").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    packed = packed.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)))
    rest = numbered.filter(bin_ >= full).repartition(1).sortWithinPartitions(*([] if position else [F.desc("length")]), *keys)
    schema = T.StructType([*rest.schema, T.StructField("_bin", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if full := [b for b in batches if b.num_rows]:
            rows = pa.Table.from_batches(full)
            placed = first_fit(rows["length"].to_pylist(), capacity)
            base = rows["_bins"].to_pylist()
            rows = rows.append_column("_bin", pa.array([b + at for b, (at, _) in zip(base, placed, strict=True)], pa.int64()))
            yield from rows.append_column("offset", pa.array([o for _, o in placed], pa.int64())).to_batches()

    rest = map_batches(rest, run, schema, keep=True)
    made = packed.select(*names, "_bin", "offset").unionByName(rest.select(*names, "_bin", "offset"))
    if not position:
        return made.withColumn("sequence_id", F.col("_bin")).select(*names, "sequence_id", "offset")
    made = materialize(made, "packing-placed")
    bins = made.groupBy("_bin").agg(F.min(F.struct(*keys)).alias("_first"))
    bins = materialize(bins.withColumn("_lane", F.floor(F.col("_first")[position] * lanes_of)), "packing-bins")
    lower = bins.groupBy("_lane").agg(F.count("*").alias("_n"))
    lower = lower.withColumn("_base", F.sum("_n").over(W.orderBy("_lane")) - F.col("_n")).drop("_n")
    number = F.row_number().over(W.partitionBy("_lane").orderBy("_first")) - 1
    bins = bins.withColumn("_at", number).join(F.broadcast(lower), "_lane").select("_bin", (F.col("_base") + F.col("_at")).alias("sequence_id"))
    return made.join(bins, "_bin").select(*names, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST, end_id: int = END_ID, with_ids: bool = False, ordered: bool = False) -> DataFrame:
    """Packs all documents (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset.
    A null or empty text has the end id alone. A null doc_id stays null, repeated rows are packed as
    often as they occur, texts of any length are cut, and an empty table gives an empty result.
    If `ordered`, the sequences follow the order of the rows of docs.
    """
    pieces = materialize(token_pieces(positioned(docs) if ordered else docs.drop("_pos"), tokenizer, capacity, least, end_id, with_ids), "packing-pieces")
    if ordered:
        return harmonic_pack(pieces, ["_pos", "start"], capacity, "_pos").drop("_pos")
    return harmonic_pack(pieces, ["doc_id", "start", "ids_crc32"], capacity)
