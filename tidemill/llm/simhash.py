"""SimHash near-duplicates by a Gray-order hierarchical index of the fingerprints.

Distribution: with d differing bits allowed and the 64 bits cut into d + 4 blocks, two linked
fingerprints agree in at least four whole blocks. Every choice of four blocks makes a key, and
fingerprints of one key meet in one group. At most 2^(64 - four blocks) distinct fingerprints, a
constant, share a key, whatever the documents are; copies were merged before. (For wide searches
the number of equal blocks can be less: fewer keys, larger groups.)

Search in a group: the fingerprints sorted by Gray rank form the leaves of a tree. Neighbours in
Gray order differ in few bits, so a node can hold the bits (mask and value) that all leaves below
it share, and its children hold only what they share beyond that. A query walks down from
the top, adds up the differing bits of the patterns it passes, and drops a whole subtree
as soon as the sum exceeds d.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import discard, map_batches, materialize, placed, texts
from tidemill.llm.graph import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
FAN = 16
#: Whole blocks that linked fingerprints share, and by which they meet.
EQUAL_BLOCKS = 4
#: Pairs of a query and a node that are held at a time.
FRONTIER = 1 << 20


def shingle_hashes(found: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of n words, repeats included; of all words if there are fewer."""
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(x), SEED) for x in zip(*(found[i:] for i in range(n)))), np.uint64, len(found) - n + 1)  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """Each bit that more than half of the hashes have; blocks bound the memory."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z change, only ASCII space cuts


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(words(text), shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle_words) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The tree over distinct fingerprints (unsigned 64-bit)."""

    def __init__(self, values: np.ndarray, fan: int = FAN):
        self.fan = fan
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.leaves = values[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        value, mask = self.leaves, np.full(len(values), full)
        #: From the leaves up: what a node shares beyond its parent, as (value, mask).
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.arange(0, len(value), fan)
            first = np.repeat(value[starts], np.diff(np.append(starts, len(value))))
            shared = np.bitwise_and.reduceat(mask & ~(value ^ first), starts) if len(value) > 1 else mask
            if len(value) == 1:
                self.levels.append((value, mask))
                break
            above = np.repeat(shared, np.diff(np.append(starts, len(value))))
            self.levels.append((value, mask & ~above))
            value, mask = value[starts] & shared, shared

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j (places in Gray order) of leaves that differ in at most `most` bits, in blocks."""
        n, top = len(self.leaves), len(self.levels) - 1
        step = max(1, FRONTIER // 4)
        todo = [(top, np.arange(a, min(n, a + step)), np.zeros(min(n, a + step) - a, np.int64), np.zeros(min(n, a + step) - a, np.uint8)) for a in range(0, n, step)]
        while todo:
            level, query, node, sofar = todo.pop()
            value, mask = self.levels[level]
            sofar = sofar + np.bitwise_count((self.leaves[query] ^ value[node]) & mask[node])
            last = (node + 1) * self.fan**level - 1
            keep = (sofar <= most) & (last > query)
            query, node, sofar = query[keep], node[keep], sofar[keep]
            if level == 0:
                if len(query):
                    yield query, node
                continue
            below = len(self.levels[level - 1][0])
            for a in range(0, len(query), max(1, FRONTIER // self.fan)):
                part = slice(a, a + max(1, FRONTIER // self.fan))
                child = (node[part, None] * self.fan + np.arange(self.fan)).ravel()
                real = child < below
                todo.append((level - 1, np.repeat(query[part], self.fan)[real], child[real], np.repeat(sofar[part], self.fan)[real]))

    def roots(self, most: int) -> np.ndarray:
        """For each of the values, the place (among the values) of its group's representative."""
        label = np.arange(len(self.leaves))
        for a, b in self.links(most):
            while True:
                x, y = label[a], label[b]
                if (x == y).all():
                    break
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != label[label]).any():
                    label = label[label]
        out = np.empty(len(label), np.int64)
        out[self.order] = self.order[label]
        return out


def block_masks(most: int, equal: int = EQUAL_BLOCKS) -> list[int]:
    """Masks of every choice of `equal` of most + equal blocks, as signed longs."""
    n = most + equal
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    masks = [sum(c) for c in combinations(blocks, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def group_links(distinct: DataFrame, most: int = MAX_DISTANCE, equal: int = EQUAL_BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join what lies within `most` bits, one star for each group."""
    masks = block_masks(most, equal)
    mask = np.array(masks, np.int64).view(np.uint64)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("c", "m")).select("c", (F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp")

    def of(c: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.append(starts, len(fp)))
        two = starts[sizes == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]) & ~mask[c[two]]) <= most
        yield fp[two[near]], fp[two[near] + 1]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            group = fp[at : at + n]
            root = group[GrayIndex(group).roots(most)]
            yield group[root != group], root[root != group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            c, key, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            found = list(of(c, key, fp))
            pair = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(pair, ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            # The last group of a batch may go on in the next one.
            cut = int(np.flatnonzero((c != c[-1]) | (key != key[-1]))[-1]) + 1 if ((c != c[-1]) | (key != key[-1])).any() else 0
            if held and (cut or held[0][0][0] != c[0] or held[0][1][0] != key[0]):
                same = int(np.argmax((c != held[0][0][0]) | (key != held[0][1][0]))) if ((c != held[0][0][0]) | (key != held[0][1][0])).any() else len(c)
                if same < len(c):
                    yield from out([*held, [c[:same], key[:same], fp[:same]]])
                    held = []
                    if cut > same:
                        yield from out([[c[same:cut], key[same:cut], fp[same:cut]]])
                    held = [[c[cut:], key[cut:], fp[cut:]]]
                    continue
            elif cut:
                yield from out([[c[:cut], key[:cut], fp[:cut]]])
            held.append([c[cut:], key[cut:], fp[cut:]])
        if held:
            yield from out(held)

    dealt = keyed.repartition(F.col("c"), F.col("key")).sortWithinPartitions("c", "key", "fp")
    return map_batches(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs (doc_id, text; others are ignored).

    component_id is the smallest doc_id that links of at most max_distance bits reach. Texts without
    words, empty or null, have fingerprint zero and are linked by it like others. A null
    doc_id is never a component_id unless a component has no other; repeated rows stay.
    """
    made = materialize(fingerprints(docs, shingle_words), "simhash")
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(group_links(distinct.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    member = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(least, "root").select("fp", "component_id")
    return made.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Settings of distinct_documents beside those of the fingerprints: shingles and similarity of what counts as near.
NEAR_WORDS, SIMILARITY = 5, 0.8
#: Candidates share one of BANDS keys of BAND_ROWS least hashes: at similarity 0.8 all but (1 - 0.8^5)^25 = 5e-5 of the pairs do, above it fewer are missed.
BANDS, BAND_ROWS = 25, 5
#: Bands by which most copies are linked before the others are looked at.
FIRST_BANDS = 3
#: About as many members of a key as a task has on each side of its comparisons.
KEY_BLOCK = 4096
#: Places of texts are broadcast up to this number, beyond which they are joined by a shuffle.
MOST_WANTED = 200_000
SHINGLE_BLOCK = 4096
_MADE = np.random.default_rng(SEED)
FACTORS = _MADE.integers(0, 1 << 31, BANDS * BAND_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _MADE.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of NEAR_WORDS words in order, as signed longs."""
    return np.unique(shingle_hashes(words(text), NEAR_WORDS) >> np.uint64(1)).astype(np.int64)


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * BAND_ROWS hash functions over a set of hashes."""
    out = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    mixed = (found >> 31).astype(np.uint32)
    for at in range(0, len(mixed), SHINGLE_BLOCK):
        np.minimum(out, (mixed[None, at : at + SHINGLE_BLOCK] * FACTORS[:, None] + TERMS[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """_file, _at, doc_id, set (hash of the set of shingles), fp (fingerprint) and keys (one for each band) for each row of docs (_file, _at, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps, keys = [], [], []
            for text in texts(batch):
                found = shingle_set(text)
                fps.append(fingerprint(text))
                least = least_hashes(found)
                sets.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                keys.append(np.array([xxhash.xxh64_intdigest(band.tobytes(), c) for c, band in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64))
            made = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, fps)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["_file", "_at", "doc_id", "set", "fp", "keys"])

    return map_batches(docs, run, "_file string, _at long, doc_id long, set long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """set and shingles for each row of docs (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t) for t in texts(batch)], pa.list_(pa.int64()))], ["set", "shingles"])

    return map_batches(docs.select("set", "text"), run, "set long, shingles array<long>")


def shingles_of(wanted: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The shingles of the wanted sets (set), from the texts of docs (_file, _at, text)."""
    wanted = materialize(wanted.distinct().join(sets.select("set", "rep._file", "rep._at"), "set"), "near-wanted")
    few = wanted.count() <= MOST_WANTED  # then texts need not travel
    found = docs.join(F.broadcast(wanted) if few else wanted.hint("merge"), ["_file", "_at"]).select("set", "text")
    return materialize(shingle_sets(found), "near-shingles")


def similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is SIMILARITY or more, by all shingles."""
    pairs = materialize(pairs, "near-pairs")
    found = shingles_of(pairs.select(F.explode(F.array("a", "b")).alias("set")), docs, sets)
    both = pairs.join(found.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(found.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    linked = materialize(both.filter(F.col("common") / (F.size("x") + F.size("y") - F.col("common")) >= SIMILARITY).select("a", "b"), "near-links")
    discard(found)
    discard(pairs)
    return linked


def rooted(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with root, the least set that links reach."""
    return sets.join(components(links).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def indexed(sets: DataFrame) -> DataFrame:
    """sets with a first key more, in place of fp: the least fingerprint that links of the Gray index reach from its own."""
    found = components(group_links(sets.select("fp").distinct())).withColumnRenamed("node", "fp")
    key = F.concat(F.array(F.coalesce("root", "fp")), "keys").alias("keys")
    return sets.join(found, "fp", "left").select("set", "rep", key)


def first_pairs(sets: DataFrame) -> DataFrame:
    """Each set with the least set of its key, by fingerprints and in the first bands."""
    members = sets.select("set", F.explode(F.slice("keys", 1, 1 + FIRST_BANDS)).alias("key"))
    lead = members.groupBy("key").agg(F.min("set").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return members.join(lead, "key").filter("set <> b").select(F.col("set").alias("a"), "b").distinct()


def compared(sets: np.ndarray, root: np.ndarray, shingles: pa.ListArray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between members (places) on the left and on the right that connect different roots, one for each two roots; all shingles are counted."""
    starts, ids = shingles.offsets.to_numpy()[:-1], np.unique(shingles.flatten().to_numpy(), return_inverse=True)[1]
    starts = starts - starts[0]
    sizes = shingles.value_lengths().to_numpy()
    root, mark = root.copy(), np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int32)
    for i in left:
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(np.append(mark[ids], 0), starts) if len(ids) else np.zeros(len(sizes), np.int64)
        mark[own] = 0
        near = right[(common >= SIMILARITY * (sizes[i] + sizes - common))[right] & (root[right] != root[i])]
        for j in near:
            if root[j] != root[i]:
                yield int(sets[i]), int(sets[j])
                root[root == root[j]] = root[i]


def missing_links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of sets (set, keys, rep, root) that share a key, have different roots and are similar, enough of them to connect all that are.

    In each key all sets but those of the most frequent root are compared with all of other roots. Both kinds are dealt
    to blocks that meet in pairs, so that a task has two blocks, however many sets share a key.
    """
    members = sets.select("set", "root", F.explode("keys").alias("key"))
    groups = members.groupBy("key", "root").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("size"), F.count("*").alias("roots")).filter("roots > 1")
    few, many = F.ceil((F.col("size") - F.col("top.size")) / KEY_BLOCK), F.ceil(F.col("top.size") / KEY_BLOCK)
    members = materialize(members.join(mixed.select("key", F.col("top.root").alias("top"), few.alias("few"), many.alias("many")), "key"), "near-mixed")
    found = shingles_of(members.select("set"), docs, sets)
    # Who is not of the top root meets its own kind (x <= y) and the top root's blocks (y: -1 - block).
    meet = """if(root = top, transform(sequence(0L, few - 1), i -> struct(i AS x, -1 - own AS y)),
      concat(transform(sequence(0L, few - 1), i -> struct(least(own, i) AS x, greatest(own, i) AS y)), transform(sequence(0L, many - 1), j -> struct(own AS x, -1 - j AS y))))"""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("set"), F.when(F.col("root") == F.col("top"), F.col("many")).otherwise(F.col("few"))))
    dealt = dealt.select("key", F.explode(F.expr(meet)).alias("at"), (F.col("root") == F.col("top")).alias("is_top"), "own", "set", "root").join(found, "set")
    dealt = dealt.select("key", "at.x", "at.y", "is_top", "own", "set", "root", "shingles").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            is_top, own, every = rows["is_top"].to_numpy(), rows["own"].to_numpy(), np.arange(rows.num_rows)
            left, right = (every[~is_top], every[is_top]) if at[2] < 0 else (every[own == at[1]], every[own == at[2]])
            links = list(compared(rows["set"].to_numpy(), rows["root"].to_numpy(), rows["shingles"].combine_chunks(), left, right))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                here = tuple(int(k[a]) for k in keys)
                if held and at != here:
                    yield out()
                    held = []
                at = here
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    linked = materialize(map_batches(dealt, run, "a long, b long").distinct(), "near-links")
    discard(found)
    discard(members)
    return linked


def near_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node and root: the least of the sets that links of similarity SIMILARITY or more reach, for every linked set of sets (set, rep, keys).

    Sets are compared in full with the least one of their key by fingerprints and in the first bands, which links most of a large
    group; then with all sets that share any key and are not linked to them by then.
    """
    links = similar(first_pairs(sets), docs, sets)
    return components(links.union(missing_links(materialize(rooted(sets, links), "near-roots"), docs)))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, any others) without near copies: of each group one stays, with all its columns as they were.

    Two documents are near if the sets of their five-word shingles have a Jaccard similarity of SIMILARITY or
    more, which is decided by all shingles of their whole texts. Who is compared comes from the Gray index of the fingerprints, as
    in near_duplicates, and, for pairs that are farther apart there, from bands of least hashes. Groups are what such links connect, of any size and number,
    and the smallest doc_id stays, of equal ids the first row. Documents with equal sets are merged first, so
    repeated rows, equal texts and texts without words (null ones too) are copies of each other. Null ids come last in
    a group. An empty table stays empty. Columns may have any names.
    """
    rows = placed(docs)
    plain = rows.select("_file", "_at", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").alias("text"))
    made = materialize(signatures(plain), "near-signatures")
    rep = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_file", "_at")
    plain_sets = materialize(made.groupBy("set").agg(F.min(rep).alias("rep"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "near-sets")
    discard(made)
    sets = materialize(indexed(plain_sets), "near-indexed")
    discard(plain_sets)
    linked = near_links(plain.select("_file", "_at", "text"), sets).withColumnRenamed("node", "set")
    kept = sets.join(linked, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("rep").alias("rep")).select("rep._file", "rep._at")
    return rows.join(kept, ["_file", "_at"], "left_semi").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
