"""Katz backoff: a bigram model with Good-Turing discounts, trained on and evaluated over a whole corpus.

P(w | h) = d(r) r / (c(h) + 1) where the pair was seen r > 0 times in training, else a(h) P(w), where
P(w) = d1(c) c / (N + 1) for a known word and what is left of one for the event "unknown word". Counts up
to K are discounted by Good-Turing. The one more count in the denominators leaves every history
something for unseen successors, and the backoff weight a(h) = (1 - sum of the seen P(w | h)) / (1 - sum of
P(w) of the same words) makes each history's distribution sum to one exactly.

Words are known by their 64-bit XXH64. The model is three tables, written in the shared folder: unigrams (token, c),
pairs (a word with its histories and their counts) and histories (history, c, weight).

Documents form blocks, which are written as streams of word numbers. A block deals its distinct pairs,
counted already, to buckets by word, and gets back how often each was seen and how often each word; so a frequent pair
is one entry a block. Of the FREQUENT most frequent words, those of more than 1/4096 of all tokens, or of more than a bucket's tokens, are
dealt by word and history, over all buckets.
Histories' sums are one aggregation over the pairs. Each token is then evaluated recursively, in its block:
a seen pair by its count, any other by the backoff weight of its history and its word. Weights of the FREQUENT most
frequent histories are known to all tasks, the others are asked for by join.

A block sends a bucket one row, and never more rows than it has words and pairs, so rows grow with the corpus however many blocks
and buckets there are.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fold, map_batches, materialize, release, ship, texts, trim

K = 5
#: Tokens in a block of documents, and about as many as a bucket gets.
BLOCK_TOKENS = 2_000_000
BUCKET_TOKENS = 1_500_000
LEAST_BUCKETS = 128
#: An odd number by which the pairs of words that are split go round the buckets.
STRIDE = 0x9E3779B1
#: At most so many of the most frequent words are known to all tasks.
FREQUENT = 1 << 16
#: Histories in one row of the table of pairs.
ROW_PAIRS = 1 << 16
END = xxhash.xxh64_intdigest(b"\x00end")
START = xxhash.xxh64_intdigest(b"\x00start")
END_LONG, START_LONG = np.array([END, START], np.uint64).view(np.int64).tolist()


def small(x: np.ndarray) -> np.ndarray:
    """The same numbers (0 or more) in the shortest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte of each number, compressed."""
    parts = [(x.dtype.str, x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) for x in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(kind))
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list of each stretch of values that begins at a start."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


def discounts(seen: dict[int, int], k: int = K) -> np.ndarray:
    """d(0..k) from how many items were counted 1, 2, ... k + 1 times; d(0) is unused."""
    n = [0.0, *(float(seen.get(r, 0)) for r in range(1, k + 2))]
    d = np.ones(k + 1)
    if not n[1]:
        return d
    absolute = n[1] / (n[1] + 2 * max(n[2], 1.0))  # below one, so that what was seen keeps something
    tail = (k + 1) * n[k + 1] / n[1]
    for r in range(1, k + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        d[r] = turing if 0 < turing <= 1 else (r - absolute) / r
    return d


class Numbers(dict):
    """word -> its number in a block, and the hashes in the order of the numbers."""

    def __init__(self):
        super().__init__()
        self.hashes = [END, START]

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return out


def blocks(docs: DataFrame, train: Column) -> DataFrame:
    """block, words, stream: the documents of docs in blocks.

    words: the sorted hashes of a block's words (and of the two ends), as steps, and the training count of each.
    stream: the words' places in that list, text by text, the texts' numbers of words, whether each is a
    training text, the ids and whether there is one, and the places of END and START.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        numbers, rows, ids, flags, held = Numbers(), [], [], [], 0

        def out() -> pa.RecordBatch:
            hashes = np.array(numbers.hashes, np.uint64)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sizes, known = np.array([len(r) for r in rows], np.int64), np.array(flags, bool)
            stream = place[np.concatenate(rows)]
            count = np.bincount(stream[np.repeat(known, sizes)], minlength=len(order))
            count[place[0]] += known.sum()
            has_id = np.array([x is not None for x in ids], bool)
            words = packed(steps(hashes[order]), small(count))
            blob = packed(small(stream), small(sizes), known, np.array([x or 0 for x in ids], np.int64), has_id, place[:2], np.array([len(order)]))
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + made], pa.int64()), pa.array([words], pa.binary()), pa.array([blob], pa.binary())], ["block", "words", "stream"])

        for batch in batches:
            for doc_id, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
                found = text.encode().lower().split()
                rows.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id)
                flags.append(flag)
                held += len(found) + 1
                if held >= BLOCK_TOKENS:
                    yield out()
                    numbers, rows, ids, flags, held, made = Numbers(), [], [], [], 0, made + 1
                    trim()
        if ids:
            yield out()
        numbers.clear()
        trim()

    return map_batches(docs.select(F.col("doc_id").cast("long"), train.alias("train"), "text"), run, "block long, words binary, stream binary")


def token_counts(made: DataFrame) -> DataFrame:
    """token (XXH64 as a signed long) and c, its count in the training documents, ends of text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                hashes, count = unpacked(blob.as_py())
                seen = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(hashes)[seen].view(np.int64)), pa.array(count[seen], pa.int64())], ["token", "c"])

    return map_batches(made.select("words"), run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the leading bits, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Stream:
    """The tokens of a block with their histories, as places in the block's list of words."""

    def __init__(self, blob: bytes):
        stream, sizes, self.train, self.ids, self.has_id, ends, n = unpacked(blob)
        self.n_words, (end, self.start) = int(n[0]), ends.tolist()
        self.sizes = sizes.astype(np.int64) + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        self.word = np.full(int(self.sizes.sum()), end, np.int64)
        inside = np.ones(len(self.word), bool)
        inside[self.first + self.sizes - 1] = False
        self.word[inside] = stream
        history = np.empty_like(self.word)
        history[1:] = self.word[:-1]
        history[self.first] = self.start
        self.key = self.word * self.n_words + history


def deal(made: DataFrame, frequent: np.ndarray, split: np.ndarray, buckets: int) -> DataFrame:
    """bucket, block, blob: what a block has for a bucket, its words there and its distinct pairs.

    A blob has the words' hashes and training counts; how many pairs each begins; the pairs' histories (places in `frequent`,
    sorted hashes, or beyond these in a list of the blob's own) and training counts; that list; and the pairs of words in `split`
    that go there: places of the word in `split`, the history and the count as before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                hashes, total = unpacked(words.as_py())
                hashes, s = np.cumsum(hashes), Stream(blob.as_py())
                key = s.key
                key <<= 1
                key |= np.repeat(s.train, s.sizes)
                key.sort()
                train, key = key & 1, key >> 1
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                count, key = np.add.reduceat(train, new), key[new]
                del train, new
                w, h = key // len(hashes), key % len(hashes)
                del key
                to = bucket_of(hashes, buckets)
                in_split = np.searchsorted(split, hashes)
                is_split = split[np.minimum(in_split, max(0, len(split) - 1))] == hashes if len(split) else np.zeros(len(hashes), bool)
                at = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
                is_frequent = frequent[at] == hashes if len(frequent) else np.zeros(len(hashes), bool)
                alone, apart = np.flatnonzero(~is_split[w]), np.flatnonzero(is_split[w])
                far_to = (to[h[apart]] + at[w[apart]] * STRIDE) % buckets
                order = np.argsort(far_to, kind="stable")
                apart, far_to = apart[order], far_to[order]
                there = np.union1d(to, far_to)
                edges = [np.stack([np.searchsorted(x, there), np.searchsorted(x, there, "right")], axis=1) for x in (to, to[w[alone]], far_to)]
                rows = []
                for bucket, (a, b), (c, d), (e, f) in zip(there.tolist(), *(x.tolist() for x in edges), strict=True):
                    own, far = alone[c:d], apart[e:f]
                    history = h[np.concatenate([own, far])]
                    rare = ~is_frequent[history]
                    listed, place = np.unique(history[rare], return_inverse=True)
                    number = at[history]
                    number[rare] = len(frequent) + place
                    near, beyond = number[: len(own)], number[len(own) :]
                    blob = packed(steps(hashes[a:b]), total[a:b], small(np.bincount(w[own] - a, minlength=b - a)), small(near), small(count[own]), steps(hashes[listed]), small(in_split[w[far]]), small(beyond), small(count[far]))
                    rows.append((bucket, blob))
                for i in range(0, len(rows), 64):
                    part = rows[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([block.as_py()] * len(part), pa.int64()), pa.array([x[1] for x in part], pa.binary())], ["bucket", "block", "blob"])
        trim()

    return map_batches(made.select("block", "words", "stream"), run, "bucket long, block long, blob binary")


COUNTS = "kind string, block long, bucket long, blob binary, word long, total long, histories array<long>, counts array<long>"


def count_pairs(dealt: DataFrame, frequent: np.ndarray, split: np.ndarray, split_c: np.ndarray) -> DataFrame:
    """What a bucket knows, by kind.

    tallies: counts, how many pairs were seen 1, 2, ... K + 1 times. pairs: a word, its count `total`, histories and how often each
    was seen with it. replies: for a block, counts of its words and pairs in the order of its blob, and which words are frequent.
    asks: for a block, the pairs (places in `counts`) of a history (`word`) that were never seen, but for frequent histories.
    """
    names = [x.split()[0] for x in COUNTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def rows(kind: str, n: int, **columns) -> pa.Table:
        return pa.Table.from_arrays([pa.array([kind] * n, pa.string()) if c == "kind" else columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names)

    def run(found: pa.Table) -> pa.Table:
        bucket = found["bucket"][0].as_py()
        got = [unpacked(x.as_py()) for x in found["blob"]]
        block = found["block"].to_numpy()
        own = [np.cumsum(x[0]) for x in got]
        word, word_at = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(word_at, np.concatenate([x[1] for x in got])).astype(np.int64)
        edges = np.cumsum([0, *map(len, own)])
        word_of = [word_at[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        is_frequent = np.isin(word, frequent)
        out, seen_counts, replies, asks = [], np.zeros(K + 1, np.int64), [[total[x]] for x in word_of], []
        offset = np.zeros(len(got), np.int64)
        for apart in (False, True):
            if apart:
                w_name, w_total, w = split, split_c, [x[6].astype(np.int64) for x in got]
            else:
                w_name, w_total, w = word, total, [np.repeat(x, y[2]) for x, y in zip(word_of, got, strict=True)]
            codes, count = ([x[i].astype(np.int64) for x in got] for i in ((7, 8) if apart else (3, 4)))
            count = np.concatenate(count)
            used = [np.flatnonzero(np.bincount(x, minlength=1)) if len(x) else np.zeros(0, np.int64) for x in codes]
            h_names = [np.concatenate([frequent, np.cumsum(y[5])])[u] for u, y in zip(used, got, strict=True)]
            h_name, h_no = np.unique(np.concatenate(h_names), return_inverse=True)
            ends = np.cumsum([0, *map(len, used)])
            h = [h_no[a:b][np.searchsorted(u, x)] for a, b, u, x in zip(ends[:-1], ends[1:], used, codes, strict=True)]
            del codes, used, h_names, h_no
            sizes = np.array([len(x) for x in w], np.int64)
            pair, pair_at = np.unique(np.concatenate(w) * max(1, len(h_name)) + np.concatenate(h), return_inverse=True)
            del w, h
            r = np.bincount(pair_at, count, len(pair)).astype(np.int64)
            seen = np.flatnonzero(r)
            pw, ph = pair[seen] // max(1, len(h_name)), pair[seen] % max(1, len(h_name))
            seen_counts += np.bincount(r[seen], minlength=K + 2)[1 : K + 2]
            new = np.concatenate([[True], pw[1:] != pw[:-1]])[: len(pw)]
            run_start = np.maximum.accumulate(np.where(new, np.arange(len(pw)), 0)) if len(pw) else np.zeros(0, np.int64)
            start = np.flatnonzero((np.arange(len(pw)) - run_start) % ROW_PAIRS == 0)
            out.append(rows("pairs", len(start), word=pa.array(w_name[pw[start]].view(np.int64)), total=pa.array(w_total[pw[start]], pa.int64()), histories=lists(h_name[ph].view(np.int64), start, pa.int64()), counts=lists(r[seen], start, pa.int64())))
            each = r[pair_at]
            which = np.repeat(np.arange(len(got)), sizes)
            first = np.cumsum(sizes) - sizes
            for i, (a, n) in enumerate(zip(first.tolist(), sizes.tolist(), strict=True)):
                replies[i].append(each[a : a + n])
            history = pair[pair_at] % max(1, len(h_name))
            common = np.isin(h_name, frequent) | (h_name == np.uint64(START))
            lost = np.flatnonzero((each == 0) & ~common[history]) if len(each) else np.zeros(0, np.int64)
            asks.append((which[lost], h_name[history[lost]], lost - first[which[lost]] + offset[which[lost]]))
            offset += sizes
            del pair, pair_at, r, each, history, which
        out.append(rows("tallies", 1, counts=lists(seen_counts, np.zeros(1, np.int64), pa.int64())))
        which, history, place = (np.concatenate(x) for x in zip(*asks, strict=True))
        order = np.lexsort((place, history, which))
        which, history, place = which[order], history[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (history[1:] != history[:-1])])[: len(which)])
        n = len(start)
        out.append(rows("asks", n, block=pa.array(block[which[start]]), bucket=pa.array(np.full(n, bucket)), word=pa.array(history[start].view(np.int64)), counts=lists(place, start, pa.int64())))
        at_frequent = np.searchsorted(frequent, word)
        blobs = []
        for (c, near, far), x in zip(replies, word_of, strict=True):
            known = np.flatnonzero(is_frequent[x])
            blobs.append(packed(small(c), small(near), small(far), small(known), small(at_frequent[x[known]])))
        out.append(rows("replies", len(got), block=pa.array(block), bucket=pa.array(np.full(len(got), bucket)), blob=pa.array(blobs, pa.binary())))
        trim()
        return pa.concat_tables(out)

    return dealt.groupBy("bucket").applyInArrow(run, COUNTS)


def history_weights(pairs: DataFrame, unigram: Column, d2: np.ndarray) -> DataFrame:
    """history, c (how often it was one in training) and weight, its backoff weight; unigram: P(word) from a word's `total`."""
    each = pairs.select(unigram.alias("p"), F.explode(F.arrays_zip("histories", "counts")).alias("x")).select("p", F.col("x.histories").alias("history"), F.col("x.counts").alias("r"))
    kept = F.when(F.col("r") > K, 1.0).otherwise(F.element_at(F.array(*[F.lit(float(x)) for x in d2[1:]]), F.least("r", F.lit(K)).cast("int"))) * F.col("r")
    sums = each.groupBy("history").agg(F.sum("r").alias("c"), F.sum(kept).alias("kept"), F.sum("p").alias("p"))
    return sums.select("history", "c", ((1 - F.col("kept") / (F.col("c") + 1)) / (1 - F.col("p"))).alias("weight"))


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def evaluate(parts: DataFrame, unigram: tuple[int, int, int, np.ndarray, float], d2: np.ndarray, frequent_weight: np.ndarray, start_weight: float, least_split: float, buckets: int) -> DataFrame:
    """Scores of the documents of each block, from its stream (bucket null), the replies (blob) and answers (places, gain: log10 of a weight) to it."""
    n_train, n_types, starts, d1, unknown = unigram

    def run(found: pa.Table) -> pa.Table:
        bucket = found["bucket"].to_numpy().astype(float)
        s = Stream(found["blob"][int(np.flatnonzero(np.isnan(bucket))[0])].as_py())
        answered = ~found["gain"].is_null().to_numpy()
        replied = np.flatnonzero(~np.isnan(bucket) & ~answered)
        replied = replied[np.argsort(bucket[replied])]
        got = [unpacked(found["blob"][int(i)].as_py()) for i in replied]
        c = np.concatenate([x[0] for x in got]).astype(np.int64)
        of = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
        log_weight = np.zeros(s.n_words)
        known, place = (np.concatenate([x[i] for x in got]).astype(np.int64) for i in (3, 4))
        known += np.repeat(np.searchsorted(of, np.arange(len(got))), [len(x[3]) for x in got])
        log_weight[known] = frequent_weight[place]
        log_weight[s.start] = start_weight
        # The pairs in the order in which they were dealt.
        key, at = np.unique(s.key, return_inverse=True)
        s.key = None
        w, h = key // s.n_words, key % s.n_words
        del key
        is_split = np.zeros(s.n_words, bool)
        is_split[known] = c[known] > least_split
        in_frequent = np.zeros(s.n_words, np.int64)
        in_frequent[known] = place
        alone, apart = np.flatnonzero(~is_split[w]), np.flatnonzero(is_split[w])
        apart = apart[np.argsort((bucket[replied].astype(np.int64)[of[h[apart]]] + in_frequent[w[apart]] * STRIDE) % buckets, kind="stable")]
        r = np.empty(len(w), np.int64)
        r[alone], r[apart] = np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
        backoff = log_weight[h]
        asked = found.filter(pa.array(answered))
        if asked.num_rows:
            bucket_no = np.searchsorted(bucket[replied], asked["bucket"].to_numpy())
            places = asked["places"].combine_chunks()
            size = places.value_lengths().to_numpy()
            place, bucket_no, gain = places.flatten().to_numpy(), np.repeat(bucket_no, size), np.repeat(asked["gain"].to_numpy(), size)
            near, far = (np.array([len(x[i]) for x in got], np.int64) for i in (1, 2))
            near_at, far_at = np.cumsum(near) - near, np.cumsum(far) - far
            beyond = place - near[bucket_no]
            pair = np.empty(len(place), np.int64)
            pair[beyond < 0] = alone[(near_at[bucket_no] + place)[beyond < 0]]
            pair[beyond >= 0] = apart[(far_at[bucket_no] + beyond)[beyond >= 0]]
            backoff[pair] = gain
        log_p = np.log10(np.where(c > 0, np.where(c <= K, d1[np.minimum(c, K)], 1.0) * c / (n_train + 1), unknown))
        history_c = c.copy()
        history_c[s.start] = starts
        seen = np.where(r <= K, d2[np.minimum(r, K)], 1.0) * r
        score = np.where(r > 0, np.log10(np.where(r > 0, seen, 1.0)) - np.log10(history_c[h] + 1.0), backoff + log_p[w])
        base = np.log10(c + 0.1) - math.log10(n_train + 0.1 * (n_types + 1))
        total = lambda x: np.add.reduceat(x, s.first)  # noqa: E731  every text has its end
        made = [pa.array(s.ids, pa.int64(), mask=~s.has_id), pa.array(s.sizes), pa.array(total((c > 0)[s.word].astype(np.int64))), pa.array(total(base[s.word])), pa.array(total(score[at]))]
        trim()
        return pa.Table.from_arrays(made, [x.split()[0] for x in SCORES.split(", ")])

    return parts.groupBy("block").applyInArrow(run, SCORES)


def score(docs: DataFrame, held_out_fold: int = 10) -> DataFrame:
    """Trains on the rows of docs (doc_id, text; others are ignored) whose fold is not 0 and scores all.

    One row for each row, rows that share an id included: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    A null or empty text is its end alone; texts are read whole, and one longer than a block is a block of
    its own. A null doc_id stays null and counts as the empty text in the fold. Without training rows every
    token is unknown, with probability one under the model. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    in_blocks = materialize(blocks(docs, fold(F.col("doc_id"), held_out_fold) != 0), "katz-blocks")
    unigrams = materialize(token_counts(in_blocks), "katz-unigrams")
    release(spark)
    stats = unigrams.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2)], F.max(F.when(F.col("token") == END_LONG, F.col("c"))).alias("ends"), F.sum(F.when(F.col("c") > K, F.col("c"))).alias("often")).first()
    n, v, ends = stats["n"] or 0, stats["v"], stats["ends"] or 0
    seen = {r: stats[f"n{r}"] for r in range(1, K + 2)}
    d1 = discounts(seen)
    unknown = 1 - (sum(d1[r] * r * seen[r] for r in range(1, K + 1)) + (stats["often"] or 0)) / (n + 1)
    level = F.floor(F.log2("c") * 16)
    sizes = sorted(((r["level"], r["n"]) for r in unigrams.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 1024 levels
    upto = np.cumsum([k for _, k in sizes])
    levels = [at for (at, _), k in zip(sizes, upto, strict=True) if k <= FREQUENT]
    often = level >= levels[-1] if levels else F.lit(False)
    top = unigrams.filter(often).toPandas()  # at most FREQUENT rows
    order = np.argsort(top["token"].to_numpy(np.int64).view(np.uint64))
    frequent, frequent_c = top["token"].to_numpy(np.int64).view(np.uint64)[order], top["c"].to_numpy(np.int64)[order]
    least_split = min(n / 4096, BUCKET_TOKENS)
    is_split = frequent_c > least_split
    buckets = max(LEAST_BUCKETS, int(n / (1 - 1 / held_out_fold)) // BUCKET_TOKENS)
    dealt = deal(in_blocks, frequent, frequent[is_split], buckets)
    counted = materialize(count_pairs(dealt, frequent, frequent[is_split], frequent_c[is_split]), "katz-pairs", partition_by="kind")
    del dealt
    release(spark)
    tallies = {r["i"] + 1: r["n"] for r in counted.filter("kind = 'tallies'").select(F.posexplode("counts").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("n")).collect()}  # K + 1 rows
    d2 = discounts(tallies)
    unigram = F.when(F.col("total") > K, 1.0).otherwise(F.element_at(F.array(*[F.lit(float(x)) for x in d1[1:]]), F.least("total", F.lit(K)).cast("int"))) * F.col("total") / F.lit(n + 1)
    histories = materialize(history_weights(counted.filter("kind = 'pairs'").select("total", "histories", "counts"), unigram, d2), "katz-histories")
    release(spark)
    common = histories.filter(often | (F.col("history") == START_LONG)).toPandas()  # at most FREQUENT + 1 rows
    logs = dict(zip(common["history"].tolist(), np.log10(common["weight"].to_numpy(float)).tolist(), strict=True))
    frequent_weight = np.array([logs.get(x, 0.0) for x in frequent.view(np.int64).tolist()], float)
    asks = counted.filter("kind = 'asks'").select("block", "bucket", F.col("word").alias("history"), F.col("counts").alias("places"))
    answers = asks.join(histories.select("history", "weight"), "history", "left").select("block", "bucket", "places", F.coalesce(F.log10("weight"), F.lit(0.0)).alias("gain"))
    parts = in_blocks.select("block", F.col("stream").alias("blob")).unionByName(counted.filter("kind = 'replies'").select("block", "bucket", "blob"), allowMissingColumns=True)
    parts = parts.unionByName(answers, allowMissingColumns=True)
    each = evaluate(parts.select("block", "bucket", "blob", "places", "gain"), (n, v, ends, d1, unknown), d2, frequent_weight, logs.get(START_LONG, 0.0), least_split, buckets)
    return each.select("doc_id", (fold(F.col("doc_id"), held_out_fold) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
