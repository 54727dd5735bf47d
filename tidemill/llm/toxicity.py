"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are word stems (the first four and five letters of words), present at all or dense (at least
twice and in 0.6 % of the words), that labelled training documents show to be far more frequent in
toxic ones, a fixed list of insults, and patterns. A voter says
toxic, clean or nothing. Given labels only choose the voters: the label model explains all votes by a hidden class, and EM, which
starts from the votes, estimates how often each voter says what in each class (its accuracy), and how strongly voters agree
beyond that (their correlations), by which the votes of groups that repeat each other are shrunk. The
posterior is the target of a logistic regression on stems and patterns, which scores every
document, and which may use stems that are no voters.

What is fitted is fitted on at most `most_labelled` training documents, and has at most `voters`
and `features` columns; everything else runs over all documents in parallel.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WordCache, fold, map_batches, texts

MOST_LABELLED = 40_000
VOTERS = 256
FEATURES = 2048
THRESHOLD = 0.7
STEMS = (4, 5)
#: A stem is dense from this share of the words on.
DENSE = 0.006
#: Least G-squared of a feature that votes (a chance of 1 in 10^5 for a feature that tells nothing).
SURE = 19.5
#: Common insults, fixed; further words come from the labelled documents.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb")
STRIP = b".,;:!?\"'()[]{}<>|*#$%&-_"
PATTERNS = ("caps", "bangs", "address", "dense", "none")


def stems(word: bytes) -> tuple[str, ...]:
    """The stems of one word (A-Z lower-cased) without its punctuation."""
    word = word.strip(STRIP).decode("utf-8", "ignore").lower()
    if len(word) < min(STEMS):
        return (f"={word}",) if word else ()
    return tuple({word[:n] if len(word) >= n else f"={word}" for n in STEMS} | ({f"={word}"} if word in INSULTS else set()))


def patterns(text: str, hits: int, n_words: int) -> list[int]:
    """Votes of the patterns, of which hits, the number of words with a lexical voter's stem, are a part."""
    if not hits:
        return [0, 0, 0, 0, -1]
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text))
    return [
        1 if shouted > 0.3 * n_words else 0,
        1 if "!!" in text else 0,
        1 if re.search(r"(?i)\b(?:you|your|du|tu|vous|ustedes?)\b", text) else 0,
        1 if hits >= 3 or hits >= 0.02 * n_words else 0,
        0,
    ]


def present(counts: dict[str, int], n_words: int) -> list[str]:
    """The features of a document with these stems: each stem, and stem@ where it is dense."""
    return [*counts, *(f"{s}@" for s, k in counts.items() if k >= 2 and k >= DENSE * n_words)]


def counted(train: DataFrame) -> DataFrame:
    """feature, toxic, clean: how many of the training documents of each class have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        cache = WordCache(stems)

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            rows = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)]
            return pa.RecordBatch.from_arrays(rows, ["feature", "toxic", "clean"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                words = text.encode().lower().split()
                seen[0 if toxic else 1].update(present(Counter(chain.from_iterable(map(cache.__getitem__, words))), len(words)))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
        yield out()

    made = map_batches(train.select("toxic", "text"), run, "feature string, toxic long, clean long")
    return made.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def vocabulary(counts: DataFrame, n_toxic: int, n_clean: int, features: int, voters: int) -> tuple[list[str], list[str]]:
    """The features that tell the classes apart best (by G-squared): those of the classifier, and those that vote."""
    n = n_toxic + n_clean
    has = F.col("toxic") + F.col("clean")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    cells = [(F.col("toxic"), has * n_toxic / n), (F.col("clean"), has * n_clean / n)]
    cells += [(F.lit(m) - F.col(c), (F.lit(n) - has) * m / n) for c, m in (("toxic", n_toxic), ("clean", n_clean))]
    scored = counts.filter(F.col("toxic") * max(1, n_clean) > 2 * F.col("clean") * n_toxic).filter("toxic >= 2")
    scored = scored.withColumn("g", sum((2 * term(a, b) for a, b in cells), F.lit(0.0)))
    best = scored.orderBy(F.desc("g"), "feature").limit(features).collect()  # at most `features` rows
    sure = [r["feature"] for r in best if r["g"] >= SURE and r["toxic"] >= 3 * r["clean"]]
    return [r["feature"] for r in best], sure[:voters]


def label_model(votes: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The posterior probability of toxic for each row of votes (1 toxic, -1 clean, 0 nothing), from the votes alone.

    EM starts from what two voters say; no given label is seen here.
    """
    n, m = votes.shape
    says = np.stack([votes == v for v in (1, 0, -1)]).astype(np.float64)  # 3 x n x m
    p = np.where((votes > 0).sum(axis=1) >= 2, 0.9, 0.1)
    shrink = np.ones(m)
    for step in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        weight = np.stack([p, 1 - p])
        accuracy = np.einsum("cn,vnm->cvm", weight, says, optimize=True) + 0.1
        accuracy /= accuracy.sum(axis=1, keepdims=True)  # class x vote x voter
        if step % 10 == 9:  # correlations within the classes, beyond what the class explains
            mean = np.einsum("cvm,v->cm", accuracy, np.array([1.0, 0.0, -1.0]))
            rest = votes - (p[:, None] * mean[0] + (1 - p)[:, None] * mean[1])
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            correlation = (rest.T @ rest) / n / np.outer(spread, spread)
            np.fill_diagonal(correlation, 0.0)
            shrink = 1 / (1 + (np.clip(correlation, 0, 1) ** 2).sum(axis=1))
        ratio = np.log(accuracy[0]) - np.log(accuracy[1])
        logit = np.log(prior / (1 - prior)) + np.einsum("vnm,vm->n", says, ratio * shrink, optimize=True)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - p).max() < 1e-6 and step > 10:
            break
        p = new
    return p


def logistic(columns: list[np.ndarray], target: np.ndarray, size: int, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for rows of binary features, given as column numbers, by accelerated gradient descent."""
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    column = np.concatenate([*columns, np.zeros(0, np.int64)]).astype(np.int64)
    weight, speed = np.zeros(size + 1), np.zeros(size + 1)
    square = np.zeros(size + 1)
    for step in range(1, steps + 1):
        logit = np.bincount(row, weight[column], len(columns)) + weight[size]
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        slope = np.append(np.bincount(column, error[row], size), error.sum()) / len(columns)
        slope[:size] += ridge * weight[:size]
        speed = 0.9 * speed + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        weight -= 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weight[:size], float(weight[size])


@dataclass
class Model:
    """What scores a document: columns of features, which of them vote, and the classifier."""

    columns: dict[str, int]
    voters: set[str]
    weight: list[float] = field(default_factory=list)
    bias: float = -4.0

    def cache(self) -> WordCache:
        wanted = {c.removesuffix("@") for c in self.columns}
        return WordCache(lambda word: tuple(s for s in stems(word) if s in wanted))

    def read(self, text: str, cache: WordCache) -> tuple[list[int], list[int]]:
        """The columns that a text has, and the patterns' votes."""
        words = text.encode().lower().split()
        counts = Counter(chain.from_iterable(filter(None, map(cache.__getitem__, words))))
        found = [f for f in present(counts, len(words)) if f in self.columns]
        hits = sum(counts[f.removesuffix("@")] for f in found if f in self.voters)
        return [self.columns[f] for f in found], patterns(text, hits, len(words))

    def features(self, found: list[int], votes: list[int]) -> list[int]:
        return [*found, *(len(self.columns) + i for i, v in enumerate(votes) if v)]


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, voters: int = VOTERS, features: int = FEATURES) -> Model:
    """The model from the labelled documents whose fold is not 1."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold(F.col("doc_id"), 3) != 1)
    n = known.count()
    if n > most_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most_labelled / n)))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    insults = [f"={w}" for w in INSULTS]
    names, sure = vocabulary(counted(train), sizes[1], sizes.get(0, 0), features, voters) if sizes.get(1) else ([], [])
    model = Model({s: i for i, s in enumerate(dict.fromkeys([*insults, *names]))}, {*insults, *sure})
    vote = sorted(model.columns[s] for s in model.voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.cache()
        for batch in batches:
            rows = [model.read(t, cache) for t in texts(batch)]
            made = [pa.array([a for a, _ in rows], pa.list_(pa.int32())), pa.array([b for _, b in rows], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(made, ["found", "votes"])

    seen = map_batches(train.select("text"), run, "found array<int>, votes array<tinyint>").toPandas()  # at most about most_labelled rows
    if not sizes.get(1):
        model.weight = [6.0] * len(insults) + [0.0] * len(PATTERNS)
        return model
    place = {c: j for j, c in enumerate(vote)}
    votes = np.zeros((len(seen), len(vote) + len(PATTERNS)), np.int8)
    for i, (found, cast) in enumerate(zip(seen["found"], seen["votes"], strict=True)):
        votes[i, [place[c] for c in found if c in place]] = 1
        votes[i, len(vote) :] = cast
    posterior = label_model(votes)
    rows = [np.array(model.features(list(found), list(cast)), np.int64) for found, cast in zip(seen["found"], seen["votes"], strict=True)]
    weight, model.bias = logistic(rows, posterior, len(model.columns) + len(PATTERNS))
    model.weight = weight.tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs (doc_id, text; others are ignored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.cache()
        for batch in batches:
            logits = np.array([model.bias + sum(model.weight[c] for c in model.features(*model.read(t, cache))) for t in texts(batch)], np.float64)
            made = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts have no stems and get the score of such texts; texts are read whole, however long; repeated rows, ties
    and null ids (fold of the empty text) stay; without toxic training labels the fixed insults alone vote; an empty
    table gives an empty result; lang, source and further columns are not read.
    """
    scored = score(docs, fit(docs, labels, **params))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
