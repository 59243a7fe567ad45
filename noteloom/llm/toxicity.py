"""Toxicity by weak supervision.

Voters look at a text's distinct words and shape: fixed lexicons, lexicons mined from labelled
training rows, patterns, and the annotators' labels themselves. A generative model of the votes, fitted
by expectation maximisation on how often each combination of votes occurs in all documents,
estimates each voter's rates given the hidden class; voters that still agree more than the class
explains are correlated, and share their weight. A linear classifier is then trained on the posterior
labels of a bounded sample of labelled training rows, and scores every whole text.

Bounds: a vote has three values and there are VOTERS voters, so there are at most 3^VOTERS combinations;
the classifier sees at most ``most_positive`` and ``most_negative`` labelled rows (all there are, below that).

Defined results: a null or empty text has no words and gets the score of the bias alone; case does
not matter; repeated rows get equal scores; without labelled training rows the fixed lexicons decide; a row
without a doc_id has no label and is scored like any other; very long texts are scored whole; equally good training rows are taken by
a hash of their id; other columns, whatever their names, are not looked at, and ``keep_clean`` carries them along; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, ship

#: Fixed lexicons.
LEXICONS = {
    "wits": "idiot moron stupid fool imbecile dumb dunce cretin dimwit halfwit brainless simpleton",
    "worth": "worthless pathetic loser scum trash garbage vermin parasite useless failure nobody lowlife",
    "disgust": "disgusting clown freak filthy vile repulsive ugly creep sickening revolting pig rat",
}
MINED = ("word", "stem", "sized")
VOTERS = len(LEXICONS) + len(MINED) + 3
WORD = re.compile(r"[^\W\d_]+")
FEATURES = 1 << 22
#: Least toxic training rows with a mined entry, and least share of toxic rows among all that have it.
MINED_ROWS, MINED_SHARE = 3, 0.75
#: Conditional correlation from which voters share their weight.
CORRELATED = 0.25


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


IN_LEXICONS = {w: [k for k, held in enumerate(LEXICONS.values()) if w in held.split()] for w in " ".join(LEXICONS.values()).split()}


def feature_ids(word: str) -> list[int]:
    """The word's features as numbers below FEATURES; what is left by division by 4 tells the kind.

    Features are the word itself, its stems of 4 to 7 letters, stems with the word's length, and the lexicons it is in. The
    start value of each checksum keeps the kinds and lengths apart.
    """
    n, crc = len(word), zlib.crc32
    out = [crc(word.encode(), 1) % (FEATURES // 4) * 4]
    for k in (4, 5, 6, 7):
        if n <= k:
            break
        stem = word[:k].encode()
        out.append(crc(stem, 2) % (FEATURES // 4) * 4 + 1)
        if k != 5:
            out.append(crc(stem, 100 + n) % (FEATURES // 4) * 4 + 2)
    for k in IN_LEXICONS.get(word, ()):
        out.append(4 * k + 3)
    return out


def votes(words: set[str], text: str, masks: Masks | list[int]) -> list[int]:
    """One vote in (-1, 0, 1) for each voter but the annotators; masks may be those of the words that have any."""
    seen = [0] * (len(LEXICONS) + len(MINED))
    for mask in filter(None, map(masks.__getitem__, words)) if isinstance(masks, dict) else masks:
        for k in range(len(seen)):
            seen[k] += mask >> k & 1
    n = max(len(words), 1)
    lex = [1 if x else 0 for x in seen[: len(LEXICONS)]]
    # A mined entry can occur by chance in a long text: one hit in hundreds of words is no vote.
    learnt = [1 if x and x * 150 >= n else (-1 if not x else 0) for x in seen[len(LEXICONS) :]]
    absent = -1 if not any(seen) else (1 if sum(map(bool, seen[: len(LEXICONS)])) > 1 else 0)
    loud = 1 if text.count("!") * 20 > len(text) else 0
    return [*lex, *learnt, absent, loud]


class Masks(dict):
    """Word to voter mask, worked out when a word is first met; at most ``kept`` words are held."""

    def __init__(self, mined: set[int], kept: int = 200_000):
        super().__init__()
        self.mined, self.kept = mined, kept

    def mask(self, word: str, ids: list[int]) -> int:
        mask = 0
        for k in IN_LEXICONS.get(word, ()):
            mask |= 1 << k
        for f in ids:
            if f in self.mined:
                mask |= 1 << (len(LEXICONS) + f % 4)
        return mask

    def __missing__(self, word: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        found = self[word] = self.mask(word, feature_ids(word))
        return found


def distinct_features(words: set[str]) -> np.ndarray:
    """The numbers of the features of a text's words, each once, in order."""
    return np.unique(np.fromiter((f for w in words for f in feature_ids(w)), np.int32))


class Rows:
    """The distinct features of bounded training rows, as places in one list of features."""

    def __init__(self, held: list[np.ndarray]):
        self.n = len(held)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(h) for h in held])
        every = np.concatenate([*held, np.empty(0, np.int32)])
        df = np.bincount(every, minlength=FEATURES)
        often = df >= MINED_ROWS
        self.feature, place = np.flatnonzero(often).astype(np.int32), np.cumsum(often, dtype=np.int32) - 1
        kept = often[every]
        self.row, every = self.row[kept], every[kept]
        self.column = place[every]
        self.df = df[self.feature]

    def mine(self, toxic: np.ndarray, weight: np.ndarray) -> set[int]:
        """Features that mostly toxic rows have."""
        bad = np.bincount(self.column, weights=toxic[self.row], minlength=len(self.feature))
        heavy = np.bincount(self.column, weights=(toxic * weight)[self.row], minlength=len(self.feature))
        every = np.bincount(self.column, weights=weight[self.row], minlength=len(self.feature))
        good = (bad >= MINED_ROWS) & (heavy >= MINED_SHARE * (every + 1)) & (self.feature % 4 < len(MINED))
        return set(self.feature[good].tolist())


#: Annotated rows from which correlations are taken from them alone.
TOLD_ROWS = 100


class LabelModel:
    """Class-conditional vote rates by EM over (votes, count) combinations, with shared weight for correlated voters."""

    def fit(self, patterns: np.ndarray, n: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
        """patterns: combinations x voters in (-1, 0, 1), the last voter the annotators'; prior: share of class 1 to start from."""
        voters = patterns.shape[1]
        onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # combinations, voters, votes
        # Start: a voter is right four times in five when it does not abstain.
        self.rates = np.empty((2, voters, 3))
        base = np.einsum("c,cvk->vk", n, onehot) / n.sum() + 1e-3
        for y in (0, 1):
            tilt = np.array([4.0, 1.0, 0.25] if y == 0 else [0.25, 1.0, 4.0])
            self.rates[y] = base * tilt
        self.rates /= self.rates.sum(axis=2, keepdims=True)
        self.prior, self.weight = float(np.clip(prior, 1e-3, 0.5)), np.ones(voters)
        for turn in range(rounds):
            p = self.posterior(patterns)
            for y, q in ((0, 1 - p), (1, p)):
                held = np.einsum("c,cvk->vk", n * q, onehot) + 2.0 * self.rates[y]
                self.rates[y] = held / held.sum(axis=1, keepdims=True)
            self.prior = float(np.clip((n * p).sum() / n.sum(), 1e-3, 0.5))
            if turn == rounds // 5:
                self.weight = self._weights(patterns, n, p)
        return self

    def _weights(self, patterns: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """1 over 1 + the sum of a voter's correlations, given the class, with others."""
        self.correlation = np.zeros((patterns.shape[1],) * 2)
        told = patterns[:, -1] != 0
        if n[told].sum() >= TOLD_ROWS:  # voters that copy each other pull the posterior to them; annotated rows do not follow
            patterns, n, p = patterns[told], n[told], (patterns[told, -1] + 1) / 2
        for q in (1 - p, p):
            w = n * q + 1e-9
            share = w.sum() / n.sum()
            mean = (w[:, None] * patterns).sum(axis=0) / w.sum()
            off = patterns - mean
            spread = (w[:, None] * off).T @ off / w.sum()
            scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            self.correlation += share * np.where(np.minimum.outer(scale, scale) > 1e-3, spread / np.outer(scale, scale), 0)
        near = np.where(np.abs(self.correlation) >= CORRELATED, np.abs(self.correlation), 0.0)
        np.fill_diagonal(near, 0.0)
        near[-1] = near[:, -1] = 0.0  # the annotators keep their own weight
        return 1.0 / (1.0 + near.sum(axis=1))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        place = patterns + 1
        ratio = np.log(self.rates[1]) - np.log(self.rates[0])
        logit = np.log(self.prior / (1 - self.prior)) + (ratio[np.arange(patterns.shape[1]), place] * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Linear:
    """Logistic regression with soft labels on a text's distinct features and its votes."""

    def fit(self, rows: Rows, cast: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.05, ridge: float = 1e-3) -> Linear:
        """cast: votes of each row; target: posterior of class 1; weight: how many rows a row stands for."""
        if not rows.n:  # nothing to learn from: a vote for outweighs the bias
            self.words, self.votes, self.bias = {}, np.repeat([3.0, 0.0], cast.shape[1]), -2.5
            return self
        row, column = rows.row, rows.column
        dense = np.concatenate([cast == 1, cast == -1], axis=1).astype(float)
        k = len(rows.feature)
        coef, bias = np.zeros(k + dense.shape[1]), float(np.log((weight * target).sum() + 0.1) - np.log((weight * (1 - target)).sum() + 0.1))
        m, v = np.zeros(len(coef) + 1), np.zeros(len(coef) + 1)
        pull = np.concatenate([np.full(k, ridge), np.full(dense.shape[1], ridge / 50)])
        scale = weight / weight.sum()
        for t in range(1, rounds + 1):
            z = np.bincount(row, weights=coef[column], minlength=rows.n) + dense @ coef[k:] + bias
            g = scale * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            grad = np.concatenate([np.bincount(column, weights=g[row], minlength=k), dense.T @ g, [g.sum()]])
            grad[:-1] += pull * coef
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            coef, bias = coef - step[:-1], bias - step[-1]
        self.words = dict(zip(rows.feature.tolist(), coef[:k].tolist(), strict=True))
        self.votes, self.bias = coef[k:], float(bias)
        return self

    def score(self, total: float, cast: list[int]) -> float:
        """total: the sum of the weights of a text's distinct features."""
        n = len(cast)
        z = self.bias + total
        z += sum(self.votes[i] if v == 1 else self.votes[n + i] for i, v in enumerate(cast) if v)
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _code(cast: list[int]) -> int:
    """The votes as one number in base 3."""
    code = 0
    for v in cast:
        code = 3 * code + v + 1
    return code


def _votes(code: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def learnable(labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, toxic) of the labelled rows from which labels may be learnt; of several labels the largest."""
    rows = labels.filter(train).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null")
    return rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


class Model:
    """What scoring needs: the mined entries and the linear classifier; its size is bounded by the training rows' bound."""

    def __init__(self, mined: set[int], linear: Linear):
        self.mined, self.linear = mined, linear

    def scorer(self):
        known = Known(self)

        def score(text: str | None) -> float:
            words = words_of(text)
            total = known.total(words)
            return self.linear.score(total, votes(words, text or "", [known.masked[w] for w in words & known.masked.keys()]))

        return score


class Known(dict):
    """Word to the places of its weights, as bytes, worked out when a word is first met; ``masked`` holds the masks of words that have any."""

    def __init__(self, model: Model, kept: int = 200_000):
        super().__init__()
        self.masks, self.masked, self.kept = Masks(model.mined), {}, kept
        self.place = {f: k for k, f in enumerate(model.linear.words)}
        self.weight = np.fromiter(model.linear.words.values(), float, len(self.place))
        self.last, self.step = np.zeros(len(self.place), np.int32), np.arange(1 << 12, dtype=np.int32)

    def __missing__(self, word: str) -> bytes:
        ids = feature_ids(word)
        if mask := self.masks.mask(word, ids):
            self.masked[word] = mask
        found = self[word] = array("i", [self.place[f] for f in ids if f in self.place]).tobytes()
        return found

    def total(self, words: set[str]) -> float:
        """The sum of the weights of the words' features, each feature counted once."""
        if len(self) >= self.kept:  # between texts, so that no word of a text is forgotten before its masks are read
            self.clear()
            self.masked.clear()
        place = np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)
        if len(place) > len(self.step):
            self.step = np.arange(2 * len(place), dtype=np.int32)
        step = self.step[: len(place)]
        self.last[place] = step  # of several places of a feature one is left, which stands for it
        return float(self.weight[place[self.last[place] == step]].sum())


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, most_positive: int = 1500, most_negative: int = 3000) -> Model:
    """Fits the model on docs(doc_id, text) and labels(doc_id, toxic) where train_rows (of labels) holds.

    The classifier's rows are the ``most_positive`` toxic and ``most_negative`` other labelled training rows
    that come first by a hash of their id, each weighted by how many it stands for; the label model's vote
    counts are those of all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    known = cut(learnable(labels, train_rows), "labels")
    counted = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {0: most_negative, 1: most_positive}
    first = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y])
    chosen = F.broadcast(first(0).union(first(1)).withColumnRenamed("doc_id", "_id"))  # at most most_positive + most_negative rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [distinct_features(words_of(t.as_py())).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], ["doc_id", "toxic", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = rows.join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")
    got = sorted(sample.mapInArrow(features, "doc_id long, toxic int, features binary").collect(), key=lambda r: (r["doc_id"], bytes(r["features"])))
    keys, gold = [r["doc_id"] for r in got], np.array([r["toxic"] for r in got], float)
    weight = np.array([max(1.0, counted[int(y)] / most[int(y)]) for y in gold])
    held = Rows([np.frombuffer(r["features"], np.int32) for r in got])
    del got
    mined = held.mine(gold, weight)

    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = Masks(mined)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_code(votes(words_of(t), t, masks)) for t in texts], pa.int64())], ["doc_id", "code"])

    codes = cut(rows.mapInArrow(cast_votes, "doc_id long, code long"), "votes")
    combined = codes.join(known, "doc_id", "left").groupBy("code", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^VOTERS rows
    voters = VOTERS - 1
    if combined:
        patterns = np.array([[*_votes(r["code"], voters), 0 if r["toxic"] is None else 2 * r["toxic"] - 1] for r in combined])
        order = np.lexsort(patterns.T)
        seen = counted.get(0, 0) + counted.get(1, 0)
        label_model = LabelModel().fit(patterns[order], np.array([r["n"] for r in combined], float)[order], counted.get(1, 0) / seen if seen else 0.1)
    # Of rows that repeat a doc_id with other texts the smallest code stands for all.
    own = {r["doc_id"]: r["code"] for r in codes.join(chosen, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("code").alias("code")).collect()}
    cast = np.array([_votes(own[k], voters) for k in keys], int).reshape(-1, voters)
    target = label_model.posterior(np.column_stack([cast, (2 * gold - 1).astype(int)])) if keys else gold
    return Model(mined, Linear().fit(held, cast, target, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every text of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, below: float) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below ``below``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < below for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
