"""Toxicity by a classifier chain.

Categories are learnt one after the other, each by a logistic model on presence of words, word beginnings and
five-letter runs, a few shape measures, and the probabilities of the categories before it. While training, those
probabilities are out-of-fold: each labelled text is judged by models that have not seen its fold; all texts are
then judged by models of all folds. Each model's features are chosen from the texts it is fitted on. The models are fitted on at most `max_labelled` labelled texts, chosen by a
hash of their id; the features are chosen by chi-square. Scoring covers every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import ship

from .common import plus, slices, stash, table, texts, tidy

#: The documented bounds of the fit: labelled texts, folds, features per category.
MAX_LABELLED, FOLDS, PER_CATEGORY = 10_000, 3, 128
#: The chain, in its order: name, and the label from the columns of labels.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
THRESHOLD = 0.5
SHAPES = 5
CACHE = 100_000
#: Longer words are whole in every text, but not remembered for the next.
REMEMBERED = 40

_WORD = re.compile(r"[^\W\d_]+")


def of_word(word: str) -> set[str]:
    """A word's features: itself, its first four and five letters, its runs of five letters."""
    out = {word[i : i + 5] for i in range(len(word) - 4)}
    if len(word) >= 4:
        out |= {"^" + word[:4], "^" + word[:5]}
    out.add("=" + word)
    return out


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def shapes(text: str) -> list[float]:
    """Shares of signs, digits and capitals, mean word length and log of the length, each about 0 to 1."""
    n = len(text)
    if not n:
        return [0.0] * SHAPES
    blank = text.count(" ") + text.count("\n")
    letters = sum(map(len, _WORD.findall(text)))
    digits = sum(map(text.count, "0123456789"))
    signs = max(0, n - blank - letters - digits)
    return [signs / n, digits / n, min(1.0, text.count("\n") / n * 10), min(1.0, n / (blank + 1) / 20), math.log1p(n) / 15]


@dataclass
class Chain:
    """The chosen features' numbers, and per category its bias and weights over features, shapes and earlier categories."""

    names: list[str]
    features: dict[str, int]
    biases: list[float]
    weights: list[np.ndarray]

    def predict(self, present: list[np.ndarray], shape: np.ndarray) -> np.ndarray:
        """Probabilities (texts, categories)."""
        n, k = len(present), len(self.features)
        out = np.zeros((n, len(self.names)))
        for c, (bias, weight) in enumerate(zip(self.biases, self.weights, strict=True)):
            z = bias + np.array([weight[p].sum() for p in present]).reshape(n) + shape @ weight[k : k + SHAPES] + out[:, :c] @ weight[k + SHAPES :]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights, the last the bias, by Newton's method with a ridge. Of one class alone the bias says so."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    if not len(x):
        w[-1] = -30.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _fold(doc_id: Column) -> Column:
    """By a hash: labels that stand at every third id are still in all folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, max_labelled: int = MAX_LABELLED) -> Chain:
    """A chain from docs (doc_id, text) and labels (doc_id and the columns that categories name)."""
    names = [c for c, _ in categories]
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.expr(rule)).alias(f"label_{c}") for c, rule in categories])
    known = known.where(" or ".join(f"label_{c} is not null" for c in names))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows
    own = stash(own.withColumn("fold", _fold(F.col("doc_id"))), "labelled")
    columns = [f"label_{c}" for c in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in range(FOLDS)]
        cells: list[Counter] = [Counter() for _ in range(FOLDS * len(columns))]

        def out() -> pa.RecordBatch:
            keys = list(set().union(*found))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([[c[k] for c in own] for k in keys], pa.list_(pa.int64())) for own in (found, cells))], ["feature", "n", "hits"])

        for part in slices(batches):
            folds, marks = part.column("fold").to_pylist(), [part.column(c).to_pylist() for c in columns]
            for i, text in enumerate(texts(part)):
                own = set().union(*map(of_word, words_of(text.decode("utf-8", "replace"))))
                found[folds[i]].update(own)
                for c, mark in enumerate(marks):
                    if mark[i]:
                        cells[c * FOLDS + folds[i]].update(own)
            if sum(map(len, found)) > 2 * CACHE:
                yield out()
                found, cells = [Counter() for _ in range(FOLDS)], [Counter() for _ in cells]
        yield out()

    # Counts by fold: those of the texts outside a fold are sums over the others.
    counted = own.mapInArrow(count, "feature string, n array<long>, hits array<long>").groupBy("feature")
    sums = [F.sum(F.col("n")[f]).alias(f"n{f}") for f in range(FOLDS)] + [F.sum(F.col("hits")[c * FOLDS + f]).alias(f"hit{f}_{name}") for c, name in enumerate(names) for f in range(FOLDS)]
    counted = stash(counted.agg(*sums).where(" + ".join(f"n{f}" for f in range(FOLDS)) + " >= 3"), "features")
    sizes = {r.fold: r for r in own.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.col(f"label_{c}").cast("int")).alias(c) for c in names]).collect()}
    features: dict[str, int] = {}

    def choose(folds: list[int]) -> np.ndarray:
        """The numbers of the features chosen from texts of these folds."""
        total, out = sum(sizes[f]["n"] for f in folds if f in sizes), []
        n = sum((F.col(f"n{f}") for f in folds), F.lit(0))
        for c in names:
            share = sum(sizes[f][c] or 0 for f in folds if f in sizes) / max(1, total)
            off = sum((F.col(f"hit{f}_{c}") for f in folds), F.lit(0)) - n * share
            score = off * off / (n * max(share * (1 - share), 1e-9))
            for row in counted.where(n >= 3).orderBy(score.desc(), "feature").limit(PER_CATEGORY).collect():
                out.append(features.setdefault(row.feature, len(features)))
        return np.unique(np.array(out, np.int64))

    chosen_by = [choose([f for f in range(FOLDS) if f != held]) for held in range(FOLDS)]
    chosen_all = choose(list(range(FOLDS)))
    k = len(features)
    rows = present_in(own.select("doc_id", "fold", *columns, "text"), features).drop("text").orderBy("doc_id").toArrow()
    present = rows.column("present").combine_chunks()
    has = np.zeros((rows.num_rows, k), np.uint8)
    has[np.repeat(np.arange(rows.num_rows), pc.list_value_length(present).to_numpy()), present.flatten().to_numpy()] = 1
    rest = np.zeros((rows.num_rows, SHAPES + len(names)))
    rest[:, :SHAPES] = rows.column("shape").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, SHAPES)
    fold = rows.column("fold").to_numpy()
    marks = {column: rows.column(column).to_pylist() for column in columns}
    del rows, present

    def x(which: np.ndarray, used: np.ndarray, width: int) -> np.ndarray:
        """Of these texts the features used, the shapes and the probabilities before."""
        return np.hstack([has[np.ix_(which, used)], rest[which, : width - k]])

    biases, weights = [], []
    for c, column in enumerate(columns):
        width = k + SHAPES + c
        there = np.array([m is not None for m in marks[column]], bool)
        y = np.array([float(bool(m)) for m in marks[column]])
        w = logistic(x(there, chosen_all, width), y[there])
        whole = np.zeros(width)
        whole[np.concatenate([chosen_all, np.arange(k, width)])] = w[:-1]
        biases.append(float(w[-1]))
        weights.append(whole)
        for f in range(FOLDS):  # what later categories are trained with
            held = fold == f
            v = logistic(x(there & ~held, chosen_by[f], width), y[there & ~held])
            rest[held, width - k] = 1 / (1 + np.exp(-np.clip(x(held, chosen_by[f], width) @ v[:-1] + v[-1], -30, 30)))
    del has, rest, marks
    tidy()  # the driver's memory
    # Features that only out-of-fold models have are not looked for any more.
    kept = {f: i for i, f in enumerate(name for name, j in features.items() if j in set(chosen_all.tolist()))}
    order = [features[f] for f in kept]
    return Chain(names, kept, biases, [np.concatenate([w[order], w[k:]]) for w in weights])


def _find(features: dict[str, int], known: dict[str, tuple[int, ...]], text: str) -> np.ndarray:
    out: set[int] = set()
    for word in words_of(text):
        own = known.get(word)
        if own is None:
            own = tuple(features[f] for f in of_word(word) if f in features)
            if len(word) <= REMEMBERED:
                known[word] = own
        out.update(own)
    return np.fromiter(sorted(out), np.int64, len(out))


def present_in(docs: DataFrame, features: dict[str, int], column: str = "text") -> DataFrame:
    """`docs` with present array<int>, the numbers of the features in its text, and shape array<double>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for part in slices(batches, column):
            data = [t.decode("utf-8", "replace") for t in texts(part, column)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_find(features, known, t) for t in data], pa.list_(pa.int32())), pa.array([shapes(t) for t in data], pa.list_(pa.float64()))], [*part.schema.names, "present", "shape"])
            if len(known) > CACHE:
                known.clear()

    return docs.mapInArrow(work, plus(docs, "present array<int>, shape array<double>"))


def judge(docs: DataFrame, chain: Chain, column: str = "text") -> DataFrame:
    """`docs` with p_<category> double for each category of the chain; 0.0 for texts that are null, empty or blank."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred features
    names = [f"p_{c}" for c in chain.names]
    keep = docs.drop(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        chain = shared.value
        for part in slices(batches, column):
            data = [t.decode("utf-8", "replace") for t in texts(part, column)]
            p = chain.predict([_find(chain.features, known, t) for t in data], np.array([shapes(t) for t in data]).reshape(len(data), SHAPES))
            p[[not t or t.isspace() for t in data]] = 0.0
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, c]) for c in range(p.shape[1]))], [*part.schema.names, *names])
            if len(known) > CACHE:
                known.clear()

    return keep.mapInArrow(work, plus(keep, ", ".join(f"`{c}` double" for c in names)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with p_low_quality, p_toxic and is_toxic, each row judged; models from labels. Without labels nothing is toxic.

    A null, empty or blank text has no words and is not toxic: its probabilities are 0.0. A text with several labels counts once, as toxic if any says so.
    """
    chain = fit(docs, labels)
    judged = judge(docs.drop("is_toxic"), chain)
    return judged.withColumn("is_toxic", is_toxic(threshold))


def is_toxic(threshold: float = THRESHOLD) -> Column:
    return F.col("p_toxic") >= threshold


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, is_toxic for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, as they are."""
    ship(spark)
    return toxicity(docs, table(spark, sf_dir, "labels")).where("not is_toxic").select(*docs.columns)
