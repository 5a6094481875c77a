"""Language-model scores by context-tree weighting over bytes.

Texts are bytes with A-Z as a-z, and an end. Each symbol is binary decisions: whether the text ends here, and eight for a
byte. Each decision has a node per context of 0 to `depth` preceding bytes. A node's zeros and ones in the training texts
give a Krichevsky-Trofimov estimate; every inner node mixes its own estimate with those of its longer contexts, half and
half before the data, so all depths count by how well they coded the training texts. A text starts after `depth` zero
bytes. Its score is the log10 probability of its bytes and its end, so the probabilities of all texts add up to 1;
bits_per_byte is the code length.

Counts of grams (a symbol after its context) and of words are made in the tasks and summed by Spark; the tree is built by
grouping and joining nodes. Values of the HOT most frequent grams and words are broadcast; values of all other ones reach
their texts by a join on the key. Words are known by 64-bit digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Lookup, frequent, lowered, row_id, slices, stash, table, texts, word_codes

#: Preceding bytes of the longest context, where a caller says nothing else; 6 at most.
DEPTH = 3
#: Grams and words that are broadcast, at 16 bytes, of each.
HOT = 1 << 20
#: Words that a task sorts at one time.
SORTED = 4 << 20
FOLDS, HELD_OUT = 7, 2
#: Decisions of a symbol: whether the text ends comes first.
END, STOP = 256, 0
GRAM, WORD, TEXT = range(3)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def grams(data: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The codes of all grams of the texts (lower case), one text after the other: each has one for its bytes and one for its end."""
    pad = bytes(depth)
    flat = np.frombuffer(pad + b"".join(t + b"\0" + pad for t in data), np.uint8)
    n = len(flat) - depth
    codes = np.zeros(max(0, n), np.int64)
    for k in range(depth):
        codes |= flat[k : k + n].astype(np.int64) << (8 * (depth - 1 - k) + 9)
    symbols = flat[depth:].astype(np.int64)
    sizes = np.array([len(t) + 1 for t in data], np.int64)
    ends = np.cumsum(sizes + depth) - depth - 1
    symbols[ends] = END
    own = np.ones(max(0, n), bool)
    for k in range(1, depth + 1):  # the padding between two texts is none of them
        own[ends + k] = False
    return (codes | symbols)[own]


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n_train, n_all long) of words and grams of docs (text, held)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[np.ndarray]] = {(kind, side): [] for kind in (GRAM, WORD) for side in (False, True)}

        def counted(kind: int, side: bool) -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held[kind, side]), return_counts=True)
            held[kind, side] = []
            for at in range(0, len(keys), 100_000):
                own, times = keys[at : at + 100_000], n[at : at + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(times * (not side)), pa.array(times)], ["kind", "key", "n_train", "n_all"])

        for part in slices(batches, limit=2 << 20):
            sides = np.array(part.column("held").to_pylist(), bool)
            every = [lowered(t) for t in texts(part)]
            for side in (False, True):
                data = [every[i] for i in np.flatnonzero(sides == side)]
                if data:
                    held[WORD, side].append(word_codes(data)[0].view(np.int64))
                    codes = grams(data, depth)
                    held[GRAM, side].append(codes)
            for (kind, side), found in held.items():
                if sum(map(len, found)) > SORTED:
                    yield from counted(kind, side)
        for kind, side in held:
            if held[kind, side]:
                yield from counted(kind, side)

    found = docs.select("text", "held").mapInArrow(count, "kind int, key long, n_train long, n_all long")
    return found.groupBy("kind", "key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by eight; x over 0."""
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - F.log(product)


def _log_kt(zeros: Column, ones: Column) -> Column:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def _decisions(gram_counts: DataFrame) -> DataFrame:
    """(code, n_train, ctx, node, bit): the binary decisions of each gram's symbol."""
    symbol = F.col("code").bitwiseAND(511)
    stop = F.struct(F.lit(STOP).cast("long").alias("node"), (symbol == END).cast("long").alias("bit"))
    steps = [F.struct(((1 << k) + F.shiftright(symbol, 8 - k)).alias("node"), F.shiftright(symbol, 7 - k).bitwiseAND(1).alias("bit")) for k in range(8)]
    made = F.when(symbol == END, F.array(stop)).otherwise(F.array(stop, *steps))
    return gram_counts.select("code", "n_train", F.shiftright("code", 9).alias("ctx"), F.explode(made).alias("s")).select("code", "n_train", "ctx", "s.node", "s.bit")


def gram_scores(gram_counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, logp double): log10 of the probability of each gram's symbol after the bytes before it, from (code long, n_train long)."""
    n = F.col("n_train")
    level = _decisions(gram_counts).groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, n).otherwise(0)).cast("double").alias("n0"), F.sum(F.when(F.col("bit") == 1, n).otherwise(0)).cast("double").alias("n1"))
    level = level.withColumn("kt", _log_kt(F.col("n0"), F.col("n1"))).withColumn("log_w", F.col("kt"))
    levels = [stash(level, f"ctw{depth}")]
    for d in range(depth - 1, -1, -1):
        mask = (1 << (8 * d)) - 1
        up = levels[0].groupBy(F.col("ctx").bitwiseAND(mask).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))
        up = up.withColumn("kt", _log_kt(F.col("n0"), F.col("n1")))
        levels.insert(0, stash(up.withColumn("log_w", math.log(0.5) + _log_add(F.col("kt"), F.col("below"))), f"ctw{d}"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    share = F.exp(math.log(0.5) + F.col("kt") - F.col("log_w"))
    # From the root down: the mix so far, and what of the weight is left for longer contexts.
    first = share if depth else F.lit(1.0)
    mixed = levels[0].select("ctx", "node", (first * one).alias("mix"), (1 - first).alias("left"))
    for d in range(1, depth + 1):
        mask = (1 << (8 * (d - 1))) - 1
        own = F.lit(1.0) if d == depth else share
        here = levels[d].select("ctx", "node", F.col("ctx").bitwiseAND(mask).alias("up"), own.alias("share"), one.alias("one"))
        above = mixed.select(F.col("ctx").alias("up"), "node", "mix", "left")
        mixed = here.join(above, ["up", "node"]).select("ctx", "node", (F.col("mix") + F.col("left") * F.col("share") * F.col("one")).alias("mix"), (F.col("left") * (1 - F.col("share"))).alias("left"))
    p = F.when(F.col("bit") == 1, F.col("mix")).otherwise(1 - F.col("mix"))
    return _decisions(gram_counts).join(mixed.select("ctx", "node", "mix"), ["ctx", "node"]).groupBy("code").agg(F.sum(F.log10(p)).alias("logp"))


def score(docs: DataFrame, id_column: str = "doc_id", hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Null and empty texts are an end alone; their bits_per_byte is null. A null id is never held out. Rows that repeat are
    each scored and each counted. With no training row every word is unknown and every decision even. Texts may have any
    length; an empty table gives no rows; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_column).alias("doc_id"), "text").withColumn("held", held_out())
    counts = stash(corpus_counts(base, depth), "lm-counts")
    sums = counts.where(f"kind = {WORD}").agg(F.sum("n_train").alias("n"), F.count_if(F.col("n_train") > 0).alias("v")).first()
    ends = base.agg(F.count_if(~F.col("held")).alias("train"), F.count_if("held").alias("rest")).first()
    # The end is a token that every text has.
    n, v = (sums.n or 0) + ends.train, sums.v + (ends.train > 0)
    of_grams = stash(gram_scores(counts.where(f"kind = {GRAM}").select(F.col("key").alias("code"), "n_train"), depth), "lm-grams")
    marked = counts.withColumn("hot", (F.col("kind") == WORD) & frequent(counts.where(f"kind = {WORD}"), hot) | (F.col("kind") == GRAM) & frequent(counts.where(f"kind = {GRAM}"), hot))
    values = marked.where(f"kind = {WORD}").select("kind", "key", F.log10(F.col("n_train") + 1.0).alias("value"), (F.col("n_train") > 0).alias("known"), "hot")
    values = values.unionByName(marked.where(f"kind = {GRAM}").join(of_grams.withColumnRenamed("code", "key"), "key").select("kind", "key", F.col("logp").alias("value"), F.lit(False).alias("known"), "hot"))
    values = stash(values, "lm-values")

    def lookup(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = values.where(F.col("hot") & (F.col("kind") == kind)).select("key", "value", "known").toArrow()  # `hot` rows at most
        return own.column("key").to_numpy(), own.column("value").to_numpy(), own.column("known").to_numpy()

    shared = spark.sparkContext.broadcast((lookup(GRAM), lookup(WORD)))
    end_value, end_known = math.log10(ends.train + 1), int(ends.train > 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (gram_keys, gram_values, _), (word_keys, word_values, word_known) = shared.value
        of_gram, of_word = Lookup(gram_keys), Lookup(word_keys)
        for part in slices(batches, limit=1 << 20):
            data = [lowered(t) for t in texts(part)]
            uid = part.column("uid").to_numpy()
            sizes = np.array([len(t) for t in data], np.int64)
            codes = grams(data, depth)
            text = np.repeat(np.arange(len(data)), sizes + 1)
            at = of_gram.places(codes)
            score = np.bincount(text[at >= 0], gram_values[at[at >= 0]], len(data))
            words, counted = word_codes(data)
            word_text = np.repeat(np.arange(len(data)), counted)
            found = of_word.places(words.view(np.int64))
            hit = found >= 0
            base_sum = np.bincount(word_text[hit], word_values[found[hit]], len(data)) + end_value
            known = np.bincount(word_text[hit], word_known[found[hit]], len(data)).astype(np.int64) + end_known
            cold = [(text[at < 0], codes[at < 0], GRAM), (word_text[~hit], words.view(np.int64)[~hit], WORD)]
            rest = sum(len(t) for t, _, _ in cold)
            nothing = lambda kind: np.zeros(rest, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uid, *(uid[t] for t, _, _ in cold)])),
                    pa.concat_arrays([part.column("doc_id"), pa.nulls(rest, pa.int64())]),
                    pa.concat_arrays([part.column("held"), pa.nulls(rest, pa.bool_())]),
                    pa.array(np.concatenate([np.full(len(data), TEXT, np.int32), *(np.full(len(t), kind, np.int32) for t, _, kind in cold)])),
                    pa.array(np.concatenate([uid, *(k for _, k, _ in cold)])),
                    pa.array(np.concatenate([counted + 1, nothing(np.int64)])),
                    pa.array(np.concatenate([known, nothing(np.int64)])),
                    pa.array(np.concatenate([base_sum, nothing(np.float64)])),
                    pa.array(np.concatenate([score, nothing(np.float64)])),
                    pa.array(np.concatenate([sizes, nothing(np.int64)])),
                ],
                ["uid", "doc_id", "held", "kind", "key", "n_tokens", "n_known", "base", "score", "n_bytes"],
            )

    keyed = base.select(F.col("doc_id").cast("long"), "text", "held").withColumn("uid", row_id())
    parts = keyed.mapInArrow(work, "uid long, doc_id long, held boolean, kind int, key long, n_tokens long, n_known long, base double, score double, n_bytes long")
    joined = parts.join(values.where("not hot").select("kind", "key", "value", "known"), ["kind", "key"], "left")
    gain = F.coalesce("value", F.lit(0.0))
    summed = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.coalesce(F.col("known").cast("long"), F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + F.when(F.col("kind") == WORD, gain).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(F.col("kind") == GRAM, gain).otherwise(0.0)).alias("score"),
        F.sum("n_bytes").alias("n_bytes"),
    )
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        "score",
        "n_bytes",
        (F.when(F.col("n_bytes") > 0, -F.col("score") / math.log10(2) / F.col("n_bytes"))).alias("bits_per_byte"),
    )


def op7_context_tree(spark, sf_dir: str) -> DataFrame:
    """Scores of every document. Null and empty texts are one end; repeated rows stay and are learned from as often as they stand there. What `score` says of null ids holds."""
    return score(table(spark, sf_dir, "documents"))
