"""Hard negatives by exact inner products in residue numbers.

Components become whole numbers. Their inner products are worked out modulo several small primes by float32 matrix
products, which are exact as long as the sums stay under 2 ** 24: residues lie in [-(p - 1) / 2, (p - 1) / 2], and columns
are taken in runs short enough for that. Chinese remaindering (mixed radix, balanced) gives the signed scores back; there are
as many primes as the largest possible score asks for.

Anchors go out in blocks of bounded size. Each block meets all rows: a task goes over its rows by id and keeps each
anchor's best ones, and a window over the tasks' finds ranks them. First each anchor's positives are found so, then, with
the windows of scores that the positives allow, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_id, stash, table

#: Bytes of an anchor block's components, and rows and anchors that meet at one time.
BLOCK_BYTES, ROWS, ANCHORS = 16 << 20, 2048, 512
#: Exactly held by float32.
EXACT = 1 << 24
#: Scores times 100 stay in 64 bits up to here; beyond, Python's integers are used.
PLAIN = (1 << 62) // 100
LONG = (1 << 63) - 1
#: The fewest columns in one run of a matrix product; a prime's size follows from it.
RUN = 64
SCALE = 256


def primes(bound: int, columns: int) -> list[int]:
    """Primes, from the largest whose sums over a run of columns are exact, whose product is over twice `bound`."""
    top = 2 * math.isqrt(EXACT // max(1, min(columns, RUN)))
    sieve = np.ones(top + 1, bool)
    for i in range(2, math.isqrt(top) + 1):
        sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[:2:-1].tolist():
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise OverflowError("scores that the primes do not reach")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers (as doubles) modulo p, balanced, as float32."""
    r = np.fmod(x, p)  # exact
    half = p // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


def _balanced(r: np.ndarray, p: int) -> np.ndarray:
    return r - np.rint(r / np.float32(p)) * np.float32(p)


def product(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """left @ right.T modulo p, balanced, of balanced residues."""
    run = max(1, EXACT // max(1, (p // 2) ** 2))
    out = None
    for at in range(0, left.shape[1], run):
        own = _balanced(left[:, at : at + run] @ right[:, at : at + run].T, p)
        out = own if out is None else _balanced(out + own, p)
    return np.zeros((len(left), len(right)), np.float32) if out is None else out


def remaindered(parts: list[np.ndarray], mods: list[int], bound: int) -> np.ndarray:
    """The signed numbers with these balanced residues, by balanced mixed radix digits: int64, or Python's integers where `bound` needs more."""
    wide = bound > PLAIN
    total = parts[0].astype(object if wide else np.int64)
    total = np.vectorize(int, otypes=[object])(parts[0]) if wide and parts[0].size else total
    digits, radix = [parts[0]], mods[0]
    for p, part in zip(mods[1:], parts[1:], strict=True):
        # What the digits so far make modulo p; every step stays far under 2 ** 24.
        sofar, weight = np.zeros_like(part), 1
        for d, m in zip(digits, mods, strict=False):
            sofar = _balanced(sofar + d * np.float32((weight + p // 2) % p - p // 2), p)
            weight = weight * m % p
        inverse = pow(radix, -1, p)
        digit = _balanced(_balanced(part - sofar, p) * np.float32((inverse + p // 2) % p - p // 2), p)
        digits.append(digit)
        total = total + (np.vectorize(int, otypes=[object])(digit) if wide and digit.size else digit.astype(np.int64)) * radix
        radix *= p
    return total


class Best:
    """The `k` best (highest score, then smallest id) of each of some queries."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k, self.query, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        self.floor, self.full = np.zeros(queries, kind), np.zeros(queries, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(query[order], kind="stable")]
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        last = np.arange(len(query)) - first == self.k - 1
        self.floor[query[last]], self.full[query[last]] = score[last], True


def _number(x: int) -> int:
    return max(-LONG - 1, min(LONG, int(x)))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The components as whole numbers in doubles; shorter vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width))
    row = np.repeat(np.arange(len(vectors)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def search(rows: DataFrame, anchors: dict[str, np.ndarray], mods: list[int], bound: int, width: int, k: int, same: bool) -> DataFrame:
    """(anchor int, slot int, id long, score) of each anchor's best rows: of its label or of others, and for each slot with scores in [low, high].

    A task's finds, not yet ranked over tasks. Rows come by id, so that of equal scores the first found stays.
    """
    wide = bound > PLAIN
    kind = object if wide else np.int64
    shared = rows.sparkSession.sparkContext.broadcast((anchors, mods))  # BLOCK_BYTES and a few windows for each anchor

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mods = shared.value
        n, slots = own["low"].shape
        best = Best(n * slots, k, kind)
        parts = [residues(own["vector"], p) for p in mods]
        size = 64  # the first rows fill the queries, later ones seldom pass
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at, size = at + part.num_rows, min(ROWS, size * 2)
                ids, labels, matrix = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("vector"), width)
                right = [residues(matrix, p) for p in mods]
                for first in range(0, n, ANCHORS):
                    some = slice(first, min(n, first + ANCHORS))
                    scores = remaindered([product(left[some], r, p) for left, r, p in zip(parts, right, mods, strict=True)], mods, bound)
                    fit = own["label"][some, None] == labels[None, :]
                    fit = fit & (own["vec_id"][some, None] != ids[None, :]) if same else ~fit
                    found = []
                    for slot in range(slots):
                        query = np.arange(first, some.stop) * slots + slot
                        least = np.where(best.full[query], best.floor[query] + 1, own["low"][some, slot])
                        a, r = np.nonzero(fit & (scores >= np.maximum(least, own["low"][some, slot])[:, None]) & (scores <= own["high"][some, slot][:, None]))
                        found.append((query[a], scores[a, r], ids[r]))
                    if any(len(f[0]) for f in found):
                        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        for at in range(0, len(best.query), 100_000):
            part = slice(at, at + 100_000)
            score = pa.array([str(x) for x in best.score[part]], pa.string()) if wide else pa.array(best.score[part].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((best.query[part] // slots).astype(np.int32)), pa.array((best.query[part] % slots).astype(np.int32)), pa.array(best.id[part]), score], ["anchor", "slot", "id", "score"])

    found = rows.mapInArrow(work, f"anchor int, slot int, id long, score {'string' if wide else 'long'}")
    return found.withColumn("score", F.col("score").cast("decimal(38,0)")) if wide else found


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector array<double>): rows with an id, a label and a vector of finite numbers only; components times SCALE, rounded down."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # floor as a double: a cast to long would end at 2 ** 63
    scaled = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), scaled.alias("vector"))


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, vector of whole numbers).

    Anchors are rows whose id is divisible by `every`. Positives are an anchor's best rows of its label under other
    ids; negatives the best of other labels with low * positive <= 100 * score <= high * positive. Vectors that are shorter
    than others count as ending in zeros. Anchors with no positive, and positives with no negative, give no rows; an empty
    table gives none. Of an id that several rows have, each row counts. Scores are
    compared exactly; those over 64 bits are returned as the nearest long, those of over 36 raise OverflowError.
    """
    spark = rows.sparkSession
    held = stash(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "vectors")
    facts = held.agg(F.max(F.size("vector")).alias("width"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.anchors:
        return spark.createDataFrame([], schema)
    width = facts.width
    bound = int(facts.most) ** 2 * max(1, width)
    if bound >= 10**36:
        raise OverflowError("scores of more than 36 digits")
    mods = primes(bound, width)
    wide = bound > PLAIN
    blocks = -(-facts.anchors * max(1, width) * 8 // BLOCK_BYTES)
    anchors = stash(held.where(F.col("vec_id") % every == 0).withColumn("block", row_id() % blocks), "anchors")
    ordered = held.sortWithinPartitions("vec_id")
    out = None
    for block in range(blocks):
        own = anchors.where(F.col("block") == block).select("vec_id", "label", "vector").toArrow().combine_chunks()  # BLOCK_BYTES or little more
        if not own.num_rows:
            continue
        own = own.to_batches()[0]
        kind = object if wide else np.int64
        given = {"vec_id": own.column("vec_id").to_numpy(), "label": own.column("label").to_numpy(), "vector": _matrix(own.column("vector"), width)}
        open_low = np.full((own.num_rows, 1), -bound - 1, kind)
        first = ranked(search(ordered, given | {"low": open_low, "high": -open_low}, mods, bound, width, positives, True), positives).select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        first = stash(first, "positives")
        lows, highs = np.full((own.num_rows, positives), 1, kind), np.zeros((own.num_rows, positives), kind)  # no score is between
        for r in first.toLocalIterator():  # `positives` rows for each anchor of the block
            score = int(r.positive_score)
            lows[r.anchor, r.slot - 1], highs[r.anchor, r.slot - 1] = -(-low * score // 100), high * score // 100
        found = ranked(search(ordered, given | {"low": lows, "high": highs}, mods, bound, width, negatives, False), negatives)
        names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(own.num_rows, dtype=np.int32)), "anchor_id": own.column("vec_id")}))
        found = found.withColumn("slot", F.col("slot") + 1).join(first, ["anchor", "slot"]).join(names, "anchor")
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), *(_long(c).alias(n) for c, n in (("positive_score", "positive_score"), ("score", "negative_score"))))
        out = found if out is None else out.unionByName(found)
    return out


def _long(column: str):
    """A score as a long; those that are too large become the nearest one."""
    return F.greatest(F.least(F.col(column), F.lit(LONG)), F.lit(-LONG - 1)).cast("long")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of the embeddings.

    Rows with a null id, a null label, a null vector or a component that is null or not finite take no part.
    """
    return hard_negatives(usable(table(spark, sf_dir, "embeddings")))


#: Vectors are lists of whole numbers here, as SQL's own inner product works in doubles, which are exact at these sizes.
OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""
