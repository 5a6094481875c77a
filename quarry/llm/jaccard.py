"""Jaccard join of word shingles by partitioning the universe, with one-deletion neighbourhoods; exact.

Texts of sizes a <= b that link differ in at most H = (a + b) // 9 shingles. The hash space is cut into m ranges, m
by size band, and a text's shingles fall into m segments. Texts that differ in H shingles agree in m - H segments at
least, so in one order of all segment contents the first H + 1 of either have one in common. The order is by cost: how
many different texts hold the content. A text plays two parts: in its own band, and in the next one, for larger partners.

1. Every part's segment digests are dealt out in packed blocks; those that one text alone holds cost nothing
   and are dropped. A part with H + 1 of them has no partner; any other keeps as many of its cheapest shared
   segments as it lacks.
2. In each kept segment two hubs, the least text and that which shares most of its segments, are compared with all
   that share it. Links make components, which mostly settles groups of near copies without comparing all their pairs.
3. Texts of different components that share a kept segment are compared; so none of their links is lost. Where more
   than HOT texts share the segment, these texts choose anew from segments and one-deletion neighbourhoods: a segment
   counts once if its content is looked up, and twice if also contents with one shingle more or less are; the cheapest
   choice that adds up to H + 1 is taken. Pairs are
   weighed by outlines first: bit maps of the shingles' digests, which show how much one text has and the other lacks.
4. All comparisons are of whole shingle sets; pairs whose sketches, bit maps of a few bits a shingle, show too many
   differences for a link are left out before.

Texts with equal sets are one class throughout. Shingles are compared by 64-bit digests, classes by 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import ship

from .common import mixed, slices, spread_join, stash, table, texts, tidy, word_codes

WORDS = 5
#: So many texts in a segment make it hot.
HOT = 64
#: 64-bit words of a text's outline.
OUTLINE = 64
#: Segment digests that one task holds.
TASK_ROWS = 500_000
#: Class keys that are broadcast, at 8 bytes; more are joined by a shuffle.
BROADCAST_KEYS = 4_000_000
#: Keys of sets to compare that are broadcast, so that other sets do not travel; more are joined by a shuffle.
NEEDED_KEYS = 1_000_000
#: Class keys a task remembers, not to deal copies twice.
CACHE = 400_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_32 = np.uint64(32)


def _bounds() -> np.ndarray:
    """The largest size of each band."""
    out = [4]
    while out[-1] < 1 << 31:
        out.append(out[-1] * 3 // 2)
    return np.array(out, np.int64)


UPPER = _bounds()
#: Segments of each band: a quarter more than texts of the band can differ in, and about one per shingle in the shortest.
SEGMENTS = np.maximum((2 * UPPER // 9 + 1) * 5 // 4 + 2, np.minimum(UPPER, 12))


def parts_of(sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the own and the next band: which texts have this part, the band, and H + 1."""
    most = 5 * sizes // 4
    band = np.searchsorted(UPPER, sizes)
    own = (sizes + np.minimum(most, UPPER[band])) // 9 + 1
    return [(sizes > 0, band, own), ((sizes > 0) & (most > UPPER[band]), band + 1, (sizes + most) // 9 + 1)]


class Sets:
    """Shingle sets of texts in a row: flat sorted digests, sizes and class keys (the lowest bit is free)."""

    def __init__(self, data: list[bytes]):
        codes, counts = word_codes(data)
        lengths = np.minimum(counts, WORDS)
        text = np.repeat(np.arange(len(data)), counts - lengths + (counts > 0))
        first = np.cumsum(counts - lengths + (counts > 0)) - (counts - lengths + (counts > 0))
        at = np.arange(len(text)) - first[text] + (np.cumsum(counts) - counts)[text]
        k = lengths[text]
        flat = k.astype(np.uint64)
        for j in range(WORDS):
            inside = slice(None) if j < k.min(initial=WORDS) else np.flatnonzero(k > j)
            flat[inside] = mixed(flat[inside] * _A + codes[at[inside] + j])
        ends = np.cumsum(np.bincount(text, minlength=len(data)))
        for start, end in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True):
            flat[start:end].sort()
        new = np.append(True, (flat[1:] != flat[:-1]) | (text[1:] != text[:-1]))[: len(flat)]
        self.flat = flat[new]
        self.sizes = np.bincount(text[new], minlength=len(data))
        ends = np.cumsum(self.sizes)
        self.arrays = [self.flat[a:b] for a, b in zip((ends - self.sizes).tolist(), ends.tolist(), strict=True)]
        self.keys = np.array([xxhash.xxh3_64_intdigest(a.tobytes()) for a in self.arrays], np.uint64) & ~np.uint64(1)


class Segments:
    """The segments with shingles of some texts' parts: text, number, digest sum and shingle count of each; m and H + 1 of each text's part."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, part: int):
        use, band, self.need = parts_of(sizes)[part]
        self.use, self.band, self.m = use, band, SEGMENTS[band]
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = use[text]
        text, own = text[inside], flat[inside]
        number = (((own >> _32) * self.m[text].astype(np.uint64)) >> _32).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (number[1:] != number[:-1])])) if len(own) else np.zeros(0, np.int64)
        self.shingles, self.starts = mixed(own), starts
        self.text, self.number = text[starts], number[starts]
        self.sums = np.add.reduceat(self.shingles, starts) if len(starts) else np.zeros(0, np.uint64)
        self.counts = np.diff(np.append(starts, len(own)))
        self.filled = np.bincount(self.text, minlength=len(sizes))

    def digests(self, which: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Digests of segments with these sums of shingles."""
        return mixed(sums * _B + (self.band[self.text[which]].astype(np.uint64) << _32) + self.number[which].astype(np.uint64) + np.uint64(1))

    def empty(self, text: int, most: int) -> np.ndarray:
        """Digests of the first so many empty segments of a text."""
        numbers = np.setdiff1d(np.arange(self.m[text]), self.number[self.text == text])[:most].astype(np.uint64)
        return mixed((np.uint64(self.band[text]) << _32) + numbers + np.uint64(1))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n int, key long, slack0 int, slack1 int) of each row; slack is how many of a part's segments can be left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=2 << 20):
            own = Sets(texts(part))
            slack = []
            for number in (0, 1):
                cut = Segments(own.flat, own.sizes, number)
                slack.append(pa.array(np.where(cut.use, np.maximum(cut.filled - cut.need, 0), 0).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.sizes.astype(np.int32)), pa.array(own.keys.view(np.int64)), *slack], ["doc_id", "n", "key", "slack0", "slack1"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n int, key long, slack0 int, slack1 int")


def shared_segments(docs: DataFrame, buckets: int) -> DataFrame:
    """(sig, part, freq): segment digests that at least two classes hold. part is the class key, its lowest bit the part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, limit=2 << 20):
            own = Sets(texts(batch))
            fresh = []
            for i, key in enumerate(own.keys.tolist()):  # copies within the task are dealt once
                fresh.append(key not in seen)
                seen.add(key)
            if len(seen) > CACHE:
                seen.clear()
            pick = np.flatnonzero(fresh)
            if not len(pick):
                continue
            flat, sizes, keys = np.concatenate([own.arrays[i] for i in pick]), own.sizes[pick], own.keys[pick]
            sigs, parts = [], []
            for part in (0, 1):
                cut = Segments(flat, sizes, part)
                every = np.arange(len(cut.text))
                sigs.append(cut.digests(every, cut.sums))
                parts.append(keys[cut.text] | np.uint64(part))
                for i in np.flatnonzero(cut.use & (cut.filled < cut.need)):
                    more = cut.empty(i, int(cut.need[i] - cut.filled[i]))
                    sigs.append(more)
                    parts.append(np.full(len(more), keys[i] | np.uint64(part)))
            sig, part = np.concatenate(sigs), np.concatenate(parts)
            bucket = ((sig >> _32) * np.uint64(buckets)) >> _32
            order = np.argsort(bucket, kind="stable")
            sig, part, bucket = sig[order], part[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(sig)) if len(sig) else [0]
            ends = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in ends], pa.int32()), pa.array([sig[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([part[a:b].tobytes() for a, b in ends], pa.binary())], ["bucket", "sigs", "parts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        blocks: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for bucket, s, p in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "parts")), strict=True):
                blocks.setdefault(bucket, []).append((s, p))
        for bucket in list(blocks):
            own = blocks.pop(bucket)
            sig = np.frombuffer(b"".join(s for s, _ in own), np.uint64)
            part = np.frombuffer(b"".join(p for _, p in own), np.uint64)
            del own
            order = np.argsort(sig)
            sig = sig[order]
            same = sig[1:] == sig[:-1]
            again = np.append(same, False) | np.append(False, same)
            sig, part = sig[again], part[order[again]]
            order = np.lexsort((part, sig))
            sig, part = sig[order], part[order]
            new = np.append(True, (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])) if len(sig) else np.zeros(0, bool)
            sig, part = sig[new], part[new]
            if not len(sig):
                continue
            first = np.append(True, sig[1:] != sig[:-1])
            group = np.cumsum(first) - 1
            other = first | np.append(True, (part[1:] >> np.uint64(1)) != (part[:-1] >> np.uint64(1)))
            freq = np.bincount(group, other).astype(np.int64)[group]  # different classes
            keep = np.flatnonzero(freq > 1)
            for at in range(0, len(keep), 100_000):
                some = keep[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(sig[some].view(np.int64)), pa.array(part[some].view(np.int64)), pa.array(freq[some])], ["sig", "part", "freq"])

    dealt = docs.select("text").mapInArrow(deal, "bucket int, sigs binary, parts binary")
    return dealt.repartition(buckets, "bucket").mapInArrow(meet, "sig long, part long, freq long")


def sets_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, digests binary): the shingle set of each class in keys (key long, distinct)."""
    few = keys.count() <= BROADCAST_KEYS
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()) if few else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, limit=2 << 20):
            own = Sets(texts(part))
            keys = own.keys.view(np.int64)
            if wanted.value is None:
                hit = own.sizes > 0
            else:
                at = np.minimum(np.searchsorted(wanted.value, keys), max(0, len(wanted.value) - 1))
                hit = wanted.value[at] == keys if len(wanted.value) else np.zeros(len(keys), bool)
            pick = [i for i in np.flatnonzero(hit).tolist() if not (keys[i] in seen or seen.add(keys[i]))]
            yield pa.RecordBatch.from_arrays([pa.array(keys[pick]), pa.array(own.sizes[pick].astype(np.int32)), pa.array([own.arrays[i].tobytes() for i in pick], pa.binary())], ["key", "n", "digests"])

    found = docs.select("text").mapInArrow(work, "key long, n int, digests binary")
    found = found if few else found.join(keys, "key", "left_semi")
    return found.dropDuplicates(["key"])


def sketches(sets: DataFrame) -> DataFrame:
    """(key, n, bits binary): bit maps of the sets' digests, four to eight bits a shingle and a power of two long (2 MB at most)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d in batch.column("digests").to_pylist():
                own = np.frombuffer(d, np.uint64)
                bits = np.zeros(min(1 << 24, max(64, 1 << (4 * len(own) - 1).bit_length())), np.uint8)
                bits[(mixed(own) >> np.uint64(40)) % np.uint64(len(bits))] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(out, pa.binary())], ["key", "n", "bits"])

    return sets.select("key", "n", "digests").mapInArrow(work, "key long, n int, bits binary")


def likely(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pairs (x, y) of class keys that their sketches (key, n, bits) leave room for a link; no link is lost."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb")), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                short = min(len(x), len(y))  # a longer map's parts laid upon each other are the shorter map
                x, y = (np.bitwise_or.reduce(v.reshape(-1, short), axis=0) for v in (x, y))
                # What one map has and the other has not, its text has of shingles that the other has not.
                common = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
                keep.append(9 * common >= 4 * (n + m))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], ["x", "y"])

    left = drawn.select(F.col("key").alias("x"), F.col("n").alias("na"), F.col("bits").alias("a"))
    right = drawn.select(F.col("key").alias("y"), F.col("n").alias("nb"), F.col("bits").alias("b"))
    return pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "a", "b", "na", "nb").mapInArrow(work, "x long, y long")


def among(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets whose key is in keys (key, distinct)."""
    few = keys.count() <= NEEDED_KEYS
    return sets.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pairs (x, y) of class keys whose sets have 100 * intersection >= 80 * union; sets travel for pairs that their sketches `drawn` leave."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= 80 * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], ["x", "y"])

    pairs = stash(likely(pairs, drawn), "likely")
    sets = among(sets, pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct())
    left = sets.select(F.col("key").alias("x"), F.col("digests").alias("a"))
    right = sets.select(F.col("key").alias("y"), F.col("digests").alias("b"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(work, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(key, comp): the least key that each key of links (x, y) reaches. Least labels of neighbours and of labels, until none changes."""
    both = stash(links.select("x", "y").union(links.select("y", "x")).distinct(), "links")
    labels = stash(both.groupBy(F.col("x").alias("key")).agg(F.least(F.col("key"), F.min("y")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("y"), "comp"), "y").groupBy(F.col("x").alias("key")).agg(F.min("comp").alias("near"))
        step = stash(labels.join(near, "key").select("key", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "near-labels")
        jump = step.select(F.col("key").alias("comp"), F.col("comp").alias("far"))
        after = stash(spread_join(step, jump, "comp").select("key", "old", F.coalesce("far", "comp").alias("comp")), "labels")
        if after.where("comp <> old").isEmpty():
            return after.select("key", "comp")
        labels = after.select("key", "comp")


def _fits(n: str, m: str) -> str:
    return f"5 * least({n}, {m}) >= 4 * greatest({n}, {m})"


def neighbourhood_pairs(sets: DataFrame) -> DataFrame:
    """Candidate pairs (x, y) of different components among sets (key, n, digests, comp), by segments and one-deletion neighbourhoods.

    Complete for the links among these sets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                some = batch.slice(at, 50)
                arrays = [np.frombuffer(d, np.uint64) for d in some.column("digests").to_pylist()]
                flat, sizes = np.concatenate(arrays), np.array([len(a) for a in arrays], np.int64)
                keys = some.column("key").to_numpy().view(np.uint64)
                for part in (0, 1):
                    cut = Segments(flat, sizes, part)
                    every = np.arange(len(cut.text))
                    inside = np.repeat(every, cut.counts)
                    out = [(cut.digests(every, cut.sums), cut.text, cut.number, True), (cut.digests(inside, cut.sums[inside] - cut.shingles), cut.text[inside], cut.number[inside], False)]
                    for i in np.flatnonzero(cut.use):
                        gone = np.setdiff1d(np.arange(cut.m[i]), cut.number[cut.text == i])
                        out.append((cut.empty(i, len(gone)), np.full(len(gone), i), gone, True))
                    for code, text, number, whole in out:
                        if len(code):
                            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array((keys[text] | np.uint64(part)).view(np.int64)), pa.array(number.astype(np.int32)), pa.array(np.full(len(code), whole)), pa.array(cut.need[text].astype(np.int32))], ["code", "part", "number", "whole", "need"])

    rows = stash(sets.select("key", "digests").mapInArrow(work, "code long, part long, number int, whole boolean, need int"), "neighbourhoods")
    held = rows.groupBy("code").agg(F.sum(F.col("whole").cast("long")).alias("n_whole"), F.sum((~F.col("whole")).cast("long")).alias("n_less"))
    priced = rows.join(held, "code").groupBy("part", "number", "need").agg(
        F.sum(F.when(F.col("whole"), F.col("n_whole") - 1).otherwise(0)).alias("once"),
        F.sum(F.when(F.col("whole"), F.col("n_less")).otherwise(F.col("n_whole"))).alias("more"),
    )
    steps = priced.select("part", "number", "need", F.explode(F.array(F.struct(F.col("once").alias("cost"), F.lit(1).alias("step")), F.struct(F.greatest("once", "more").alias("cost"), F.lit(2).alias("step")))).alias("s"))
    order = Window.partitionBy("part").orderBy("s.cost", "s.step", "number")
    chosen = steps.withColumn("rank", F.row_number().over(order)).where("rank <= need").groupBy("part", "number").agg(F.max("s.step").alias("times"))

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, sizes = np.zeros((batch.num_rows, 64 * OUTLINE), np.uint8), np.zeros(batch.num_rows, np.int64)
            for i, d in enumerate(batch.column("digests").to_pylist()):
                own = np.frombuffer(d, np.uint64)
                maps[i, (mixed(own) >> np.uint64(40)) % np.uint64(64 * OUTLINE)] = 1
                sizes[i] = len(own)
            words = pa.array(np.packbits(maps, axis=1).view(np.int64).ravel())
            outline = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, OUTLINE), pa.int32()), words)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes - maps.sum(axis=1, dtype=np.int64)), outline], ["key", "spare", "outline"])

    drawn = sets.select("key", "digests").mapInArrow(outlines, "key long, spare long, outline array<long>")
    sizes = sets.groupBy("comp").agg(F.count("*").alias("size"))
    known = stash(sets.select("key", "n", "comp").join(sizes, "comp").select("key", "n", F.struct("size", "comp").alias("place")).join(drawn, "key"), "known")
    keyed = rows.withColumn("key", F.col("part").bitwiseAND(-2)).join(known.select("key", "place"), "key")
    # Of two components the smaller one looks the larger one up, so texts near the middle of a group look nothing up there.
    top = keyed.groupBy("code").agg(F.max("place").alias("top"))
    probes = keyed.join(chosen, ["part", "number"]).where("whole or times = 2").join(top, "code").where("place < top")
    probes = stash(probes.select("code", "key", "whole", "times", "place"), "probes")
    index = keyed.join(probes.groupBy("code").agg(F.min("place").alias("low")), "code").where("place > low").select("code", "key", "whole")

    def sided(frame: DataFrame, side: int) -> DataFrame:
        return frame.drop("place").join(known, "key").select("code", *(F.col(c).alias(f"{c}{side}") for c in ("key", "whole", "n", "place", "spare", "outline")), *(["times"] if side == 1 else []))

    # What one text has of the outline and the other has not, it also has of shingles; links leave little room for it. One column
    # of words, not a column a word: Spark's driver plans and compiles this join anew whenever a part of it is done.
    shared = "aggregate(zip_with(outline1, outline2, (a, b) -> bit_count(a & b)), 0, (s, c) -> s + c)"
    room = f"9 * (least(spare1, spare2) + {shared}) >= 4 * (n1 + n2)"
    met = sided(probes, 1).join(sided(index, 2), "code").where(" and ".join(["place1 < place2", _fits("n1", "n2"), "((whole1 and whole2) or (times = 2 and whole1 <> whole2))", room]))
    return met.select(F.least("key1", "key2").alias("x"), F.greatest("key1", "key2").alias("y")).distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles long, component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. Null, empty and blank texts have no shingles and link with
    nothing. Texts of under five words are one shingle. Repeated rows are in one component. A null doc_id never names a
    component that has another. Texts may have any length; an empty table gives no rows.
    """
    members = stash(classes(docs), "classes")
    by_class = stash(members.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("slack0").alias("slack0"), F.first("slack1").alias("slack1")), "by-class")
    total = by_class.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * 0.6 / TASK_ROWS) + 1)
    shared = stash(shared_segments(docs, buckets), "shared")

    key = F.col("part").bitwiseAND(-2)
    named = shared.withColumn("key", key).join(by_class, "key").withColumn("slack", F.when(F.col("part") == F.col("key"), F.col("slack0")).otherwise(F.col("slack1")))
    whole = Window.partitionBy("key", "part")  # rows of a key are in one place since the join
    order = whole.orderBy("freq", "sig")
    kept = named.withColumn("have", F.count("*").over(whole)).where("have > slack").withColumn("rank", F.row_number().over(order)).where("rank <= have - slack")
    kept = stash(kept.select("sig", "key", "n", "freq", (F.col("have") / F.col("n")).alias("share")), "kept")
    candidates = stash(kept.select("key").distinct(), "candidates")
    sets = stash(sets_of(docs, candidates), "sets")
    drawn = stash(sketches(sets), "sketches")

    # The text that shares most of its segments lies in the middle of its group; a few edits part it from the others.
    central = F.max(F.struct("share", "key", "n")).getField
    hubs = kept.groupBy("sig").agg(F.struct(central("key").alias("key"), central("n").alias("n")).alias("middle"), F.min(F.struct("key", "n")).alias("least"))
    stars = kept.join(hubs, "sig").select("key", "n", F.explode(F.array("least", "middle")).alias("hub")).where("key <> hub.key and " + _fits("n", "hub.n"))
    stars = stash(stars.select(F.least("key", "hub.key").alias("x"), F.greatest("key", "hub.key").alias("y")).distinct(), "stars")
    links = stash(verified(stars, sets, drawn), "star-links")
    comps = components(links)

    placed = kept.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    several = placed.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("sig")
    open_ = stash(placed.join(several, "sig"), "open")
    cold = open_.where(f"freq <= {HOT}")
    a, b = (cold.select("sig", F.col("key").alias(x), F.col("n").alias("n" + x), F.col("comp").alias("c" + x)) for x in ("x", "y"))
    rest = a.join(b, "sig").where("x < y and cx <> cy and " + _fits("nx", "ny")).select("x", "y").distinct()
    needy = open_.where(f"freq > {HOT}").select("key").distinct()
    if not needy.isEmpty():
        own = among(sets, needy).join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        rest = rest.union(neighbourhood_pairs(stash(own, "needy"))).distinct()
    rest = rest.join(stars, ["x", "y"], "left_anti")
    more = stash(verified(rest, sets, drawn), "rest-links")
    if not more.isEmpty():
        comps = components(links.union(more))

    comp_of = spread_join(members, comps, "key").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "key")))
    comp_of = stash(comp_of.select("doc_id", "n", "comp"), "comp-of")
    smallest = comp_of.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = spread_join(comp_of, smallest, "comp")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document. Null, empty and blank texts have no shingles and are linked with nothing; repeated rows stay, linked with their copies. What `join` says of null ids holds."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are their component's smallest; of repeated ids one row. Rows without id or without words stay."""
    ship(spark)
    keep = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).join(keep, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


#: All pairs that share a shingle are counted, so this is for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END AS shingles FROM w),
x AS (SELECT DISTINCT doc_id, unnest(shingles) AS shingle FROM s),
n AS (SELECT s.doc_id, CAST(count(x.shingle) AS BIGINT) AS n FROM s LEFT JOIN x ON x.doc_id = s.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""
