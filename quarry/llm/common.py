"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import ship

#: Text that a task turns into Python or numpy objects at one time.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that `column` has at most `limit` bytes in each, or is one row."""
    tidy()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    tidy()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def lowered(text: bytes) -> bytes:
    """A-Z to a-z and nothing else, which is what bytes.lower() does."""
    return text.lower()


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_32, _29 = np.uint64(32), np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values well mixed, one to one."""
    x = (x ^ (x >> _32)) * _A
    x = (x ^ (x >> _29)) * _B
    return x ^ (x >> _32)


#: Bytes hashed at one time, and the longest word that is hashed in array operations.
_BLOCK, _SHORT = 1 << 20, 64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: What a byte stands for in a digest, with A-Z as a-z, and as it is.
LOWERED, CASED = (mixed(np.frombuffer(x, np.uint8).astype(np.uint64) + np.uint64(1)) for x in (bytes(range(256)).lower(), bytes(range(256))))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and their inverses."""
    up, down = (np.full(_BLOCK + _SHORT, x, np.uint64) for x in (int(_A), pow(int(_A), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_spans(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one run of bytes with a blank after each, where their words [^\\x20\\x09-\\x0D]+ start and end, and how many each has."""
    raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    edges = np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in data])), prepend=0) if len(data) else np.zeros(0, np.int64)
    return raw, starts, ends, counts


def span_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit digests of spans in order. A digest is a sum over the span's bytes; spans of over 64 bytes are hashed one by one."""
    codes = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    up, down = _powers()
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        if stop > at + 1 or sizes[at] <= _SHORT:
            piece = raw[base : ends[stop - 1]]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values[piece] * up[: len(piece)], out=sums[1:])
            first = starts[at:stop] - base
            codes[at:stop] = mixed((sums[ends[at:stop] - base] - sums[first]) * down[first] + sizes[at:stop].astype(np.uint64))
        at = stop
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        word = raw[starts[i] : ends[i]].tobytes()
        codes[i] = xxhash.xxh3_64_intdigest(word.lower() if values is LOWERED else word)
    return codes


def word_codes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all words of some texts in lower case (A-Z), and how many each text has."""
    raw, starts, ends, counts = word_spans(data)
    return span_codes(raw, starts, ends, LOWERED), counts


class Lookup:
    """Places of 64-bit keys (distinct) by their leading bits."""

    def __init__(self, keys: np.ndarray):
        spread = mixed(keys.view(np.uint64))
        self.order = np.argsort(spread)
        self.keys = np.append(spread[self.order], np.uint64(0))
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or -1."""
        spread = mixed(keys.view(np.uint64))
        lead = (spread >> self.shift).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        out = np.full(len(keys), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            there = self.keys[at[live]] == spread[live]
            out[live[there]] = self.order[at[live[there]]]
            live = live[~there]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def frequent(counts: DataFrame, most: int, column: str = "n_all") -> Column:
    """Whether a row of counts is among the most frequent ones, `most` of them at most: those above a step of 1/16 of a doubling."""
    step = F.floor(F.log2(column) * 16)
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect():  # 1024 at most
        total += r.n
        if total > most:
            break
        least = r.step
    return F.lit(False) if least is None else step >= least


class WordFacts:
    """What `work` finds of words (arrays, one value a word), kept by digest in a table of 2 ** bits places; newcomers replace."""

    def __init__(self, work: Callable[[list[bytes]], list[np.ndarray]], bits: int = 16):
        self.work, self.shift = work, np.uint64(64 - bits)
        self.codes = np.zeros(1 << bits, np.uint64)
        self.kept = [np.zeros(1 << bits, a.dtype) for a in work([])]

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        codes = span_codes(raw, starts, ends, CASED)
        place = codes >> self.shift
        missed = np.flatnonzero(self.codes[place] != codes)
        out = [a[place] for a in self.kept]
        if len(missed):
            fresh, first, number = np.unique(codes[missed], return_index=True, return_inverse=True)
            found = self.work([raw[starts[i] : ends[i]].tobytes() for i in missed[first]])
            self.codes[fresh >> self.shift] = fresh
            for values, kept, new in zip(out, self.kept, found, strict=True):
                values[missed] = new[number]
                kept[fresh >> self.shift] = new
        return out


def row_id() -> Column:
    """A key for each row, also where ids repeat or are null."""
    return F.monotonically_increasing_id()


#: A key with a share of 1/HOT_KEYS of all rows is hot; so there are HOT_KEYS hot ones at most, few enough to broadcast.
HOT_KEYS = 1024


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of `left` (read three times) with `right`, whose `key` is unique; rows of hot keys stay where they are."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    hot = F.broadcast(counts.where(F.col("n") * HOT_KEYS >= total).where("n > 1").select(key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, "left").unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def plus(df: DataFrame, ddl: str) -> StructType:
    """The schema of `df` with the columns of `ddl` at its end."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)
