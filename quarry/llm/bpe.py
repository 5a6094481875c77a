"""BPE encoding over a table of distinct words, and decoding by an id-to-piece table.

Texts are split at ASCII white space. The vocabulary's normaliser, pre-tokeniser and special tokens never
join characters across such white space, so a text's ids are its words' ids in order. Spark counts the distinct
words; the most frequent, at most HOT of them whatever the corpus, are encoded once for the whole cluster and
broadcast as flat arrays. A rarer word is encoded in the tasks that meet it. Either way ids return to their texts by
position.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ship

from .common import plus, slices, stash, table, texts, tidy

#: A bound on the words that are broadcast.
HOT = 1 << 20
#: Longer words are never broadcast.
LONG = 64
#: A task forgets its own words beyond so many.
CACHE = 150_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The vocabulary of a tokenizers file, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def separator(path: str) -> tuple[str, int] | None:
    """A special token that can stand between words: it is cut out of a text before anything else is done to it."""
    for number, token in sorted(tokenizer(path).get_added_tokens_decoder().items()):
        if token.special and not (token.normalized or token.single_word or token.lstrip or token.rstrip):
            return token.content, number
    return None


def encode_words(path: str, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word, int32. The words go through the vocabulary as one text, parted by a special token."""
    found = tokenizer(path)
    plain = [w.decode("utf-8", "replace") for w in words]
    mark, joined = separator(path), "\n".join(plain)
    special = [t.content for t in found.get_added_tokens_decoder().values()]
    if mark is None or any(t in joined for t in special):
        return [np.array(x.ids, np.int32) for x in found.encode_batch(plain, add_special_tokens=False)]
    ids = np.array(found.encode(mark[0].join(plain), add_special_tokens=False).ids, np.int32)
    cuts = np.flatnonzero(ids == mark[1])
    return [ids[a:b] for a, b in zip(np.append(0, cuts + 1), np.append(cuts, len(ids)), strict=True)] if words else []


def word_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(word binary, n long) over all texts; words of over LONG bytes are left out. Counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for part in slices(batches, column):
            for text in texts(part, column):
                found.update(text.split())
            if len(found) > CACHE:
                yield out()
                found.clear()
        yield out()

    counted = docs.select(column).mapInArrow(count, "word binary, n long")
    return counted.where(F.length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str, column: str = "text", hot: int = HOT) -> DataFrame:
    """(word, n, low, high, ids array<int>): the most frequent words of the corpus, each encoded once. At most `hot` rows.

    low and high are the word's 128-bit digest. Words of one count are all in or all out; words met once are out.
    """
    counts = stash(word_counts(docs, column), "words")
    least, rows = None, 0
    for n, words in sorted(counts.where("n > 1").groupBy("n").count().collect(), reverse=True):  # a row per distinct count
        rows += words
        if rows > hot:
            break
        least = n

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            marks = digests_of(words)
            ids = pa.array(encode_words(path, words), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)), ids], ["word", "n", "low", "high", "ids"])

    return counts.where(F.lit(False) if least is None else F.col("n") >= least).mapInArrow(encode, "word binary, n long, low long, high long, ids array<int>")


def digests_of(words: list[bytes]) -> np.ndarray:
    """(words, 2) uint64: 128-bit digests, low half first."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), ">u8").reshape(-1, 2)[:, ::-1].astype(np.uint64)


class Table:
    """Ids of words by digest, in four flat arrays."""

    def __init__(self, found: pa.Table):
        low = found.column("low").to_numpy().view(np.uint64)
        lists = found.column("ids").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        order = np.argsort(low)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)[order]
        self.low, self.high = low[order], found.column("high").to_numpy().view(np.uint64)[order]
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.ids = lists.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The packed ids of each word, or None."""
        if not len(self.low) or not words:
            return [None] * len(words)
        marks = digests_of(words)
        at = np.minimum(np.searchsorted(self.low, marks[:, 0]), len(self.low) - 1)
        hit = (self.low[at] == marks[:, 0]) & (self.high[at] == marks[:, 1])
        return [self.ids[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes() if h else None for i, h in zip(at.tolist(), hit.tolist(), strict=True)]


def encode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with its columns and `ids` array<int>. Null and empty texts have no ids. An `ids` column of docs is replaced.

    With `decoded`, a column of that name holds what decode() makes of the ids, in the same Python worker.

    Repeated rows stay; the order of rows does not matter; a text may have any length.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(Table(word_table(docs, path, column).select("low", "high", "ids").toArrow()))
    tidy()  # the driver's memory
    keep = docs.drop(ids, *([decoded] if decoded else []))
    schema = plus(keep, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, bytes] = {}
        hot = words.value
        piece = pa.array(pieces(path)) if decoded else None
        for part in slices(batches, column, 1 << 20):
            split = [t.split() for t in texts(part, column)]
            if len(own) > CACHE:
                own.clear()
            new = list({w for w in chain.from_iterable(split) if w not in own})
            found = hot.find(new)
            own.update(zip(new, found, strict=True))
            rare = [w for w, x in zip(new, found, strict=True) if x is None]
            for at in range(0, len(rare), 4000):
                some = rare[at : at + 4000]
                own.update(zip(some, (x.tobytes() for x in encode_words(path, some)), strict=True))
            packed = [b"".join([own[w] for w in ws]) for ws in split]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32)))
            columns = [*part.columns, flat] + ([joined_pieces(flat, piece)] if decoded else [])
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return keep.mapInArrow(work, schema)


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces by id: a fixed file's size."""
    found = tokenizer(path)
    return [found.id_to_token(i) or "" for i in range(found.get_vocab_size(with_added_tokens=True))]


def joined_pieces(col: pa.ListArray, piece: pa.Array) -> pa.Array:
    """The pieces of each list of ids, joined by a space; null is empty."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), piece.take(col.flatten()))
    return pc.binary_join(lists, " ").cast(pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with column `out`: the pieces of its ids, joined by a space, as this vocabulary's decode() gives them. Null ids: empty."""
    keep = encoded.drop(out)
    schema = plus(keep, f"`{out}` string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array(pieces(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([*part.columns, joined_pieces(part.column(ids), piece)], [*part.schema.names, out])

    return keep.mapInArrow(work, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs."""
    return encode(docs.select("doc_id", "text"), path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every document. Null and empty texts have no tokens; repeated rows stay."""
    return digests(table(spark, sf_dir, "documents"), default_path())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    ship(spark)
    return digests(docs, default_path())
