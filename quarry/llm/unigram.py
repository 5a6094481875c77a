"""Token counts of texts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a word between ASCII white space with the word mark in front. Its best segmentation is the one
with the greatest sum of piece scores; a character that no piece covers costs its UTF-8 bytes, at a score below
every piece's. Of equal scores the segmentation with fewer tokens counts. The best score of a prefix depends on the
prefix alone.

1. Spark counts the distinct pre-tokens of all texts and deals them out by ranges, in order.
2. Each range is put in a trie and each node is computed once, however many words run through it; the end of each word
   keeps its token count and its score. So each distinct word is segmented once for the whole corpus.
3. The HOT most frequent words' ends are broadcast, by 64-bit digests of the words; those of all others reach their texts
   by a join on the digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CASED, Lookup, frequent, row_id, slices, span_codes, stash, table, texts, word_spans

MARK = "▁"
#: Words whose ends are broadcast, at 24 bytes.
HOT = 1 << 20
#: Words that a task counts at one time.
COUNTED = 2 << 20


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], int, float]:
    """Scores by piece, the longest piece's length, and the score of a byte that stands for itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    ordinary = min(s for s in scores.values() if s > -1e8)  # a few pieces are kept from use by a huge score
    return scores, max(map(len, scores)), ordinary - 10.0


class Trie:
    """The trie of a sorted run of words, of which only the path to the last word is held."""

    def __init__(self, scores: dict[str, float], longest: int, byte_score: float):
        self.scores, self.longest, self.byte_score = scores, longest, byte_score
        self.path, self.best = "", [(0.0, 0)]
        self.nodes = 0

    def count(self, word: str) -> tuple[int, float]:
        """Token count and score at the word's end. Words must come in sorted order to share the most prefixes."""
        shared, most = 0, min(len(word), len(self.path))
        while shared < most and word[shared] == self.path[shared]:
            shared += 1
        best, get, longest = self.best, self.scores.get, self.longest
        del best[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "replace"))
            score, tokens = best[end - 1]
            top = (score + size * self.byte_score, -(tokens + size))
            for start in range(max(0, end - longest), end):
                own = get(word[start:end])
                if own is not None:
                    score, tokens = best[start]
                    found = (score + own, -(tokens + 1))
                    if found > top:
                        top = found
            best.append((top[0], -top[1]))
        self.nodes += len(word) - shared
        self.path = word
        return best[-1][1], best[-1][0]


def distinct_words(docs: DataFrame, column: str = "text") -> DataFrame:
    """(key long, word binary, n_all long) of the words between ASCII white space; key is a word's digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def counted() -> Iterator[pa.RecordBatch]:
            keys, first, n = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_counts=True)
            begins = np.cumsum([0, *(len(h[0]) for h in held)])
            part = np.searchsorted(begins, first, "right") - 1
            for number, (_, raw, starts, ends) in enumerate(held):
                own = np.flatnonzero(part == number)
                at = first[own] - begins[number]
                sizes = ends[at] - starts[at]
                place = np.cumsum(sizes)
                flat = raw[np.repeat(starts[at] - (place - sizes), sizes) + np.arange(sizes.sum())]
                words = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.append(0, place).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                made = pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), words, pa.array(n[own].astype(np.int64))], ["key", "word", "n_all"])
                yield from (made.slice(i, 100_000) for i in range(0, len(own), 100_000))
            held.clear()

        for part in slices(batches, column, 2 << 20):
            raw, starts, ends, _ = word_spans(texts(part, column))
            held.append((span_codes(raw, starts, ends, CASED), raw, starts, ends))
            if sum(len(h[0]) for h in held) > COUNTED:
                yield from counted()
        if held:
            yield from counted()

    return docs.select(column).mapInArrow(work, "key long, word binary, n_all long").groupBy("key", "word").agg(F.sum("n_all").alias("n_all"))


def word_ends(words: DataFrame, path: str) -> DataFrame:
    """(key, n_all, tokens int, score double) of words (key, word, n_all), by a trie for each range of words in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*vocabulary(path))
        for batch in batches:
            found = [trie.count(MARK + w.decode("utf-8", "replace")) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_all"), pa.array([t for t, _ in found], pa.int32()), pa.array([x for _, x in found], pa.float64())], ["key", "n_all", "tokens", "score"])

    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(work, "key long, n_all long, tokens int, score double")


def count_tokens(docs: DataFrame, path: str, column: str = "text", hot: int = HOT) -> DataFrame:
    """The columns of `docs` but `column`, with n_pretokens long, n_tokens long and token_score double.

    Null and empty texts have 0, 0 and 0.0. Repeated rows stay; an empty table gives none. Columns of docs with the new
    names are replaced. Texts and words may have any length.
    """
    own = docs.drop("n_pretokens", "n_tokens", "token_score")
    rest = [c for c in own.columns if c != column]
    ends = stash(word_ends(distinct_words(own, column), path), "word-ends")
    ends = ends.withColumn("hot", frequent(ends, hot))
    top = ends.where("hot").select("key", "tokens", "score").toArrow()  # `hot` rows at most
    shared = own.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("key", "tokens", "score")))
    given = own.select(F.struct(*rest).alias("__rest") if rest else F.lit(None).cast("struct<a:int>").alias("__rest"), F.col(column).alias("__text")).withColumn("__uid", row_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tokens, scores = shared.value
        lookup = Lookup(keys)
        for part in slices(batches, "__text", 1 << 20):
            data = texts(part, "__text")
            raw, starts, stops, counts = word_spans(data)
            codes = span_codes(raw, starts, stops, CASED).view(np.int64)
            text = np.repeat(np.arange(len(data)), counts)
            at = lookup.places(codes)
            hit = at >= 0
            uid, cold = part.column("__uid").to_numpy(), text[~hit]
            none = np.zeros(len(cold), np.int64)
            kept = part.column("__rest")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([kept, pa.nulls(len(cold), kept.type)]),
                    pa.array(np.concatenate([uid, uid[cold]])),
                    pa.array(np.concatenate([np.ones(len(data), bool), np.zeros(len(cold), bool)])),
                    pa.array(np.concatenate([uid, codes[~hit]])),
                    pa.array(np.concatenate([counts, none])),
                    pa.array(np.concatenate([np.bincount(text[hit], tokens[at[hit]], len(data)).astype(np.int64), none])),
                    pa.array(np.concatenate([np.bincount(text[hit], scores[at[hit]], len(data)), none.astype(np.float64)])),
                ],
                ["__rest", "uid", "whole", "key", "n_pretokens", "n_tokens", "token_score"],
            )

    kind = given.schema["__rest"].dataType.simpleString()
    parts = given.mapInArrow(work, f"__rest {kind}, uid long, whole boolean, key long, n_pretokens long, n_tokens long, token_score double")
    cold = ends.where("not hot").select("key", "tokens", "score", F.lit(False).alias("whole"))
    joined = parts.join(cold, ["key", "whole"], "left")
    summed = joined.groupBy("uid").agg(
        F.first("__rest", ignorenulls=True).alias("__rest"),
        F.sum("n_pretokens").alias("n_pretokens"),
        F.sum(F.col("n_tokens") + F.coalesce("tokens", F.lit(0))).alias("n_tokens"),
        F.sum(F.col("token_score") + F.coalesce("score", F.lit(0.0))).alias("token_score"),
    )
    return summed.select(*(F.col("__rest")[c].alias(c) for c in rest), "n_pretokens", "n_tokens", "token_score")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, token_score for every document."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
