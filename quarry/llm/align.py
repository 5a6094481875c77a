"""Alignment of two tokenizers' tokens over the same bytes, and how often token pairs of the two end together.

Both tokenizers see a space and the text. Neither joins characters over a single space that stands between others, so the
parts between such spaces are independent, and a task aligns each distinct part once:

1. Every token is a run of bytes. It points to the farthest-right token that overlaps it: the last of the other
   tokenizer that begins before its end, if that one ends later or if its end is the end of a token of A. Where two end
   together, A's token points to itself.
2. All tokens take their successor's successor until none changes, which doubles the steps each time. What a token then
   points to is the last token of A in its component; components are the groups, and the tokens at their ends are linked.
3. The links go to a table. Tasks count their pairs, Spark adds the counts up and finds each B token's highest. The HOT
   most frequent pairs' counts are broadcast, those of all others reach their documents by a join.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import Lookup, frequent, plus, row_id, slices, stash, table, texts, tidy
from .pieces import MARK, ragged

#: Pairs whose counts are broadcast, at 17 bytes.
HOT = 1 << 20
#: A task forgets its parts beyond so many characters, and counts so many links at one time.
CACHE, COUNTED = 1 << 20, 1 << 20
ALIGNED = "n_a long, n_b long, link_a array<int>, link_b array<int>, groups string"
#: Spaces, and what follows them up to the next single space between others.
_PARTS = re.compile(r" +[^ ]*(?:(?: {2,}| (?!\S))[^ ]*)*")
#: Parts that stay apart when they stand side by side, and how many the tokenizers get at one time.
_PLAIN, _SIDE_BY_SIDE = re.compile(f" [^\\s{MARK}]+"), 256


def components(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that end at these places (ascending; both sequences tile the same bytes): the number of each token's last token of A."""
    n = len(end_a)
    start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
    last_b = np.searchsorted(start_b, end_a) - 1  # the last that begins before the token's end
    last_a = np.searchsorted(start_a, end_b) - 1
    target = np.concatenate([np.where(end_b[last_b] > end_a, n + last_b, np.arange(n)), last_a])
    while True:
        further = target[target]
        if (further == target).all():
            return target[:n], target[n:]
        target = further


class Aligner:
    """Two vocabularies, and the parts that a task has aligned already."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work; threads would hold memory of their own
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), pieces.vocabulary(path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are plain text
        if len(self.b.map.units) or self.b.trim or not self.b.prefix or not self.b.apart:
            raise ValueError("a vocabulary that changes its texts")
        shown = _byte_letters()
        vocabulary = sorted(self.a.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        tokens = [b""] * (vocabulary[-1][1] + 1)
        for name, number in vocabulary:
            tokens[number] = bytes(shown[c] for c in name)
        self.a_bytes, self.a_sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        self.a_starts = np.cumsum(self.a_sizes) - self.a_sizes
        names = [b"%d," % i for i in range(max(len(tokens), len(self.b.table)))]
        self.names, self.name_sizes = np.frombuffer(b"".join(names), np.uint8), np.array([len(n) for n in names])
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.link_a, self.link_b = array("i"), array("i")
        self.n_a, self.n_b, self.ends, self.held = array("i"), array("i"), array("q", [0]), 0

    def tokens(self, parts: list[str], plain: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and for B: the ids of parts, one part after the other, their bytes, and how many ids each part has. The first `plain` parts are encoded side by side."""
        runs = [parts[i : min(i + _SIDE_BY_SIDE, plain)] for i in range(0, plain, _SIDE_BY_SIDE)] + [[p] for p in parts[plain:]]
        joined = ["".join(r) for r in runs]
        for ids, widths in (
            ([e.ids for e in self.a.encode_batch_fast(joined, add_special_tokens=False)], self.a_sizes),
            (self.b.model.encode([j.replace(" ", MARK) for j in joined], num_threads=1), self.b.shown_sizes),
        ):
            flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
            wide = widths[flat]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            if plain:
                side = -(-plain // _SIDE_BY_SIDE)
                ends = np.cumsum(np.fromiter((len(p.encode("utf-8", "replace")) for p in parts[:plain]), np.int64, plain))
                reached = np.cumsum(wide[: counts[:side].sum()])
                at = np.searchsorted(reached, ends)
                if len(reached) < len(ends) or at[-1] >= len(reached) or (reached[at] != ends).any():
                    raise ValueError("tokens over the end of a part")
                counts = np.concatenate([np.diff(at + 1, prepend=0), counts[side:]])
            yield flat, wide, counts

    def align(self, parts: list[str]) -> None:
        """Put the parts' groups and links away. A part whose tokens don't spell it has no tokens at all (n_a is -1)."""
        plain = [p for p in parts if _PLAIN.fullmatch(p)]
        parts = plain + [p for p in parts if not _PLAIN.fullmatch(p)]
        (flat_a, wide_a, n_a), (flat_b, wide_b, n_b) = self.tokens(parts, len(plain))
        raw = [p.encode("utf-8", "replace") for p in parts]
        size = np.fromiter(map(len, raw), np.int64, len(parts))
        part_a, part_b = np.repeat(np.arange(len(parts)), n_a), np.repeat(np.arange(len(parts)), n_b)
        good = (np.bincount(part_a, wide_a, len(parts)) == size) & (np.bincount(part_b, wide_b, len(parts)) == size)
        if not good.all():
            flat_a, wide_a, part_a, flat_b, wide_b, part_b = *(x[good[part_a]] for x in (flat_a, wide_a, part_a)), *(x[good[part_b]] for x in (flat_b, wide_b, part_b))
        text = np.frombuffer(b"".join(r for r, ok in zip(raw, good.tolist(), strict=True) if ok), np.uint8)
        differ = (self.a_bytes[ragged(self.a_starts[flat_a], wide_a)] != text) | (self.b.shown[ragged(self.b.shown_starts[flat_b], wide_b)] != text)
        if differ.any():
            wrong = np.unique(np.repeat(part_a, wide_a)[differ])
            good[wrong] = False
            keep_a, keep_b = good[part_a], good[part_b]
            flat_a, wide_a, part_a, flat_b, wide_b, part_b = flat_a[keep_a], wide_a[keep_a], part_a[keep_a], flat_b[keep_b], wide_b[keep_b], part_b[keep_b]
        last_a, last_b = components(np.cumsum(wide_a), np.cumsum(wide_b)) if len(flat_a) else (flat_a, flat_b)
        at_a, at_b = (np.flatnonzero(np.append(x[1:] != x[:-1], True)) if len(x) else x for x in (last_a, last_b))  # the tokens at the groups' ends
        part = part_a[at_a]
        per_part = np.bincount(part, minlength=len(parts))
        self.link_a.frombytes(flat_a[at_a].astype(np.int32).tobytes())
        self.link_b.frombytes(flat_b[at_b].astype(np.int32).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(per_part)).astype(np.int64).tobytes())
        self.n_a.frombytes(np.where(good, n_a, -1).astype(np.int32).tobytes())
        self.n_b.frombytes(np.where(good, n_b, 0).astype(np.int32).tobytes())
        # Names in order of group, then A before B; each ends in what separates it from the next.
        group_a, group_b = (np.repeat(np.arange(len(at)), np.diff(at, prepend=-1)) for at in (at_a, at_b))
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        every = np.concatenate([flat_a, flat_b])[order]
        written = self.names[ragged(self.name_starts[every], self.name_sizes[every])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(self.name_sizes[every])
        written[place[at_a] - 1], written[place[len(flat_a) + at_b] - 1] = ord("|"), ord(";")
        stops = np.concatenate([[0], place[len(flat_a) + at_b]])[np.cumsum(per_part)].tolist() if len(at_b) else [0] * len(parts)
        spelled = written.tobytes()
        self.groups += [spelled[start : max(start, stop - 1)] for start, stop in zip([0, *stops[:-1]], stops, strict=True)]
        for p in parts:
            self.place[p] = len(self.place)
            self.held += len(p)

    def of(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, list[bytes]]:
        """Of some texts: tokens of A and of B, the linked ids of both, links, and the groups as `a1,a2|b1;a3|b2`."""
        if self.held > CACHE:
            self._forget()
        parts, bounds = [], [0]
        for t in data:
            if t:
                parts += _PARTS.findall(" " + t.decode("utf-8", "replace"))
            bounds.append(len(parts))
        missed = list(dict.fromkeys(p for p in parts if p not in self.place))
        if missed:
            self.align(missed)
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        ends, own_a, own_b = np.array(self.ends), np.array(self.n_a), np.array(self.n_b)
        text = np.repeat(np.arange(len(data)), np.diff(bounds))
        bad = np.bincount(text[own_a[at] < 0], minlength=len(data)) > 0 if len(at) else np.zeros(len(data), bool)
        if bad.any():
            keep = ~bad[text]
            at, text = at[keep], text[keep]
        sizes = np.diff(ends)[at] if len(at) else at
        where = ragged(ends[at], sizes)
        links = np.bincount(text, sizes, len(data)).astype(np.int64)
        n_a, n_b = (np.bincount(text, own[at] if len(at) else at, len(data)).astype(np.int64) for own in (own_a, own_b))
        flat = [np.array(x, np.int32)[where] for x in (self.link_a, self.link_b)]
        places = at.tolist()
        stops = np.cumsum(np.bincount(text, minlength=len(data))).tolist()
        groups = [b";".join([self.groups[i] for i in places[start:stop]]) for start, stop in zip([0, *stops[:-1]], stops, strict=True)]
        return n_a, n_b, flat, links, groups


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters for themselves, those from U+0100 for the others in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _rest() -> None:
    """Put the tokenizers of a worker that now counts away."""
    aligner.cache_clear()
    pieces.vocabulary.cache_clear()
    tidy()


def align(docs: DataFrame, path_a: str, path_b: str, column: str = "text") -> DataFrame:
    """`docs` with n_a and n_b (tokens), link_a and link_b (ids of the tokens that end together, in order) and groups.

    Null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens. Repeated rows stay; an
    empty table gives none. Columns of docs with the new names are replaced.
    """
    own = docs.drop("n_a", "n_b", "link_a", "link_b", "groups")
    names = [*own.columns, "n_a", "n_b", "link_a", "link_b", "groups"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(path_a, path_b)
        for part in slices(batches, column, 1 << 19):
            n_a, n_b, flat, links, groups = found.of(texts(part, column))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_a), pa.array(n_b), *(pieces._lists(x, links) for x in flat), pa.array(groups, pa.binary()).cast(pa.string())], names)
        found._forget()
        tidy()

    return own.mapInArrow(work, plus(own, ALIGNED))


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("link_a", "link_b"))
    return a << 32 | b


def link_counts(linked: DataFrame) -> DataFrame:
    """(pair long, n long, best boolean) of all links; pair is the id of A times 2 ** 32 plus that of B, best says that no other A id is linked with the B id more often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _rest()
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            held.append(_pairs(batch))
            if sum(map(len, held)) > COUNTED:
                yield counted()
        if held:
            yield counted()
        tidy()

    counts = linked.select("link_a", "link_b").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stash(counts, "link-counts")
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row per token of B
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(linked: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """`linked` without its links, with n_best and count_sum: links whose pair is a best one, and the sum of the pairs' counts."""
    marked = stash(counts.withColumn("hot", frequent(counts, hot, "n")), "links")
    top = marked.where("hot").select("pair", "n", "best").toArrow()  # `hot` rows at most
    rare = marked.where("not hot").select("pair", "n", "best")
    shared = linked.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    given = linked.drop("n_best", "count_sum", "__uid").withColumn("__uid", row_id())
    rest = [c for c in given.columns if c not in ("link_a", "link_b")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _rest()
        pairs, n, best = shared.value
        lookup = Lookup(pairs)
        for batch in batches:
            sizes = batch.column("link_a").value_lengths().to_numpy(zero_copy_only=False)
            own = _pairs(batch)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = lookup.places(own)
            hit = at >= 0
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[hit], n[at[hit]])
            cold = np.bincount(row[~hit], minlength=batch.num_rows)
            left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cold)).astype(np.int32)), pa.array(own[~hit]))
            made = [pa.array(np.bincount(row[hit][best[at[hit]]], minlength=batch.num_rows)), pa.array(sums), left]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "n_best", "count_sum", "__left"])

    found = given.mapInArrow(work, plus(given.select(*rest), "n_best long, count_sum long, __left array<long>"))
    if rare.isEmpty():
        return found.drop("__uid", "__left")
    found = stash(found, "scored")
    more = found.select("__uid", F.explode("__left").alias("pair")).groupBy("__uid", "pair").agg(F.count("*").alias("k")).join(rare, "pair")
    more = more.groupBy("__uid").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("__best"), F.sum(F.col("k") * F.col("n")).alias("__sum"))
    joined = found.drop("__left").join(more, "__uid", "left").withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0)))
    return joined.drop("__uid", "__best", "__sum")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document.

    A is byte_bpe_50k, B piece_bpe_32k. Null and empty texts, and those with U+2581, have no tokens: zeros and ''.
    """
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), pieces.default_path())
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    linked = stash(found.select("doc_id", "n_a", "n_b", F.size("link_a").cast("long").alias("n_groups"), "link_a", "link_b", digest.alias("groups_sha256")), "aligned")
    scored = score_links(linked, link_counts(linked))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
