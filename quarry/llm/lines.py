"""Removal of passages that repeat, to the word.

A text's units are its lines of MIN_LINE to MIN_RUN - 1 words and all its windows of MIN_RUN words, also over line ends;
so a repeated line or paragraph goes whole, and so does a passage that stands within other lines.
Words are normalised (lower case, only letters and digits) before hashing. A unit that occurs earlier goes, so of a
repeated passage every word goes, wherever it stands. The earliest ranked occurrence (by doc_id, then by place) stays;
copies that overlap within one text are one occurrence. What is left keeps its order, and its offsets in the original.

Windows travel in rows of up to 17: of the runs of GRAM words in a window the one with the least digest, the leftmost of
equal ones, is its mark. Equal windows have equal marks, so the windows of one occurrence of a mark are one row, dealt by
the mark, with 40 bits of each window's digest beside the mark's 64. Marks that a sample of the texts shows to be
frequent have their windows dealt one by one, by the window's own digest; the sample decides on the way, never on the
result. What a slice of texts repeats within itself is settled there. Each place has its rows in rank order, so a unit's
first row is its earliest occurrence, and a task holds no more than the windows of one mark that it has seen.

Texts are known by doc_id and, where ids repeat or are null, by a 128-bit digest, so nothing depends on the order of rows. Words are parted by ASCII white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import ship

from .common import LOWERED, WordFacts, mixed, plus, slices, span_codes, table, texts, tidy, word_spans

GRAM, MIN_RUN, MIN_LINE = 9, 25, 8
#: Bytes of a window's digest that travel beside its mark.
SHORT = 5
#: One text in SAMPLE shows which marks are frequent: those with a share of 1/FREQUENT, FREQUENT at most, met SEEN times.
SAMPLE, FREQUENT, SEEN = 64, 1 << 20, 4
#: The rank of a text without id.
LAST = (1 << 63) - 1

_DROP = re.compile(r"[\W_]+")
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def normalised(word: str) -> str:
    """Letters and digits in lower case; the word itself where it has none."""
    return _DROP.sub("", word).lower() or word


def _of_words(words: list[bytes]) -> list[np.ndarray]:
    own = [normalised(w.decode("utf-8", "replace")).encode("utf-8", "replace") for w in words]
    sizes = np.array([len(w) for w in own], np.int64)
    ends = np.cumsum(sizes)
    return [span_codes(np.frombuffer(b"".join(own), np.uint8), ends - sizes, ends, LOWERED)]


class Words:
    """The words of texts, one text after the other, and the digests of runs of them."""

    def __init__(self, data: list[bytes], facts: WordFacts):
        self.raw, self.starts, self.ends, counts = word_spans(data)
        n = len(self.starts)
        kept, high = (np.concatenate([[0], np.cumsum(x)]) for x in (_ALNUM[self.raw], self.raw > 127))
        first, end = kept[self.starts], kept[self.ends]
        plain = (end > first) & (high[self.starts] == high[self.ends])  # of ASCII letters and digits, and marks
        values = np.zeros(n, np.uint64)
        values[plain] = span_codes(self.raw[_ALNUM[self.raw]], first[plain], end[plain], LOWERED)
        values[~plain] = facts.of(self.raw, self.starts[~plain], self.ends[~plain])[0]
        powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (_P, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n])])
        self.begins = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)  # of each text, and the end
        self.text = np.repeat(np.arange(len(data)), counts)
        # Lines: where each begins, in bytes and in words.
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in data])]).astype(np.int64)
        breaks = np.sort(np.concatenate([self.offsets[:-1], np.flatnonzero(self.raw == 10) + 1]))
        line_begins = np.append(np.searchsorted(self.starts, breaks), n)
        sizes = np.diff(line_begins)
        lines = np.flatnonzero((sizes >= MIN_LINE) & (sizes < MIN_RUN))
        self.line_starts, self.line_sizes = line_begins[lines], sizes[lines]
        self.line_text = np.searchsorted(self.offsets, breaks[lines], "right") - 1

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Digests of the words from starts to ends."""
        out = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return (out ^ (out >> np.uint64(31))) * _P ^ (ends - starts).astype(np.uint64)

    def windows(self) -> np.ndarray:
        """Where windows begin: MIN_RUN words of one text."""
        n = len(self.text) - MIN_RUN + 1
        return np.flatnonzero(self.text[: max(0, n)] == self.text[MIN_RUN - 1 :])

    def marks(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the mark of each window begins, and its digest."""
        n = len(self.text) - MIN_RUN + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(len(self.text) - GRAM + 1)
        grams = self.runs(at, at + GRAM)
        best, place = grams[:n].copy(), at[:n].copy()
        for j in range(1, MIN_RUN - GRAM + 1):
            less = grams[j : j + n] < best
            np.copyto(best, grams[j : j + n], where=less)
            np.copyto(place, at[j : j + n], where=less)
        return place[windows], best[windows]


def later(digests: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which units occur earlier, in a text of less rank or before in their own.

    Copies in one text of which each overlaps the next are one occurrence: a phrase said over and over is no passage that repeats.
    """
    order = np.lexsort((firsts, rank, digests))
    d, f, t, k = digests[order], firsts[order], rank[order], sizes[order]
    new = np.append(True, d[1:] != d[:-1])[: len(d)]
    apart = new | np.append(True, (t[1:] != t[:-1]) | (f[1:] - f[:-1] >= k[1:]))[: len(d)]
    number = np.cumsum(apart)
    out = np.zeros(len(d), bool)
    out[order] = number > number[new][np.cumsum(new) - 1]
    return out


class Rows:
    """The rows of some texts: the place they are dealt to, text, first window's or line's word, digests, and which are settled.

    Rows hold windows of one mark side by side, at most 17, or one window of a frequent mark, or a line.
    """

    def __init__(self, words: Words, rank: np.ndarray, frequent: np.ndarray):
        windows = words.windows()
        place, mark = words.marks(windows)
        digests = words.runs(windows, windows + MIN_RUN)
        heads = np.append(True, place[1:] != place[:-1])[: len(place)]
        # Only windows whose mark is met again in these texts can repeat here.
        own, number, times = np.unique(mark[heads], return_inverse=True, return_counts=True)
        again = np.flatnonzero((times[number] > 1)[np.cumsum(heads) - 1])
        text = words.text[windows]
        done = np.zeros(len(windows), bool)
        done[again] = later(digests[again], windows[again], np.full(len(again), MIN_RUN), rank[text[again]])
        slot = np.minimum(np.searchsorted(frequent, own), max(0, len(frequent) - 1))
        single = (frequent[slot] == own)[number][np.cumsum(heads) - 1] if len(frequent) else np.zeros(len(mark), bool)
        starts = np.flatnonzero(heads | single)
        line_digests = words.runs(words.line_starts, words.line_starts + words.line_sizes)
        line_done = later(line_digests, words.line_starts, words.line_sizes, rank[words.line_text])
        ends = np.append(starts[1:], len(windows))[: len(starts)]
        self.at = np.concatenate([np.where(single[starts], digests[starts], mark[starts]), line_digests])
        self.text = np.concatenate([text[starts], words.line_text])
        self.place = np.concatenate([windows[starts], words.line_starts]) - words.begins[self.text]
        self.size = np.concatenate([np.full(len(starts), MIN_RUN), words.line_sizes])
        self.counts = np.concatenate([ends - starts, np.ones(len(line_digests), np.int64)])
        bits = np.left_shift(1, np.arange(len(windows)) - np.repeat(starts, ends - starts)) * done
        self.done = np.concatenate([np.add.reduceat(bits, starts) if len(starts) else np.zeros(0, np.int64), line_done.astype(np.int64)])
        settled = self.done == (1 << self.counts) - 1
        self.at[settled] = mixed(self.at[settled] + self.text[settled].astype(np.uint64) * _P + self.place[settled].astype(np.uint64))  # anywhere: nothing to compare
        keep = np.repeat(~settled, self.counts)
        self.counts = np.where(settled, 0, self.counts)
        short = np.concatenate([digests, line_digests])[keep].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]
        ends = np.concatenate([[0], np.cumsum(SHORT * self.counts)]).astype(np.int32)
        self.digests = pa.Array.from_buffers(pa.binary(), len(self.at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(short.tobytes())])


_ROW = "at long, doc long, hash long, more long, place int, size int, done int, digests binary"


def rows_of(docs: DataFrame, frequent, column: str = "text") -> DataFrame:
    """The rows of docs (__doc, __hash, text); frequent is a broadcast sorted array of marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = WordFacts(_of_words)
        for part in slices(batches, column, 1 << 20):
            keys = [part.column(c).to_numpy() for c in ("__doc", "__hash", "__more")]
            ids, rank = np.unique(np.stack(keys, axis=1), axis=0, return_inverse=True)
            _, first = np.unique(rank, return_index=True)  # a row that repeats is looked at once
            rank = rank.reshape(-1)[first]
            data = texts(part.take(pa.array(first)), column)
            rows = Rows(Words(data, facts), rank, frequent.value)
            owner = first[rows.text]
            columns = [pa.array(rows.at.view(np.int64)), *(pa.array(k[owner]) for k in keys), *(pa.array(x.astype(np.int32)) for x in (rows.place, rows.size, rows.done)), rows.digests]
            yield pa.RecordBatch.from_arrays(columns, ["at", "doc", "hash", "more", "place", "size", "done", "digests"])

    return docs.select("__doc", "__hash", "__more", column).mapInArrow(work, _ROW)


def frequent_marks(docs: DataFrame, column: str = "text"):
    """Broadcast sorted marks that are frequent in a sample of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = WordFacts(_of_words)
        for part in slices(batches, column, 1 << 20):
            words = Words(texts(part, column), facts)
            place, mark = words.marks(words.windows())
            yield pa.RecordBatch.from_arrays([pa.array(mark[np.append(True, place[1:] != place[:-1])[: len(place)]].view(np.int64))], ["mark"])

    found = docs.where(F.pmod(F.xxhash64("__doc", column), F.lit(SAMPLE)) == 0).select(column).mapInArrow(work, "mark long").groupBy("mark").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    marks = found.where(f"n >= {SEEN} and n * {FREQUENT} >= {total}").select("mark").toArrow().column("mark").to_numpy().view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(np.sort(marks))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, hash, more, place, size, done) of rows in the order of at, doc, hash and more; done has a bit for each unit that goes."""
    tidy()
    last, seen, owner = None, np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)  # the first owner of each digest of the place at hand
    for batch in batches:
        if not batch.num_rows:
            continue
        at, doc, key, more, done = (batch.column(c).to_numpy() for c in ("at", "doc", "hash", "more", "done"))
        who = np.stack([doc, key, more], axis=1)
        digests = batch.column("digests")
        counts = np.asarray(pc.binary_length(digests)) // SHORT
        short = np.zeros((int(counts.sum()), 8), np.uint8)
        joined = b"".join(digests.to_pylist())
        short[:, :SHORT] = np.frombuffer(joined, np.uint8).reshape(-1, SHORT)
        unit = short.view("<u8").reshape(-1)
        row = np.repeat(np.arange(len(at)), counts)
        group = np.cumsum(np.append(at[0] != last, at[1:] != at[:-1]))
        order = np.lexsort((np.arange(len(unit)), unit, group[row]))
        u, r = unit[order], row[order]
        head = np.append(True, (u[1:] != u[:-1]) | (group[r][1:] != group[r][:-1]))[: len(u)]
        first = r[head][np.cumsum(head) - 1]
        gone = (who[r] != who[first]).any(axis=1)
        if len(seen):  # the place goes on from the batch before
            on = np.flatnonzero(group[r] == 0)
            slot = np.minimum(np.searchsorted(seen, u[on]), len(seen) - 1)
            hit = seen[slot] == u[on]
            gone[on] = np.where(hit, (who[r[on]] != owner[slot]).any(axis=1), gone[on])
        bits = np.zeros(len(unit), np.int64)
        bits[order] = gone
        within = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
        marks = done.astype(np.int64)
        np.bitwise_or.at(marks, row, bits << within)
        tail = np.flatnonzero(head & (group[r] == group[-1]))
        fresh, fresh_owner = u[tail], who[r[tail]]
        if group[-1] == 0 and len(seen):
            new = ~np.isin(fresh, seen)
            fresh, fresh_owner = np.concatenate([seen, fresh[new]]), np.concatenate([owner, fresh_owner[new]])
            by = np.argsort(fresh)
            fresh, fresh_owner = fresh[by], fresh_owner[by]
        last, seen, owner = at[-1], fresh, fresh_owner
        out = pa.array(np.flatnonzero(marks))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(out) for c in ("doc", "hash", "more", "place", "size")), pa.array(marks.astype(np.int32)).take(out)], ["doc", "hash", "more", "place", "size", "done"])


def spans_of(words: Words, text: int, firsts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """The byte spans, in the text, of the words that these units cover."""
    begin, end = words.begins[text], words.begins[text + 1]
    steps = np.zeros(end - begin + 1, np.int64)
    np.add.at(steps, firsts, 1)
    np.add.at(steps, firsts + sizes, -1)
    edges = np.diff(np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8))
    starts = words.starts[begin + np.flatnonzero(edges == 1)] - words.offsets[text]
    ends = words.ends[begin + np.flatnonzero(edges == -1) - 1] - words.offsets[text]
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans, and the original offsets of what is left. A line that is emptied goes with its break."""
    kept, at = [], 0
    for start, end in spans:
        if (start == 0 or text[start - 1 : start] == b"\n") and text[end : end + 1] == b"\n":
            end += 1
        if start > at:
            kept.append((at, start))
        at = max(at, end)
    if at < len(text):
        kept.append((at, len(text)))
    return b"".join(text[a:b] for a, b in kept), kept


def cleaned(data: list[bytes], places: list[list[dict] | None], again: list[bool], facts: WordFacts) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """The texts without the units at these places, or, where the whole row is met again, without all units; offsets in characters."""
    some = [i for i, (p, a) in enumerate(zip(places, again, strict=True)) if p or a]
    words = Words([data[i] for i in some], facts)
    windows = words.windows()
    texts_of, firsts, sizes = (np.concatenate(x) for x in ((words.text[windows], words.line_text), (windows, words.line_starts), (np.full(len(windows), MIN_RUN), words.line_sizes)))
    firsts = firsts - words.begins[texts_of]
    out = [(t, [(0, len(t.decode("utf-8", "replace")))] if t else []) for t in data]
    for n, i in enumerate(some):
        if again[i]:
            own = texts_of == n
            spans = spans_of(words, n, firsts[own], sizes[own])
        else:
            units = [(p["place"] + j, p["size"]) for p in places[i] for j in range(p["done"].bit_length()) if p["done"] >> j & 1]
            spans = spans_of(words, n, *(np.array(x, np.int64) for x in zip(*units, strict=True)))
        left, kept = without(data[i], spans)
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(data[i], np.uint8) & 0xC0) != 0x80)])
        out[i] = left, [(int(chars[a]), int(chars[b])) for a, b in kept]
    return out


def dedup(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with `column` cleaned, n_removed long (characters) and kept array<struct<start:int,end:int>> (original offsets).

    Every row stays, also one whose text is emptied; a null text stays null, with nothing kept. Rows are ranked by
    doc_id, nulls last, and rows of one doc_id by a digest of the text; of rows with one doc_id and one text one keeps it.
    Texts may have any length. Columns of docs named n_removed or kept are replaced.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.coalesce(column, F.lit(""))
    # Where every id is there and stands once it is a row's key by itself.
    once = docs.groupBy(doc.alias("doc")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    digest = [F.lit(0).cast("long")] * 2 if once else [F.xxhash64(text), F.xxhash64(text, F.lit(1))]
    keys = ["__doc", "__hash", "__more"]
    own = docs.drop("n_removed", "kept").select("*", *(c.alias(k) for c, k in zip([doc, *digest], keys, strict=True)))
    rows = rows_of(own, frequent_marks(own, column), column)
    found = rows.repartition("at").sortWithinPartitions("at", "doc", "hash", "more").mapInArrow(settle, "doc long, hash long, more long, place int, size int, done int")
    found = found.groupBy(*(F.col(k[2:]).alias(k) for k in keys)).agg(F.collect_list(F.struct("place", "size", "done")).alias("__repeats"))
    marked = own.join(found, keys, "left")
    again = F.lit(False) if once else F.row_number().over(Window.partitionBy(*keys).orderBy("__doc")) > 1
    marked = marked.select(*own.columns, "__repeats", again.alias("__again")).drop(*keys)
    at = marked.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = WordFacts(_of_words)
        for part in slices(batches, column, 1 << 20):
            repeats, again = part.column("__repeats").to_pylist(), part.column("__again").to_pylist()
            done = cleaned(texts(part, column), repeats, again, facts)
            valid = part.column(column).is_valid()
            left = pc.if_else(valid, pa.array([t for t, _ in done], pa.binary()), None).cast(pa.string())
            gone = pc.subtract(pc.fill_null(pc.utf8_length(part.column(column).cast(pa.string())), 0), pc.fill_null(pc.utf8_length(left), 0))
            columns = {n: c for n, c in zip(part.schema.names, part.columns, strict=True) if n not in ("__repeats", "__again")}
            columns[names[at]] = left
            kept = pa.array([[{"start": a, "end": b} for a, b in k] for _, k in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns.values(), gone.cast(pa.int64()), kept], [*columns, "n_removed", "kept"])

    names = marked.columns
    return marked.mapInArrow(work, plus(marked.drop("__repeats", "__again"), "n_removed long, kept array<struct<start:int,end:int>>"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars_left, n_removed, n_spans and the text that is left, for every document."""
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.length("text").cast("long").alias("n_chars_left"), "n_removed", F.size("kept").cast("long").alias("n_spans"), "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated passages taken out; n_chars follows the text. None goes."""
    ship(spark)
    columns = docs.columns
    done = dedup(docs)
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*columns)
