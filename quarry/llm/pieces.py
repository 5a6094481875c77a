"""SentencePiece encoding that keeps where in the text each piece came from, and decoding.

1. The model's compiled character map is a double-array trie whose values are places in a run of strings. At each
   character the longest prefix in the trie is replaced by its string, any other character stands for itself. Each byte of
   the result keeps the place in the text that it was made from.
2. Spaces become the word mark, and the model's rules for leading, trailing and repeated ones hold. No piece has a mark
   after another character, so pieces never go over the beginning of a run of marks: the parts between such places are
   independent. A task merges each distinct part once, with a copy of the model that normalises nothing, and puts the
   ids back by position.
3. A piece's bounds in the normalised text, taken through the places kept in step 1, are its bytes in the text as given.
   Of a character that is spelled in bytes, the last byte holds the whole character's place and those before are empty.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, slices, table, texts

MARK = "▁"
#: A task forgets its parts beyond so many characters.
CACHE = 2 << 20
SPANS = "ids array<int>, starts array<int>, ends array<int>"

#: Field numbers of the model file, and its kinds of piece.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_MAP, _PREFIX, _TRIM, _ESCAPE = 2, 3, 4, 5
_SUFFIX_MARK = 24


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """(number, value, start, end) of a message's fields; values are integers or bytes."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (message[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 128:
                return out, at

    at = 0
    while at < len(message):
        start = at
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value, start, at


class CharMap:
    """A compiled character map: a double-array trie, and the strings that its values point to, each up to a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.strings = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.strings == 0)
        self.sizes = (ends[np.searchsorted(ends, np.arange(len(self.strings)))] - np.arange(len(self.strings))) if len(ends) else np.zeros(0, np.int64)

    def longest(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest prefix in the trie at each place, 0 for none, and the place of its string. All places step on together."""
        sizes, values = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return sizes, values

        def onward(unit: np.ndarray) -> np.ndarray:
            return (unit >> 10) << ((unit & 512) >> 6)

        live, depth = np.arange(len(starts)), 0
        node = np.full(len(starts), onward(self.units[:1])[0])
        while True:
            inside = starts[live] + depth < len(raw)
            live, node = live[inside], node[inside]
            if not len(live):
                return sizes, values
            byte = raw[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[node]
            met = (unit & (1 << 31 | 255)) == byte
            live, unit = live[met], unit[met]
            node, depth = node[met] ^ onward(unit), depth + 1
            leaf = (unit >> 8 & 1) == 1
            sizes[live[leaf]], values[live[leaf]] = depth, self.units[node[leaf]] & ((1 << 31) - 1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """A vocabulary, its normaliser, and the parts that a task has merged already."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.table: list[bytes] = []
        kinds, normalizer, trainer, kept = [], b"", b"", []
        for number, value, start, end in fields(model):
            if number == _PIECE:
                own = {n: v for n, v, *_ in fields(value)}
                self.table.append(own.get(1, b""))
                kinds.append(own.get(3, _NORMAL))
            if number == _NORMALIZER:
                normalizer = value
            else:
                trainer = value if number == _TRAINER else trainer
                kept.append(model[start:end])
        rules = {n: v for n, v, *_ in fields(normalizer)}
        self.map, self.prefix, self.trim, self.escape = CharMap(rules.get(_MAP, b"")), rules.get(_PREFIX, 1), rules.get(_TRIM, 1), rules.get(_ESCAPE, 1)
        kind = np.array(kinds)
        options = {n: v for n, v, *_ in fields(trainer)}
        if _USER in kinds or _BYTE not in kinds or options.get(_SUFFIX_MARK, 0) or not self.escape:
            raise ValueError("a vocabulary with pieces of the user's own, without bytes, or with marks after words")
        mark = MARK.encode()
        self.apart = not any(mark in p.lstrip(mark) if not p.startswith(mark) else MARK in p.decode().lstrip(MARK) for p in self.table)
        bare = bytes([_NORMALIZER << 3 | 2, 6, _PREFIX << 3, 0, _TRIM << 3, 0, _ESCAPE << 3, 0])  # no map, no mark in front, nothing trimmed or replaced
        self.model = sentencepiece.SentencePieceProcessor(model_proto=b"".join(kept) + bare)
        self.is_byte = kind == _BYTE
        self.silent = kind == _CONTROL
        self.sizes = np.where(self.is_byte, 1, [len(p) for p in self.table]).astype(np.int64)
        shown = [b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(mark, b" ") for p, k in zip(self.table, kinds, strict=True)]
        self.shown, self.shown_sizes = np.frombuffer(b"".join(shown), np.uint8), np.array([len(s) for s in shown], np.int64)
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.marked = np.array([p.startswith(mark) and k not in (_CONTROL, _UNKNOWN, _BYTE) for p, k in zip(self.table, kinds, strict=True)])
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.ends, self.held = array("i"), array("q", [0]), 0

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and for its end the place in `text`."""
        raw = np.frombuffer(text, np.uint8)
        if not len(self.map.units) and not self.trim:
            if not text:
                return b"", np.zeros(1, np.int32)
            widths = np.where(raw == 32, 3, 1)
            lead = 3 if self.prefix else 0
            source = np.concatenate([np.zeros(lead, np.int32), np.repeat(np.arange(len(raw), dtype=np.int32), widths), np.array([len(raw)], np.int32)])
            return (MARK.encode() if lead else b"") + text.replace(b" ", MARK.encode()), source
        starts = np.flatnonzero(raw & 0xC0 != 0x80)
        widths = np.diff(starts, append=len(raw))
        sizes, values = self.map.longest(raw, starts)
        covered, last = np.zeros(len(starts) + 1, np.int64), 0
        for i in np.flatnonzero(sizes > widths).tolist():  # prefixes of several characters hide what begins within them
            if i >= last:
                last = int(np.searchsorted(starts, starts[i] + sizes[i]))
                covered[i + 1] += 1
                covered[last] -= 1 if last > i + 1 else 0
        own = np.cumsum(covered[:-1]) == 0
        starts, widths, sizes, values = starts[own], widths[own], sizes[own], values[own]
        found = sizes > 0
        begins = np.where(found, len(raw) + values, starts)
        lengths = np.where(found, self.map.sizes[np.where(found, values, 0)] if len(self.map.sizes) else 0, widths)
        out = np.concatenate([raw, self.map.strings])[ragged(begins, lengths)]
        owner = np.repeat(np.arange(len(starts)), lengths)
        space = out == 32
        lead = 0
        if self.trim:
            # A string's leading spaces go where what stands before it ends in one, or at the beginning.
            within = np.arange(len(out)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            filled = np.flatnonzero(lengths > 0)
            closes = space[np.cumsum(lengths)[filled] - 1] if len(filled) else np.zeros(0, bool)
            before = np.ones(len(starts), bool)
            before[filled[1:]] = closes[:-1]
            solid = np.flatnonzero(~space)
            nearest = np.concatenate([[-1], solid])[np.searchsorted(solid, np.arange(len(out)))]
            leading = nearest < np.arange(len(out)) - within
            keep = ~(space & leading & before[owner])
            single = (lengths == 1) & (out[np.minimum(np.cumsum(lengths) - lengths, max(0, len(out) - 1))] == 32) if len(out) else np.zeros(len(starts), bool)
            rest = np.flatnonzero(~single)
            if not len(rest):
                return b"", np.zeros(1, np.int32)
            lead = int(starts[rest[0]])
            out, owner, space = out[keep], owner[keep], space[keep]
        elif not len(raw):
            return b"", np.zeros(1, np.int32)
        source = np.repeat(starts[owner], np.where(space, 3, 1)) if len(out) else np.zeros(0, np.int64)
        done = out.tobytes().replace(b" ", MARK.encode())
        if self.prefix:
            done, source = MARK.encode() + done, np.concatenate([np.full(3, lead), source])
        end = len(raw)
        while self.trim and done.endswith(MARK.encode()):
            done, end = done[:-3], source[len(done) - 3]
        return done, np.append(source[: len(done)], end).astype(np.int32)

    def merge(self, parts: list[str]) -> np.ndarray:
        """Where each part's ids stand in `flat`, by its number in `ends`."""
        if self.held > CACHE:
            self._forget()
        missed = [p for p in set(parts) if p not in self.place]
        for part, ids in zip(missed, self.model.encode(missed, num_threads=1), strict=True):
            self.place[part] = len(self.place)
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
            self.held += len(part)
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other, the bytes [start, end) of its text that each stands for, and how many ids each text has."""
        normal = [self.normalise(t) for t in data]
        parts: list[str] = []
        bounds = [0]
        for done, _ in normal:
            own = done.decode("utf-8", "replace")
            parts += re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", own) if self.apart else [own] if own else []
            bounds.append(len(parts))
        at = self.merge(parts)
        ends = np.array(self.ends)
        sizes = np.diff(ends)[at] if len(at) else np.zeros(0, np.int64)
        ids = np.array(self.flat, np.int32)[ragged(ends[at], sizes)] if len(at) else np.zeros(0, np.int32)
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[bounds])
        starts_out, ends_out = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
        widths, is_byte = self.sizes[ids], self.is_byte[ids]
        first = 0
        for (done, source), n in zip(normal, counts.tolist(), strict=True):
            own = slice(first, first + n)
            stop = np.cumsum(widths[own])
            if (stop[-1] if n else 0) != len(done):
                raise ValueError("pieces that do not add up to their text")
            start = stop - widths[own]
            begins, finishes = source[start], source[stop]
            spelled = np.flatnonzero(is_byte[own])
            if len(spelled):
                inner = np.append(np.frombuffer(done, np.uint8) & 0xC0 == 0x80, False)
                head = np.maximum.accumulate(np.where(inner, 0, np.arange(len(inner))))
                begins[spelled] = source[head[start[spelled]]]
                finishes[spelled] = np.where(inner[stop[spelled]], begins[spelled], finishes[spelled])
            starts_out[own], ends_out[own] = begins, finishes
            first += n
        return ids, starts_out, ends_out, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids; the mark that the first piece begins with goes (all leading ones, if the model trims). Bytes that are no UTF-8 become U+FFFD each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.table)):
            raise ValueError("an id that the vocabulary does not have")
        sizes = self.shown_sizes[ids]
        every = self.shown[ragged(self.shown_starts[ids], sizes)].tobytes() if len(ids) else b""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        heard = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        heads = heard[np.searchsorted(heard, bounds[:-1])]
        out = []
        for head, first, last in zip(heads.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            drop = 0
            while self.prefix | self.trim and head < last and self.marked[ids[head]]:
                drop += 1
                if not self.trim or self.shown_sizes[ids[head]] > 1:  # else nothing is said yet
                    break
                head = heard[np.searchsorted(heard, head + 1)]
            raw = every[ends[first] + drop : ends[last]]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(_lenient(raw))
        return out


_CHARACTER = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|(.)", re.S)


def _lenient(raw: bytes) -> str:
    return "".join("�" if m[1] else m[0].decode() for m in _CHARACTER.finditer(raw))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """`docs` with ids, and starts and ends: the bytes of the text in UTF-8 that each piece stands for.

    Null and empty texts have empty lists. Repeated rows stay; an empty table gives none. Columns of docs with the new names are
    replaced. Texts may have any length to 2 GB of pieces; nothing is cut.
    """
    own = docs.drop("ids", "starts", "ends")
    names = [*own.columns, "ids", "starts", "ends"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for part in slices(batches, column, 1 << 20):
            *made, counts = pieces.encode(texts(part, column))
            yield pa.RecordBatch.from_arrays([*part.columns, *(_lists(m, counts) for m in made)], names)

    return own.mapInArrow(work, plus(own, SPANS))


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """`df` with decoded, the text of its ids. Null and empty lists are the empty text; a null id or one the vocabulary does not have raises ValueError."""
    own = df.drop("decoded")
    names = [*own.columns, "decoded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for part in batches:
            lists = part.column(column)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null id")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces.decode(flat.to_numpy(), counts), pa.string())], names)

    return own.mapInArrow(work, plus(own, "decoded string"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and covered_bytes, the sum of the pieces' spans, for every document.

    Null and empty texts have 0 tokens and the digests of the empty text. Repeated rows stay.
    """
    found = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path()).drop("text"), default_path())
    spans = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), spans.alias("covered_bytes"),
    )
