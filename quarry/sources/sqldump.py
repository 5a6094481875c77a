"""SQL text dumps as a Spark data source: spark.read.format("sqldump").

A dump is read in byte ranges. Each range holds the statements that begin in it; its task reads on past its end until the
last of them is whole. Whether a range begins within a string, a comment or a statement depends on all that stands
before, so `scan` first goes over the ranges in parallel, without parsing, and chains what they say; a few numbers per
range and the names of tables and columns come to the driver. Without a scan each file is one range.

Tasks hold a block and the statement at hand. A tuple is one match of a pattern made for its table, which captures only the
columns that are asked for; they are decoded as Arrow arrays, not value by value. Tuples with expressions are walked.

Options: `layout`, what `scan` found; `others`, true to have statements without tuples among the rows; `what`, rows (the default) or statements; `inserts`, false to leave INSERTs out of the
statements. A schema of one's own picks columns: those of BASE, and any other name is a table's column in lower case,
as string, binary, bigint or double (null where it has no such value).

Files are reached through Arrow's file systems (local, HDFS, S3, GCS). Paths that only Spark reaches are read by
`dump.read_statements`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import dump
from .dump import DumpError

BASE = "_ord long, _row int, _tbl string, _bytes long, _columns array<string>, _body binary, _tail binary, _fit boolean, _size long"
#: Bytes read at one time, rows and bytes in a batch, and the most ranges of a scan.
BLOCK, BATCH_ROWS, BATCH_BYTES, MOST_RANGES = 4 << 20, 4000, 8 << 20, 20_000
#: The places of a file's statements are this far from those of the next file.
FILE_SHIFT = 44


@dataclass(frozen=True)
class Start:
    """What holds where a range begins: what is open, the delimiter, whether the statement has no content yet, and whether it began before."""

    state: str = ""
    delimiter: str = ";"
    fresh: bool = True
    open: bool = False


AMID = Start(fresh=False, open=True)


@dataclass(frozen=True)
class Range(InputPartition):
    """Statements of file `path` (the number-th) that begin in [begin, end)."""

    path: str
    number: int
    begin: int
    end: int
    start: Start = Start()


@dataclass
class Layout:
    """Ranges with what they begin in, the columns of each CREATE TABLE, and the tables that have INSERTs or a CREATE TABLE."""

    ranges: list[Range]
    declared: dict[str, list[str]]
    tables: list[str]

    def packed(self) -> str:
        return json.dumps({"ranges": [[r.path, r.number, r.begin, r.end, *asdict(r.start).values()] for r in self.ranges], "declared": self.declared, "tables": self.tables})

    @staticmethod
    def unpacked(text: str) -> Layout:
        found = json.loads(text)
        return Layout([Range(*r[:4], Start(*r[4:])) for r in found["ranges"]], found["declared"], found["tables"])


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/(?!/)", path):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files in order of name, without those that begin with _ or a dot."""
    system, own = _at(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    if scheme and path.rstrip("/").endswith(own.rstrip("/")):
        scheme = path.rstrip("/")[: -len(own.rstrip("/"))]  # with the host, where the system's own paths leave it out
    info = system.get_file_info(own)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    every = [i for i in system.get_file_info(pafs.FileSelector(own)) if i.type == pafs.FileType.File and i.base_name[0] not in "_."]
    return [(scheme + i.path, i.size) for i in sorted(every, key=lambda i: i.path)]


def blocks(path: str, begin: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of whole lines from the first line at or after `begin`, to the first line's start at or after `stop` or the file's end."""
    system, own = _at(path)
    if path.endswith(".gz"):
        stream, held, offset = system.open_input_stream(own, compression="gzip"), b"", 0
        while block := stream.read(BLOCK):
            held += block
            if (cut := held.rfind(b"\n") + 1) > 0:
                yield offset, held[:cut]
                held, offset = held[cut:], offset + cut
        if held:
            yield offset, held
        return
    with system.open_input_file(own) as file:
        size = file.size()
        at, held, parts = max(0, begin - 1), [], begin == 0
        offset = at
        while at < size:
            block = file.read_at(min(BLOCK, size - at), at)
            at += len(block)
            if not parts:  # still in the line before
                cut = block.find(b"\n") + 1
                if not cut:
                    offset = at
                    continue
                block, parts, offset = block[cut:], True, at - len(block) + cut
                if stop is not None and offset >= stop:
                    return
            end = len(block)
            if stop is not None and at >= stop:
                # The last line is the one that holds the byte before `stop`.
                found = block.find(b"\n", max(0, stop - 1 - (at - len(block)))) + 1
                if found:
                    held.append(block[:found])
                    if whole := b"".join(held):
                        yield offset, whole
                    return
            cut = block.rfind(b"\n") + 1
            if cut:
                held.append(block[:cut])
                whole = b"".join(held)
                yield offset, whole
                offset += len(whole)
                held = [block[cut:]] if cut < end else []
            elif block:
                held.append(block)
        if held and parts:
            yield offset, b"".join(held)


def line_start(path: str, at: int) -> int:
    """The place of the first line that begins at or after `at`; the file's end where none does."""
    if at <= 0:
        return 0
    system, own = _at(path)
    with system.open_input_file(own) as file:
        size, at = file.size(), at - 1
        while at < size:
            block = file.read_at(1 << 16, at)
            if cut := block.find(b"\n") + 1:
                return at + cut
            at += len(block)
    return size


_CHANGE = re.compile(rb"(?im)^\s*DELIMITER[ \t]")


class Walk:
    """Cuts blocks of whole lines into statements; what is open goes on from block to block."""

    def __init__(self, start: Start):
        self.state, self.delimiter, self.fresh = start.state.encode(), start.delimiter.encode("latin-1"), start.fresh
        self.skip = start.open  # the statement at hand began in a range before
        self.parts: list[bytes] = []
        self.begin = -1
        self.ended = self.changed = False  # whether a statement has ended, and a delimiter may have changed before that

    def feed(self, offset: int, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of each statement that ends here and began in this range."""
        start = at = 0
        n = len(text)
        while at < n:
            if self.state:
                found = dump._CLOSED[self.state].match(text, at)
                if not found:
                    break
                self.state, at = b"", found.end()
                continue
            if self.fresh:
                at = dump._SKIP.match(text, at).end()
                if at >= n:
                    break
                change = dump._DELIMITER.match(text, at)
                if change:
                    at = change.end()
                    yield from self._out(offset, text, start, at)
                    self.delimiter, start = change[1], at
                    continue
                if text.startswith(b"/*", at) and not text.startswith((b"/*!", b"/*M!"), at):
                    self.state, at = b"/*", at + 2  # has no end in this block
                    continue
                self.fresh = False
            at = dump._plain(self.delimiter).match(text, at).end()
            if text.startswith(self.delimiter, at):
                at += len(self.delimiter)
                line = text.find(b"\n", at) + 1 or n
                if not text[at:line].strip():
                    at = line
                yield from self._out(offset, text, start, at)
                start, self.fresh = at, True
            elif at < n:
                self.state = b"/*" if text[at : at + 1] == b"/" else text[at : at + 1]
                at += len(self.state)
        if start < n:
            self.changed = self.changed or not self.ended and bool(_CHANGE.search(text, start))
            if not self.parts and not self.skip:
                self.begin = offset + start
            if not self.skip:
                self.parts.append(text[start:])
            self.waiting = True

    waiting = False

    def _out(self, offset: int, text: bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        if not self.ended:
            self.changed = self.changed or bool(_CHANGE.search(text, start, end))
        self.ended, self.waiting = True, False
        if self.skip:
            self.skip = False
            return
        begin = self.begin if self.parts else offset + start
        raw = b"".join([*self.parts, text[start:end]])
        self.parts = []
        yield begin, raw

    def now(self) -> Start:
        return Start(self.state.decode(), self.delimiter.decode("latin-1"), self.fresh, self.waiting or self.skip)


def statements_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """(ord, bytes) of a range's statements. A dump that ends within a string or a comment raises DumpError."""
    walk, base = Walk(part.start), part.number << FILE_SHIFT
    end = 1 << FILE_SHIFT if part.path.endswith(".gz") else line_start(part.path, part.end)  # where the next range begins
    for offset, block in blocks(part.path, part.begin):
        if offset >= end and not walk.parts:
            return
        for place, raw in walk.feed(offset, block):
            if place >= end:
                return
            yield base + place, raw
        if offset + len(block) >= end and (walk.skip or not walk.waiting or walk.begin >= end):
            return  # a statement that began before may go over the whole range
    if walk.state:
        raise DumpError(f"the dump ends within {walk.state.decode()}")
    if walk.parts:
        yield base + walk.begin, b"".join(walk.parts)


_HEAD = re.compile(rb"(?:INSERT|REPLACE)\b", re.I)


def _looked(part: Range, start: Start) -> tuple[Start, bool, list, list]:
    """Where a range ends if it begins so, whether that holds for any statement that is open there, and what it has: [table, columns or None] of INSERTs and CREATE TABLEs, and apart of what stands before the first end, which is a statement only where none is open."""
    walk, found, first = Walk(Start(start.state, start.delimiter, start.fresh)), [], []

    def note(place: int, raw: bytes) -> None:
        own = first if place == opening else found
        begin = dump._SKIP.match(raw).end()
        if head := dump._INSERT.match(raw, begin):
            own.append([dump.unquote_name(head[1]), None])
            return
        kind, tbl = dump.classify(raw)
        if kind == "create_table" and tbl:
            own.append([tbl, [n for n, _ in dump.declared_columns(raw)]])

    opening = -1
    gz = part.path.endswith(".gz")
    for offset, block in blocks(part.path, 0 if gz else part.begin, None if gz else part.end):
        opening = offset if opening < 0 else opening
        for place, raw in walk.feed(offset, block):
            note(place, raw)
    end, settled = walk.now(), walk.ended and not walk.changed
    if opening < 0:  # no line begins here
        end = start
    elif not walk.ended and start.open:
        end = Start(end.state, end.delimiter, end.fresh, True)
    if walk.parts:  # its last statement goes on in the next range
        own = b"".join(walk.parts)
        begin, place = dump._SKIP.match(own).end(), walk.begin
        if _HEAD.match(own, begin):
            note(place, own)
        elif not gz:
            for offset, block in blocks(part.path, part.end):
                if more := next(walk.feed(offset, block), None):
                    note(place, more[1])
                    break
    return end, settled, found, first


def scan(spark: SparkSession, path: str, split: int | None = None) -> Layout:
    """The layout of the dump at `path`, from one pass over its ranges; where the guess that a range begins outside of strings and comments proves wrong, it and those after it are looked at once more, for every state."""
    listed = files(path)
    total = sum(size for _, size in listed)
    if split is None:
        most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        split = min(most, max(1 << 20, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    split = max(split, -(-total // MOST_RANGES))
    ranges = [Range(name, number, at, min(size, at + split)) for number, (name, size) in enumerate(listed) for at in (range(0, size, split) if not name.endswith(".gz") else [0])]
    first = [p == 0 or ranges[p].number != ranges[p - 1].number for p in range(len(ranges))]
    known: dict[tuple[int, Start], tuple] = {}
    settled: dict[tuple[int, str, str], tuple] = {}
    todo = {p: [Start() if first[p] else AMID] for p in range(len(ranges))}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for given in batch.column("given").to_pylist():
                p, own, starts = json.loads(given)
                for s in starts:
                    end, free, found, before = _looked(Range(*own), Start(*s))
                    out.append(json.dumps([p, s, list(asdict(end).values()), free, found, before]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["found"])

    while True:
        work = [(json.dumps([p, [ranges[p].path, ranges[p].number, ranges[p].begin, ranges[p].end], [list(asdict(s).values()) for s in starts]]),) for p, starts in todo.items()]
        if work:
            frame = spark.createDataFrame(work, "given string").repartition(min(len(work), 4 * spark.sparkContext.defaultParallelism))
            for r in frame.mapInArrow(look, "found string").collect():  # a row per range and start
                p, s, end, free, found, before = json.loads(r.found)
                known[p, Start(*s)] = Start(*end), found, before
                if free:
                    settled[p, s[0], s[1]] = known[p, Start(*s)]
        starts, declared, tables = [], {}, set()
        now = Start()
        for p in range(len(ranges)):
            now = Start() if first[p] else now
            found = known.get((p, now)) or settled.get((p, now.state, now.delimiter))
            if not found:
                break
            starts.append(now)
            now = found[0]
            for tbl, columns in found[1] + ([] if starts[-1].open else found[2]):
                tables.add(tbl)
                if columns is not None:
                    declared[tbl] = columns
            if now.state and (p + 1 == len(ranges) or first[p + 1]):
                raise DumpError(f"the dump ends within {now.state}")
        else:
            return Layout([Range(r.path, r.number, r.begin, r.end, s) for r, s in zip(ranges, starts, strict=True)], declared, sorted(tables))
        todo = {q: [Start(s, now.delimiter, False, True) for s in ("", "'", '"', "`", "/*")] for q in range(p + 1, len(ranges)) if not first[q]}
        todo = {q: new for q, own in todo.items() if (new := [s for s in own if (q, s) not in known])} | {p: [now]}


_NUMBER = rb"[-+]?(?:\d++\.?\d*+|\.\d++)(?:[eE][-+]?\d++)?"
_TEXT = rb"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_PLAIN = rb"(?:(?i:NULL)|" + _TEXT + rb"|0x[0-9A-Fa-f]++|" + _NUMBER + rb")"


@cache
def _tuple(columns: int, wanted: tuple[int, ...]) -> re.Pattern:
    """A tuple of so many plain values, its wanted ones captured after the whole."""
    values = [rb"(" + _PLAIN + rb")" if i in wanted else _PLAIN for i in range(columns)]
    return re.compile(rb"(\(\s*+" + rb"\s*+,\s*+".join(values) + rb"\s*+\))\s*+(?:,\s*+)?", re.S)


def decoded(raws: list[bytes], kind: pa.DataType) -> pa.Array:
    """Literals as values of a type; NULL, bits, expressions and what the type can't hold are null."""
    given = pa.array(raws, pa.binary())
    quoted = pc.starts_with(given, b"'")
    out = pc.if_else(quoted, pc.binary_slice(given, 1, -1), given)
    doubled = pc.or_(pc.match_substring(out, b"\\"), pc.match_substring(out, b"''"))
    simple = pc.or_(pc.and_not(quoted, doubled), pc.match_substring_regex(given, r"^[-+]?[0-9.]+$"))
    if not pc.all(simple).as_py():
        fix = pc.invert(simple)
        values = []
        for i in np.flatnonzero(fix.to_numpy(zero_copy_only=False)).tolist():
            found = dump._VALUE.match(raws[i] + b",")
            values.append(dump.decode(found.lastgroup, found[found.lastgroup]) if found and found.lastgroup not in ("bit", "null") else None)
        out = pc.replace_with_mask(out, fix, pa.array(values, pa.binary()))
    if pa.types.is_binary(kind):
        return out
    try:
        text = out.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([None if x is None else x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())
    if pa.types.is_string(kind):
        return text
    shape = r"^-?[0-9]{1,18}$" if pa.types.is_integer(kind) else r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
    return pc.if_else(pc.match_substring_regex(text, shape), text, None).cast(kind)


class Rows:
    """Record batches of tuples; rows of one table and column list are decoded together."""

    def __init__(self, schema: pa.Schema, declared: dict[str, list[str]], whole: bool = True):
        self.schema, self.declared, self.sized = schema, declared, whole
        self.values = [f.name for f in schema if not f.name.startswith("_")]
        self.key: tuple = ()
        self.clear()

    def clear(self) -> None:
        self.ords, self.numbers, self.groups, self.fits, self.whole, self.size = [], [], [], [], [], 0

    def insert(self, ord_: int, raw: bytes, number: int = 0) -> Iterator[pa.RecordBatch]:
        """Take an INSERT's tuples in, of which the first is the number-th of its statement."""
        head = dump._INSERT.match(raw, dump._SKIP.match(raw).end())
        if not head:
            return
        tbl = dump.unquote_name(head[1])
        columns = tuple(dump.plain_name(c) for c in re.findall(dump._PART, head[2])) if head[2] else None
        names = columns if columns is not None else tuple(self.declared.get(tbl, ()))
        low = [n.lower() for n in names]
        place = {n: i for i, n in enumerate(low)}
        asked = [n for n in self.values if n in place]
        order = tuple(sorted(place[n] for n in asked))
        pattern = _tuple(len(names), order) if names else None
        key = (tbl, columns, names, order)
        late = "_tail" in self.schema.names  # the clause after the tuples stands behind the last one: the others wait for it
        if (*key, None) != self.key:
            yield from self.out()
            self.key = (*key, None)
        before = len(self.groups)
        at, first = head.end(), number
        while raw[at : at + 1] == b"(":
            found = pattern.match(raw, at) if pattern else None
            if found:
                group, at, fit = found.groups(), found.end(), True
            else:
                values, end = dump.tuple_at(raw, at)
                whole = raw[at:end]
                fit = len(values) == len(names)
                if fit:
                    group = (whole, *(values[i][1] if values[i][0] not in ("expr", "bit") else b"NULL" for i in order))
                else:
                    group = (whole, *[None] * len(order))
                at = dump.after_tuple(raw, end)
            self.ords.append(ord_)
            self.numbers.append(number)
            self.groups.append(group)
            self.fits.append(fit)
            self.whole.append(len(raw) if number == first and self.sized else None)  # of the statement, at its first row
            self.size += len(group[0])
            number += 1
            if not late and (len(self.groups) >= BATCH_ROWS or self.size >= BATCH_BYTES):
                yield from self.out()
        if late and number > first and (tail := dump._TAIL.match(raw, at)):
            own = [x[before:] for x in (self.ords, self.numbers, self.groups, self.fits, self.whole)]
            del self.ords[before:], self.numbers[before:], self.groups[before:], self.fits[before:], self.whole[before:]
            yield from self.out()
            self.ords, self.numbers, self.groups, self.fits, self.whole = own
            self.key = (*key, tail[1])
            yield from self.out()
            self.key = (*key, None)
        elif len(self.groups) >= BATCH_ROWS or self.size >= BATCH_BYTES:
            yield from self.out()

    def other(self, ord_: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        """A statement without tuples, as row -1 of its table with its bytes."""
        yield from self.out()
        made = {"_ord": ord_, "_row": -1, "_tbl": dump.classify(raw)[1], "_body": raw, "_size": len(raw)}
        yield pa.RecordBatch.from_arrays([pa.array([made.get(f.name)], f.type) for f in self.schema], schema=self.schema)

    def out(self) -> Iterator[pa.RecordBatch]:
        n = len(self.groups)
        if not n:
            return
        tbl, columns, names, order, tail = self.key
        by = list(zip(*self.groups, strict=True))
        place = {names[i].lower(): by[k + 1] for k, i in enumerate(order)}
        base = {
            "_ord": lambda: pa.array(self.ords, pa.int64()),
            "_row": lambda: pa.array(self.numbers, pa.int32()),
            "_tbl": lambda: pa.array([tbl], pa.string()).take(pa.array(np.zeros(n, np.int32))),
            "_bytes": lambda: pa.array(list(map(len, by[0])), pa.int64()),
            "_columns": lambda: pa.array([None if columns is None else list(columns)], pa.list_(pa.string())).take(pa.array(np.zeros(n, np.int32))),
            "_body": lambda: pa.array(by[0], pa.binary()),
            "_tail": lambda: pa.array([tail], pa.binary()).take(pa.array(np.zeros(n, np.int32))),
            "_fit": lambda: pa.array(self.fits, pa.bool_()),
            "_size": lambda: pa.array(self.whole, pa.int64()),
        }
        arrays = []
        for f in self.schema:
            if f.name in base:
                arrays.append(base[f.name]().cast(f.type))
            elif f.name in place:
                arrays.append(decoded(list(place[f.name]), f.type))
            else:
                arrays.append(pa.nulls(n, f.type))
        self.clear()
        made = pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        for first in range(0, n, BATCH_ROWS):
            yield made.slice(first, BATCH_ROWS)


def parsed(rows: DataFrame, declared: dict[str, list[str]], ddl: str) -> DataFrame:
    """Columns of `ddl` (as the data source gives them) of rows (ord, row, tbl, columns, body, tail) that are tuples already."""
    schema, arrow = StructType.fromDDL(ddl), arrow_schema(StructType.fromDDL(ddl))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = Rows(arrow, declared, False)
            for ord_, row, tbl, columns, body, tail in zip(*(batch.column(c).to_pylist() for c in ("ord", "row", "tbl", "columns", "body", "tail")), strict=True):
                names = "" if columns is None else " (" + ",".join("`" + c.replace("`", "``") + "`" for c in columns) + ")"
                yield from made.insert(ord_, b"INSERT INTO `" + tbl.replace("`", "``").encode() + b"`" + names.encode() + b" VALUES " + body + (b" " + tail if tail else b""), row)
            yield from made.out()

    return rows.select("ord", "row", "tbl", "columns", "body", "tail").mapInArrow(work, schema)


def declared_of(statements_: DataFrame) -> dict[str, list[str]]:
    """The columns of each CREATE TABLE: a row per table comes to the driver."""
    found = statements_.where("kind = 'create_table' and tbl is not null").select("tbl", "raw").collect()
    return {r.tbl: [n for n, _ in dump.declared_columns(bytes(r.raw))] for r in found}


def arrow_schema(schema: StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


class SqlDump(DataSource):
    """spark.read.format("sqldump").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> str:
        return dump.STATEMENT if self.options.get("what") == "statements" else BASE

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqlDumpReader(schema, dict(self.options))


class SqlDumpReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.options, self.schema = options, arrow_schema(schema)
        given = options.get("layout")
        self.layout = Layout.unpacked(given) if given else None
        self.declared, self.scanned = (self.layout.declared, True) if self.layout else ({}, False)

    def partitions(self) -> list[Range]:
        ranges = self.layout.ranges if self.layout else [Range(p, i, 0, size) for i, (p, size) in enumerate(files(self.options["path"]))]
        self.layout = None  # tasks get their own range alone
        self.options.pop("layout", None)
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if self.options.get("what") == "statements":
            yield from self._statements(partition)
            return
        rows, others = Rows(self.schema, dict(self.declared)), self.options.get("others", "false").lower() == "true"
        for ord_, raw in statements_of(partition):
            if not self.scanned and not dump._INSERT.match(raw, dump._SKIP.match(raw).end()):
                kind, tbl = dump.classify(raw)
                if kind == "create_table" and tbl:
                    rows.declared[tbl] = [n for n, _ in dump.declared_columns(raw)]
            if others and not dump._INSERT.match(raw, dump._SKIP.match(raw).end()):
                yield from rows.other(ord_, raw)
            else:
                yield from rows.insert(ord_, raw)
        yield from rows.out()

    def _statements(self, partition: Range) -> Iterator[pa.RecordBatch]:
        skip = self.options.get("inserts", "true").lower() == "false"
        held, size = [], 0

        def out() -> pa.RecordBatch:
            kinds = [dump.classify(raw) for _, raw in held]
            made = {"ord": pa.array([o for o, _ in held], pa.int64()), "raw": pa.array([r for _, r in held], pa.binary()), "kind": pa.array([k for k, _ in kinds], pa.string()), "tbl": pa.array([t for _, t in kinds], pa.string())}
            held.clear()
            return pa.RecordBatch.from_arrays([made[f.name] for f in self.schema], schema=self.schema)

        for ord_, raw in statements_of(partition):
            if skip and dump._INSERT.match(raw, dump._SKIP.match(raw).end()):
                continue
            held.append((ord_, raw))
            size += len(raw)
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield out()
                size = 0
        if held:
            yield out()


def source(spark: SparkSession, path: str, layout: Layout | None = None):
    """A reader of the dump at `path`, over the ranges of its layout."""
    spark.dataSource.register(SqlDump)
    reader = spark.read.format("sqldump").option("path", path)
    return reader.option("layout", layout.packed()) if layout else reader


def reached(path: str) -> bool:
    """Whether Arrow's file systems reach `path`."""
    try:
        _at(path)
    except (OSError, pa.ArrowException, ImportError):
        return False
    return True


def rows(spark: SparkSession, path: str, columns: str = BASE, layout: Layout | None = None) -> DataFrame:
    """Rows of the dump at `path`, with these columns of BASE and of its tables; by ranges of `layout`, or of a scan.

    A path that only Spark reaches is read with Spark's text reader, and the tuples that it gives are parsed alike.
    """
    if not layout and not reached(path):
        found = dump.read_statements(spark, path)
        return parsed(dump.read_rows(found), declared_of(found), columns)
    return source(spark, path, layout or scan(spark, path)).schema(columns).load()


def statistics(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """(tbl, statements, rows, bad_rows, row_bytes, other_bytes) of each table, '' for statements of none, counted as the dump goes by.

    Bad rows have another length than their columns; other bytes are all of a table's statements that are not its rows.
    """
    reader = source(spark, path, layout or scan(spark, path)).option("others", "true")
    found = reader.schema("_row int, _tbl string, _bytes long, _fit boolean, _size long").load()
    tuples = F.col("_row") >= 0
    return found.groupBy(F.coalesce("_tbl", F.lit("")).alias("tbl")).agg(
        F.count("_size").alias("statements"), F.count_if(tuples).alias("rows"), F.count_if(tuples & ~F.col("_fit")).alias("bad_rows"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).alias("row_bytes"), (F.sum("_size") - F.coalesce(F.sum("_bytes"), F.lit(0))).alias("other_bytes"),
    )


def statements(spark: SparkSession, path: str, inserts: bool = True, layout: Layout | None = None) -> DataFrame:
    """(ord, raw, kind, tbl) of the dump's statements in place of `dump.read_statements`; ord is the place in the file."""
    return source(spark, path, layout or scan(spark, path)).option("what", "statements").option("inserts", str(inserts).lower()).load()
