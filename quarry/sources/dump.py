"""SQL text dumps as DataFrames.

Spark's text reader cuts plain files at line ends, in parallel where the file can be split; bytes pass as they are. Whether
a line begins within a string, a comment or a statement depends on the lines before it, so each split first says how it
ends; then all splits are cut at their statements' ends, and statements that go over splits are put together. Strings may
hold anything, also semicolons and line breaks. `raw` of all statements in order is the file, which ends in a line break.
With `exact=True` whole files are walked, one task each: for files whose last line has no line break.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENT = "ord long, raw binary, kind string, tbl string"
ROW = "ord long, row int, tbl string, columns array<string>, body binary, values array<struct<kind:string,raw:binary>>, tail binary"

_STRING = rb"'(?:[^'\\]|\\.|'')*'"
_PART = rb"(?:`(?:[^`]|``)*`|[\w$]+)"
_NAME = _PART + rb"(?:\." + _PART + rb")?"
_SKIP = re.compile(rb"(?:\s+|#[^\n]*(?:\n|$)|--(?:[\s][^\n]*)?(?:\n|$)|/\*(?![!M])(?>.*?\*/)|/\*M!999999\\-(?>.*?\*/))*", re.S)
_KINDS = (
    ("create_table", re.compile(rb"(?:/\*!\d*\s*)?CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(" + _NAME + rb")", re.I)),
    ("drop_table", re.compile(rb"(?:/\*!\d*\s*)?DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(" + _NAME + rb")", re.I)),
    ("lock_tables", re.compile(rb"LOCK\s+TABLES?\s+(" + _NAME + rb")", re.I)),
    ("alter_table", re.compile(rb"(?:/\*!\d*\s*)?ALTER\s+TABLE\s+(" + _NAME + rb")", re.I)),
    ("create_trigger", re.compile(rb"(?:/\*!\d*\s*)?CREATE\s+.*?TRIGGER\s+.*?\sON\s+(" + _NAME + rb")", re.I | re.S)),
    ("delimiter", re.compile(rb"DELIMITER\s()", re.I)),
)
_INSERT = re.compile(rb"(?:INSERT|REPLACE)(?:\s+(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE))*(?:\s+INTO)?\s+(" + _NAME + rb")\s*(\((?:\s*" + _PART + rb"\s*,?)*\))?\s*VALUES?\s*(?=\()", re.I)
_VALUE = re.compile(
    rb"\s*(?:(?P<null>NULL)|(?P<string>(?:_\w+\s*)?(?:" + _STRING + rb'|"(?:[^"\\]|\\.|"")*"))|(?P<hex>0x[0-9A-Fa-f]+|[xX]\'[0-9A-Fa-f]*\')|(?P<bit>0b[01]+|[bB]\'[01]*\')|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?))\s*(?=[,)])', re.I | re.S
)
_EXPRESSION = re.compile(rb"(?:[^'\"`(),]|" + _STRING + rb'|"(?:[^"\\]|\\.|"")*"|`[^`]*`)+', re.S)
_ESCAPE = re.compile(rb"\\(.)|''", re.S)
_ESCAPES = {b"0": b"\0", b"b": b"\b", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"Z": b"\x1a", b"%": b"\\%", b"_": b"\\_"}


#: What may follow an INSERT's tuples: a clause that holds for all of them.
_TAIL = re.compile(rb"\s*(ON\s.*?|RETURNING\s.*?)\s*;?\s*$", re.I | re.S)


class DumpError(ValueError):
    """Text that ends within a statement or a value."""


def plain_name(name: bytes) -> str:
    """A name without its backticks; two within are one."""
    return (name[1:-1].replace(b"``", b"`") if name[:1] == b"`" else name).decode("utf-8", "replace")


def unquote_name(name: bytes) -> str:
    """The last part of a qualified name, without backticks."""
    found = re.findall(_PART, name)
    return plain_name(found[-1]) if found else ""


def classify(raw: bytes) -> tuple[str, str | None]:
    """A statement's kind and table."""
    body = raw[_SKIP.match(raw).end() :]
    if found := _INSERT.match(body):
        return "insert", unquote_name(found[1])
    for kind, pattern in _KINDS:
        if found := pattern.match(body):
            return kind, unquote_name(found[1]) or None
    return "other", None


def decode(kind: str, raw: bytes) -> bytes | None:
    """A value's bytes: strings unescaped, hex decoded, numbers as they are, NULL none. Bits and expressions have none and raise."""
    if kind == "null":
        return None
    if kind == "number":
        return raw
    if kind == "hex":
        digits = raw[2:].strip(b"'")
        return bytes.fromhex((digits if len(digits) % 2 == 0 else b"0" + digits).decode())
    if kind == "string":
        text = raw[min(i for i in (raw.find(b"'"), raw.find(b'"')) if i >= 0) :]
        quote = text[:1]
        return re.sub(rb"\\(.)|" + quote * 2, lambda m: quote if m[1] is None else _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
    raise DumpError(f"a value of kind {kind} can't be decoded")


_QUOTE = re.compile(rb"[\0\n\r\x1a'\\]")
_QUOTES = {b"\0": b"\\0", b"\n": b"\\n", b"\r": b"\\r", b"\x1a": b"\\Z", b"'": b"\\'", b"\\": b"\\\\"}


def quoted(text: bytes) -> bytes:
    """A string as a dump writes it."""
    return b"'" + _QUOTE.sub(lambda m: _QUOTES[m[0]], text) + b"'"


def value(body: bytes, at: int) -> tuple[str, bytes, int]:
    """The kind and bytes of the value at `at`, and where it ends."""
    if found := _VALUE.match(body, at):
        kind = found.lastgroup
        return kind, found[kind], found.end()
    depth, end = 0, at
    while end < len(body):
        if body[end : end + 1] == b"(":
            depth, end = depth + 1, end + 1
        elif body[end : end + 1] == b")" and depth:
            depth, end = depth - 1, end + 1
        elif body[end : end + 1] in b",)" and not depth:
            return "expr", body[at:end].strip(), end
        elif body[end : end + 1] == b",":
            end += 1
        elif found := _EXPRESSION.match(body, end):
            end = found.end()
        else:
            break
    raise DumpError(f"a value ends early at byte {at}")


def tuple_at(raw: bytes, at: int) -> tuple[list[tuple[str, bytes]], int]:
    """The values of the tuple that begins at `at`, and where it ends."""
    at, found = at + 1, []
    while True:
        kind, own, at = value(raw, at)
        found.append((kind, own))
        while raw[at : at + 1].isspace():
            at += 1
        at += 1
        if raw[at - 1 : at] == b")":
            return found, at


def after_tuple(raw: bytes, end: int) -> int:
    """Where the next tuple begins after one that ends at `end`; where there is none, the place of what follows."""
    found = re.compile(rb"\s*,\s*").match(raw, end)
    return found.end() if found else end


def tuples(raw: bytes) -> tuple[list[str] | None, Iterator[tuple[bytes, list[tuple[str, bytes]]]]]:
    """An INSERT's column list, and each tuple's bytes and values."""
    head = _INSERT.match(raw, _SKIP.match(raw).end())
    if not head:
        return None, iter(())
    columns = [plain_name(c) for c in re.findall(_PART, head[2])] if head[2] else None

    def rows() -> Iterator[tuple[bytes, list[tuple[str, bytes]]]]:
        at = head.end()
        while raw[at : at + 1] == b"(":
            found, end = tuple_at(raw, at)
            yield raw[at:end], found
            at = after_tuple(raw, end)

    return columns, rows()


def tail_of(raw: bytes, bodies: list[bytes]) -> bytes | None:
    """The clause after an INSERT's tuples, or None."""
    found = _TAIL.match(raw, raw.rindex(bodies[-1]) + len(bodies[-1])) if bodies else None
    return found[1] if found else None


def statements(text: bytes) -> Iterator[bytes]:
    """The statements of a text, each with its delimiter and what stands before it; the rest of the text comes last."""
    delimiter, start, at = b";", 0, 0
    token = None
    while at < len(text):
        if token is None:
            token = re.compile(_STRING + rb'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|/\*.*?\*/|#[^\n]*|--(?=\s)[^\n]*|(?P<end>' + re.escape(delimiter) + rb")", re.S)
        begin = _SKIP.match(text, at).end()
        if start == at and (change := re.compile(rb"DELIMITER[ \t]+(\S+)[^\n]*(?:\n|$)", re.I).match(text, begin)):
            delimiter, token, at = change[1], None, change.end()
            yield text[start:at]
            start = at
            continue
        found = token.search(text, at)
        if not found:
            break
        at = found.end()
        if found["end"]:
            yield text[start:at]
            start = at
    if start < len(text):
        rest = text[start:]
        if _SKIP.match(rest).end() < len(rest) and re.search(rb"'|\"|\(", rest):
            raise DumpError(f"the statement at byte {start} has no end")
        yield rest


_CLOSED = {
    b"'": re.compile(rb"[^'\\]*+(?:\\.[^'\\]*+)*+'", re.S),
    b'"': re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S),
    b"`": re.compile(rb"[^`]*+`", re.S),
    b"/*": re.compile(rb"(?:[^*]++|\*(?!/))*+\*/", re.S),
}
_DELIMITER = re.compile(rb"DELIMITER[ \t]+(\S+)[^\n]*\n?", re.I)


@cache
def _plain(delimiter: bytes) -> re.Pattern:
    """What holds no end of a statement and leaves nothing open."""
    end, first = re.escape(delimiter), re.escape(delimiter[:1])
    return re.compile(
        rb"(?:[^'\"`/#\-" + first + rb"]++|'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|`[^`]*+`|/\*(?:[^*]++|\*(?!/))*+\*/|#[^\n]*+|--(?=\s)[^\n]*+"
        rb"|(?!" + end + rb")(?:/(?!\*)|-(?!-\s)|" + (first if first not in (b"'", b'"', b"`") else rb"(?!)") + rb"))*+", re.S
    )


class Cutter:
    """Cuts lines into statements; what is open and the delimiter go on from line to line."""

    def __init__(self, state: bytes = b"", delimiter: bytes = b";"):
        self.state, self.delimiter = state, delimiter
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> Iterator[bytes]:
        """The statements that end in this line (with its line break)."""
        start = at = 0
        change = None if self.state else _DELIMITER.match(line, len(line) - len(line.lstrip()))
        if change and _SKIP.fullmatch(b"".join(self.parts)):
            self.delimiter = change[1]
            yield b"".join([*self.parts, line])
            self.parts = []
            return
        while at < len(line):
            if self.state:
                found = _CLOSED[self.state].match(line, at)
                if not found:
                    break
                self.state, at = b"", found.end()
                continue
            at = _plain(self.delimiter).match(line, at).end()
            if line.startswith(self.delimiter, at):
                at += len(self.delimiter)
                if not line[at:].strip():
                    at = len(line)
                yield b"".join([*self.parts, line[start:at]])
                self.parts, start = [], at
            elif at < len(line):
                self.state = b"/*" if line[at : at + 1] == b"/" else line[at : at + 1]
                at += len(self.state)
        if start < len(line):
            self.parts.append(line[start:])


def read_statements(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """(ord, raw, kind, tbl) of every statement of the dump at `path`. An empty file has none. A file that ends within a string or a comment raises DumpError."""

    def made(ord_: list[int], raw: list[bytes]) -> pa.RecordBatch:
        kinds = [classify(x) for x in raw]
        return pa.RecordBatch.from_arrays([pa.array(ord_, pa.int64()), pa.array(raw, pa.binary()), pa.array([k for k, _ in kinds], pa.string()), pa.array([t for _, t in kinds], pa.string())], ["ord", "raw", "kind", "tbl"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("content").to_pylist():
                content = gzip.decompress(packed) if packed[:2] == b"\x1f\x8b" else packed
                for number, raw in enumerate(statements(content)):
                    yield made([number], [raw])

    if exact:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(walk, STATEMENT)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    starts, tails = _split_states(lines)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        cutter, number, first = Cutter(*starts[part][:2]), part << 33, starts[part][2]
        for batch in batches:
            ords, raws, pieces = [], [], []
            for line in batch.column("value").to_pylist():
                for raw in cutter.feed(line + b"\n"):
                    if first >= 0:  # the end of a statement that began in a split before
                        ords.append(first)
                        pieces.append(part + 1)
                        first = -1
                    else:
                        ords.append(number)
                        pieces.append(0)
                        number += 1
                    raws.append(raw)
            if raws:
                yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(pieces, pa.int32()), pa.array(raws, pa.binary())], ["ord", "piece", "raw"])
        if rest := b"".join(cutter.parts):
            yield pa.RecordBatch.from_arrays([pa.array([first if first >= 0 else number], pa.int64()), pa.array([part + 1], pa.int32()), pa.array([rest], pa.binary())], ["ord", "piece", "raw"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield made(batch.column("ord").to_pylist(), batch.column("raw").to_pylist())

    pieces = lines.mapInArrow(cut, "ord long, piece int, raw binary")
    # Pieces of one statement are two splits' ends, or a few splits where a statement is longer than one.
    whole = pieces.where("piece = 0").select("ord", "raw")
    if not tails:
        return whole.mapInArrow(named, STATEMENT)
    joined = pieces.where("piece > 0").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("piece", "raw"))).alias("own"))
    joined = joined.select("ord", F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x["raw"])).alias("raw"))
    return whole.unionByName(joined).mapInArrow(named, STATEMENT)


def _split_states(lines: DataFrame) -> tuple[dict[int, tuple[bytes, bytes, int]], bool]:
    """What is open where each split begins, its delimiter, and the statement that goes on there (or -1); and whether any split ends within a statement.

    A split is read for the state that it most likely begins in, which is none; where that proves wrong, it and all after
    it are read once more for every state.
    """
    count = lines.rdd.getNumPartitions()
    todo = {p: [(b"", b";")] for p in range(count)}
    known: dict[tuple[int, bytes, bytes], tuple[bytes, bytes, int, bool]] = {}
    while True:

        def scan(batches: Iterator[pa.RecordBatch], todo=todo) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            starts = todo.get(part, [])
            cutters, numbers = [Cutter(*s) for s in starts], [0] * len(starts)
            for batch in batches if starts else ():
                for line in batch.column("value").to_pylist():
                    for i, cutter in enumerate(cutters):
                        for _ in cutter.feed(line + b"\n"):
                            numbers[i] += 1
            columns = [[part] * len(starts), [s for s, _ in starts], [d for _, d in starts], [c.state for c in cutters], [c.delimiter for c in cutters], numbers, [bool(c.parts) for c in cutters]]
            kinds = (pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "s", "d", "state", "delimiter", "n", "open"])

        for r in lines.mapInArrow(scan, "part int, s binary, d binary, state binary, delimiter binary, n long, open boolean").collect() if todo else []:  # a few rows per split
            known[r.part, bytes(r.s), bytes(r.d)] = bytes(r.state), bytes(r.delimiter), r.n, r.open
        out, state, going, tails = {}, (b"", b";"), -1, False
        for p in range(count):
            out[p] = (*state, going)
            if (p, *state) not in known:
                break
            open_state, delimiter, n, is_open = known[p, *state]
            if is_open and (n or going < 0):
                going = (p << 33) + n - (going >= 0)
            elif not is_open and n:
                going = -1
            tails = tails or is_open
            state = open_state, delimiter
        else:
            if state[0]:
                raise DumpError(f"the dump ends within {state[0].decode()}")
            return out, tails
        todo = {q: new for q in range(p, count) if (new := [(s, state[1]) for s in (b"", *_CLOSED) if (q, s, state[1]) not in known])}


def read_rows(statements_: DataFrame) -> DataFrame:
    """(ord, row, tbl, columns, body, values) of every tuple of every INSERT; columns null where the statement has no list."""
    layout = pa.schema([("ord", pa.int64()), ("row", pa.int32()), ("tbl", pa.string()), ("columns", pa.list_(pa.string())), ("body", pa.binary()), ("values", pa.list_(pa.struct([("kind", pa.string()), ("raw", pa.binary())]))), ("tail", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw, tbl in zip(*(batch.column(c).to_pylist() for c in ("ord", "raw", "tbl")), strict=True):
                columns, found_rows = tuples(raw)
                rows = list(found_rows)
                tail = tail_of(raw, [body for body, _ in rows])
                held = [{"ord": number, "row": i, "tbl": tbl, "columns": columns, "body": body, "values": [{"kind": k, "raw": v} for k, v in found], "tail": tail} for i, (body, found) in enumerate(rows)]
                for at in range(0, len(held), 2000):
                    yield pa.RecordBatch.from_pylist(held[at : at + 2000], schema=layout)

    return statements_.where("kind = 'insert'").select("ord", "raw", "tbl").mapInArrow(work, ROW)


_TABLE_KEYS = re.compile(rb"(?:PRIMARY|UNIQUE|FULLTEXT|SPATIAL|KEY|INDEX|CONSTRAINT|FOREIGN|CHECK|PERIOD)\b", re.I)
_COLUMN_END = re.compile(rb"\s+(?:NOT\s+NULL|NULL|DEFAULT|AUTO_INCREMENT|COMMENT|PRIMARY|UNIQUE|KEY|COLLATE|CHARACTER\s+SET|CHARSET|CHECK|GENERATED|AS|ON\s+UPDATE|REFERENCES|VIRTUAL|STORED|INVISIBLE)\b", re.I)


def declared_columns(create: bytes) -> list[tuple[str, str]]:
    """(name, type) of a CREATE TABLE's columns; the type is text as it stands."""
    body = create[create.index(b"(") + 1 :]
    depth, start, parts = 0, 0, []
    for found in re.finditer(_STRING + rb"|`(?:[^`]|``)*`|[(),]", body, re.S):
        c = found[0]
        depth += (c == b"(") - (c == b")")
        if depth < 0 or (c == b"," and depth == 0):
            parts.append(body[start : found.start()].strip())
            start = found.end()
            if depth < 0:
                break
    out = []
    for part in parts:
        if part and not _TABLE_KEYS.match(part) and (found := re.match(rb"(" + _PART + rb")\s+(.*)", part, re.S)):
            kind = _COLUMN_END.split(found[2], maxsplit=1)[0].strip()
            out.append((plain_name(found[1]), kind.decode("utf-8", "replace")))
    return out


def named_values(rows: DataFrame, statements_: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """(ord, row, tbl, bytes, values map<string,string>): the wanted columns of each tuple by lower-case name, decoded.

    Names come from the INSERT or else from CREATE TABLE; tuples of another length have a null map. Values that are
    NULL or can't be decoded are null.
    """
    wanted = tuple(w.lower() for w in wanted)

    def declare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("tbl"), pa.array([[n for n, _ in declared_columns(x)] for x in batch.column("raw").to_pylist()], pa.list_(pa.string()))], ["tbl", "declared"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for columns, values in zip(batch.column("names").to_pylist(), batch.column("values").to_pylist(), strict=True):
                if columns is None or len(columns) != len(values):
                    maps.append(None)
                    continue
                own = {}
                for name, v in zip(columns, values, strict=True):
                    if (low := name.lower()) in wanted:
                        raw = decode(v["kind"], v["raw"]) if v["kind"] in ("string", "number", "hex") else None
                        own[low] = None if raw is None else raw.decode("utf-8", "replace")
                maps.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ord", "row", "tbl", "bytes")), pa.array([None if m is None else list(m.items()) for m in maps], pa.map_(pa.string(), pa.string()))], ["ord", "row", "tbl", "bytes", "values"])

    declared = statements_.where("kind = 'create_table'").select("tbl", "raw").mapInArrow(declare, "tbl string, declared array<string>").dropDuplicates(["tbl"])
    named = rows.join(declared, "tbl", "left").select("ord", "row", "tbl", F.length("body").cast("long").alias("bytes"), F.coalesce("columns", "declared").alias("names"), "values")
    return named.mapInArrow(work, "ord long, row int, tbl string, bytes long, values map<string,string>")


def insert_statements(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(tbl, first_ord, first_row, n, raw): rows (ord, row, tbl, columns, body) packed into INSERTs of at most `most` bytes, one row at least.

    Rows are dealt by ranges of table and place, so each task packs neighbouring rows; rows of one statement list the same
    columns. A clause after the tuples, such as ON DUPLICATE KEY UPDATE, holds for a statement as a whole: one that
    would have to be cut raises DumpError.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, first = None, [], 0, (0, 0)

        def out() -> pa.RecordBatch:
            tbl, columns = key[:2]
            names = b"" if columns is None else b" (" + b", ".join(b"`" + c.replace("`", "``").encode() + b"`" for c in columns) + b")"
            raw = b"INSERT INTO `" + tbl.replace("`", "``").encode() + b"`" + names + b" VALUES\n" + b",\n".join(held) + (b" " + key[2] if key[2] else b"") + b";\n"
            return pa.RecordBatch.from_arrays([pa.array([tbl]), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([raw], pa.binary())], ["tbl", "first_ord", "first_row", "n", "raw"])

        for batch in batches:
            for number, row, tbl, columns, body, tail in zip(*(batch.column(c).to_pylist() for c in ("ord", "row", "tbl", "columns", "body", "tail")), strict=True):
                own = (tbl, None if columns is None else tuple(columns), tail, number if tail else None)
                if held and own == key and tail and size + len(body) + 2 > most:
                    raise DumpError(f"the clause after the rows of statement {number} allows no cut")
                if held and (own != key or size + len(body) + 2 > most):
                    yield out()
                    held, size = [], 0
                if not held:
                    key, first, size = own, (number, row), len(tbl) + 24
                held.append(body)
                size += len(body) + 2
        if held:
            yield out()

    ordered = rows.repartitionByRange("tbl", "ord").sortWithinPartitions("tbl", "ord", "row").select("ord", "row", "tbl", "columns", "body", "tail")
    return ordered.mapInArrow(work, "tbl string, first_ord long, first_row int, n int, raw binary")


def literal(column: str, kind: str, breaks: bool = False):
    """A column as a dump's literal, as bytes of text: numbers plain, strings quoted and escaped (line breaks as they are, if asked for), null NULL."""
    c = F.col(column)
    if kind == "string":
        text = F.regexp_replace(c, r"([\\'])", r"\\$1")
        text = text if breaks else F.regexp_replace(text, "\n", r"\\n")
        return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def to_dump(df: DataFrame, tbl: str, rows_per_statement: int = 500, breaks: bool = False) -> DataFrame:
    """(value string): statements, without the last semicolon and line break, that hold the rows of df in its column order."""
    kinds = dict(df.dtypes)
    body = F.concat(F.lit("("), F.concat_ws(",", *[literal(c, kinds[c], breaks) for c in df.columns]), F.lit(")"))
    numbered = df.select(body.alias("body"), (F.monotonically_increasing_id() / rows_per_statement).cast("long").alias("part"))
    names = ", ".join(f"`{c}`" for c in df.columns)
    return numbered.groupBy("part").agg(F.concat(F.lit(f"INSERT INTO `{tbl}` ({names}) VALUES "), F.array_join(F.collect_list("body"), ",")).alias("value")).select("value")
