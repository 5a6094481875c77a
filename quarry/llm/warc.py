"""WARC archives of pages and a globally ordered capture index.

Payloads of at least MIN_REVISIT bytes that occur more than once are stored with the largest page id alone; the other
captures become revisit records that refer to it. Each task writes archives of about ARCHIVE_BYTES, a gzip member
per record, into a table in the shared folder. Reading parses the stored bytes again and checks lengths and
digests. Each archive gives a run of index entries, sorted by URL key and time and numbered; the runs are dealt out by
ranges of (key, time, id) and are not sorted again: in each range a loser tree merges what every run has there. Range
after range this is the order of all captures, a URL's history lies together, and a hot URL is spread by its times.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, slices, stash, table, texts

MIN_REVISIT = 1000
ARCHIVE_BYTES = 1 << 20
#: Digests of repeated payloads that are broadcast: with as many or fewer no html is shuffled. More are joined.
BROADCAST_KEEPERS = 1 << 18
#: Bytes that are unpacked at one time, tasks that copies of one payload are dealt to, entries of a range, of a run that
#: are looked at, and of an output batch.
_PIECE, SALTS, RANGE_ENTRIES, PEEK, OUT_ROWS = 1 << 14, 32, 1_000_000, 256, 10_000
FIRST = datetime(2020, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def url_key(url: str | None) -> str:
    """The host's labels from the right, then the rest: com,example)/path?query. Null is empty."""
    head, found, rest = (url or "").partition("://")
    rest = rest if found else head
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].partition("#")[0]
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/") if url else ""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the response's HTTP header, hence its length, and no payload."""
    date = (FIRST + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    fields += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive's bytes. Raises ValueError where a length or a digest is wrong."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof and end < len(data):  # piece by piece: what is left over of a piece is copied
            parts.append(member.decompress(view[end : end + _PIECE]))
            end = min(len(data), end + _PIECE)
        raw = b"".join([*parts, member.flush()])
        size = end - at - len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"no whole record at {at}")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.rpartition(b"Content-Length: ")[2])
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload differs at {at}")
        page = fields["WARC-Record-ID"][1:-1].removeprefix(URN)
        to = fields.get("WARC-Refers-To")
        yield {
            "url_key": url_key(fields.get("WARC-Target-URI")), "captured": fields["WARC-Date"], "page_id": int(page) if page else None, "offset": at, "length": size,
            "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": int(to[1:-1].removeprefix(URN)) if to else None,
        }
        at += size


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, data binary): the stored archives of pages (page_id, url, html). Null html is an empty payload."""
    own = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    own = own.withColumn("digest", F.sha1("html"))
    large = own.where(F.length("html") >= MIN_REVISIT)
    keepers = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    keepers = stash(keepers, "warc-keepers")
    if keepers.count() <= BROADCAST_KEEPERS:
        marked = own.join(F.broadcast(keepers), "digest", "left")
    else:
        # A small payload is nobody's copy: its key is its own, so that they are dealt evenly. A payload that repeats often is dealt to SALTS places.
        dealt = keepers.select(F.col("digest").alias("join_key"), "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        key = F.when(F.length("html") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), row_id().cast("string")))
        marked = own.withColumn("join_key", key).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["join_key", "salt"], "left")
    marked = marked.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

        for part in slices(batches, "html", ARCHIVE_BYTES):
            for page, url, html, digest, to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url")), texts(part, "html"), *(part.column(c).to_pylist() for c in ("digest", "refers_to")), strict=True):
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, html, digest, to)) + packer.flush()
                if size + len(member) > ARCHIVE_BYTES and held:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(member)
                size += len(member)
        if held:
            yield out()

    return stash(marked.mapInArrow(work, "archive string, data binary"), "warc")


#: An index entry; `place` is its place in its archive's run.
ENTRY = "url_key string, captured string, page_id long, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long, place long"


def order_of(url_key: str, captured: str, page_id: int | None) -> tuple:
    """What captures are ordered by; null ids come first."""
    return url_key, captured, page_id is not None, page_id or 0


def read_runs(archives: DataFrame) -> DataFrame:
    """The index entries of every archive, each archive's sorted by URL key, time and id."""
    layout = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in ENTRY.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data", ARCHIVE_BYTES):
            for archive, data in zip(part.column("archive").to_pylist(), part.column("data").to_pylist(), strict=True):
                run = sorted(parse(data), key=lambda x: order_of(x["url_key"], x["captured"], x["page_id"]))
                yield pa.RecordBatch.from_pylist([x | {"archive": archive, "place": n} for n, x in enumerate(run)], schema=layout)

    return archives.mapInArrow(work, ENTRY)


def loser_tree_merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in order. Each inner node holds the run that lost there, so an item costs one climb."""
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]

    def before(a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; runs at their end go last, equal heads by run."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * k  # losers[0] is the winner of all
    for leaf in range(k - 1, -1, -1):
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            if losers[node] < 0:
                losers[node] = winner
                break
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        else:
            losers[0] = winner
    while k and heads[losers[0]] is not None:
        winner = losers[0]
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        node = (winner + k) // 2
        while node > 0:
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def merge_index(runs: DataFrame) -> DataFrame:
    """The entries of all runs in the order of (url_key, captured, page_id), range after range.

    Ranges are cut by key, time and id, so a range has about RANGE_ENTRIES at most, however often a URL was captured. A
    task holds its range's parts of the runs as Arrow batches, puts each run's entries side by side by archive and place
    (two numbers), and looks at the PEEK entries of each run that come next. Keys are compared by the loser tree alone.
    """
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.count() // RANGE_ENTRIES + 1)
    ranged = runs.repartitionByRange(ranges, "url_key", "captured", "page_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        entries = pa.Table.from_batches(held).combine_chunks()
        names = entries.column("archive").combine_chunks().dictionary_encode().indices.to_numpy()
        by_run = np.lexsort((entries.column("place").to_numpy(), names))
        names = names[by_run]
        starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]

        def run(start: int, end: int) -> Iterator[tuple]:
            for at in range(start, end, PEEK):
                rows = by_run[at : min(at + PEEK, end)]
                part = entries.select(["url_key", "captured", "page_id"]).take(pa.array(rows))
                for row, *fields in zip(rows.tolist(), *(c.to_pylist() for c in part.columns), strict=True):
                    yield *order_of(*fields), row

        order: list[int] = []
        for entry in loser_tree_merge([run(a, b) for a, b in zip(starts, starts[1:], strict=False)]):
            order.append(entry[-1])
            if len(order) == OUT_ROWS:
                yield from entries.take(pa.array(order, pa.int64())).combine_chunks().to_batches()
                order = []
        if order:
            yield from entries.take(pa.array(order, pa.int64())).combine_chunks().to_batches()

    return ranged.mapInArrow(work, ENTRY).drop("place")


def captures(pages: DataFrame) -> DataFrame:
    """Archive pages (page_id, url, html), read the archives back, and return the ordered index of all captures.

    One row per row of pages. Null url: an empty key and no target field. Equal payloads with equal largest ids are all
    responses. An empty table gives no rows; other columns of pages are not archived.
    """
    return merge_index(stash(read_runs(write_archives(pages)), "warc-runs"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """One row per page, read back from the archives. Null html is empty; rows that repeat each have their record, and of equal large payloads that with the largest page_id is the response."""
    return captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


#: The URL key and the time are this store's own; SQL makes both from the same row.
OP4_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest),
u AS (SELECT *, position('://' IN url) AS at, substr(url, position('://' IN url) + 3) AS rest FROM d),
h AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS host, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM u)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h.digest AS payload_digest,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to,
  list_aggregate(list_reverse(string_split(lower(host), '.')), 'string_agg', ',') || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END AS url_key,
  strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM h LEFT JOIN k ON h.digest = k.digest
"""
