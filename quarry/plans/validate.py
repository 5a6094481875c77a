"""Checks of a copy against its source, and the gate that only a copy without failures passes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import checks, closure
from quarry.operators.checks import FAIL, PASS, WARNING

from .subset import Index, field_keys


@dataclass(frozen=True)
class Check:
    """A check's result: a count, never values."""

    name: str
    status: str
    count: int = 0
    detail: str = ""


def _counted(name: str, rows: DataFrame, status: str, detail: str) -> Check:
    n = rows.count()
    return Check(name, status if n else PASS, n, detail if n else "")


def reference_checks(copy: Index, source: Index) -> list[Check]:
    """Orphans fail; a target that was in the source and is gone fails, one that never was warns."""
    posts = copy.posts.select("site", "id")
    out = [
        _counted("post meta points at existing posts", copy.postmeta.join(posts.withColumnRenamed("id", "post_id"), ["site", "post_id"], "left_anti"), FAIL, "meta rows of posts that are not in the copy"),
        _counted("term relationships point at existing terms", copy.term_relationships.join(copy.term_taxonomy.select("site", "term_taxonomy_id"), ["site", "term_taxonomy_id"], "left_anti"), FAIL, "relationships of terms that are not in the copy"),
    ]
    out.append(_counted("comments are removed", copy.comments.select("site").unionByName(copy.commentmeta.select("site")), FAIL, "rows of comments or of their meta"))
    # Only taxonomies that have posts as objects: others relate terms to other rows.
    placed = copy.term_relationships.join(copy.term_taxonomy.select("site", "term_taxonomy_id", "taxonomy"), ["site", "term_taxonomy_id"]).where("taxonomy <> 'link_category'")
    objects = posts.withColumnRenamed("id", "object_id")
    of_posts = placed.join(objects, ["site", "object_id"], "left_semi").select("site", "taxonomy").distinct()
    out.append(_counted("term relationships point at existing posts", placed.join(of_posts, ["site", "taxonomy"], "left_semi").join(objects, ["site", "object_id"], "left_anti"), FAIL, "relationships of posts that are not in the copy"))
    thumbnails = copy.meta_refs.where("meta_key = '_thumbnail_id'").select("site", "ref_id")
    targets = copy.menu.where("type = 'post_type'").select("site", F.col("object_id").try_cast("bigint").alias("ref_id")).where("ref_id > 0")
    media = copy.meta_refs.join(field_keys(source, ("image", "file")), ["site", "meta_key"], "left_semi").select("site", "ref_id")
    for name, refs in (("featured images exist", thumbnails), ("menu item targets exist", targets), ("image and file fields exist", media)):
        lost = refs.distinct().join(posts.withColumnRenamed("id", "ref_id"), ["site", "ref_id"], "left_anti")
        found = lost.join(source.posts.select("site", F.col("id").alias("ref_id"), F.lit(1).alias("was")), ["site", "ref_id"], "left").agg(F.count("was").alias("was"), F.count("*").alias("n")).first()
        never = found.n - found.was
        status = FAIL if found.was else WARNING if never else PASS
        out.append(Check(name, status, found.was or never, f"{found.was} targets were in the source but not kept; {never} were never there" if found.n else ""))
    return out


def personal_checks(frames: dict[str, DataFrame], allowed_domains: tuple[str, ...] = (), allowed_emails: tuple[str, ...] = ()) -> list[Check]:
    """Emails and addresses in columns named for them fail; emails within other texts warn. One pass over each frame."""
    domains = checks.ALLOWED_DOMAINS + allowed_domains
    totals = {"emails": {}, "addresses": {}, "content": {}}
    for name, df in frames.items():
        emails, addresses = checks.personal_columns(df.dtypes)
        others = [n for n, kind in df.dtypes if kind == "string" and n not in emails + addresses]
        tests = {f"emails {c}": checks.email_not_allowed(F.col(c), domains, allowed_emails) for c in emails}
        tests |= {f"addresses {c}": checks.ip_not_allowed(F.col(c)) for c in addresses}
        tests |= {f"content {c}": checks.email_inside(F.col(c)) for c in others}
        for row in checks.breakdown(df, tests).collect() if tests else []:
            kind, column = row.label.split(" ", 1)
            totals[kind][f"{name}.{column}"] = row.n
    said = (("no email addresses outside the allowed patterns", "emails", FAIL), ("no IP addresses outside the allowed ranges", "addresses", FAIL), ("no email addresses in content", "content", WARNING))
    return [Check(title, status if totals[kind] else PASS, sum(totals[kind].values()), ", ".join(sorted(totals[kind]))) for title, kind, status in said]


def plan_checks(copy: Index, source: Index, page: int) -> list[Check]:
    """Lost second pages and references that never led anywhere warn; authors that are gone fail."""
    key = F.struct("site", "term_taxonomy_id")
    lost = checks.second_page(
        source.term_relationships.select(F.struct("site", "object_id").alias("object_id"), key.alias("term_id")), copy.posts.select(F.struct("site", "id").alias("id")), source.term_taxonomy.select(key.alias("term_id"), "taxonomy"), page
    )
    refs = copy.meta_refs.where("meta_key in ('_thumbnail_id')").select("site", F.col("meta_key").alias("source"), "ref_id").unionByName(copy.content_refs.select("site", "source", "ref_id"))
    never = refs.join(source.posts.select("site", F.col("id").alias("ref_id")), ["site", "ref_id"], "left_anti")
    return [
        _counted("archives have a second page", lost, WARNING, "terms with a second page in the source and none in the copy"),
        _counted("references lead to posts of the source", never, WARNING, "references to posts that were never there"),
        _counted("authors exist", checks.authors_missing(copy.posts, copy.users), FAIL, "posts of users that are not in the copy"),
    ]


def status(found: list[Check]) -> str:
    return checks.worst([c.status for c in found])


def export(statements: DataFrame, found: list[Check], path: str) -> bool:
    """Write the copy's statements (place, raw) as one local file, if no check failed: first beside it, then renamed. A copy that nothing checked is refused."""
    if not found:
        raise ValueError("a copy is written only after checks")
    if status(found) == FAIL:
        return False
    write_in_order(statements, path)
    return True


def write_in_order(statements: DataFrame, path: str) -> int:
    """Write `raw` by `place` as the file `path`, by all tasks at once; its size.

    Partitions hold ranges of places. Their sizes, a number each, tell where each begins; every task writes its bytes at
    its place of one file beside `path`, which is renamed when all are done. A task that runs again writes the same
    bytes. On a cluster the folder must be one that driver and executors share.
    """
    ordered = closure.saved(statements.select("place", "raw").repartitionByRange("place").sortWithinPartitions("place"))
    sizes = ordered.select(F.spark_partition_id().alias("part"), F.length("raw").alias("size")).groupBy("part").agg(F.sum("size").alias("size")).collect()  # a row per partition
    starts, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        starts[r.part], total = total, total + r.size
    aside = path + ".part"
    with open(aside, "wb") as out:
        out.truncate(total)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        if part in starts:
            with open(aside, "r+b") as out:
                out.seek(starts[part])
                for batch in batches:
                    for raw in batch.column("raw").to_pylist():
                        n += out.write(raw)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    written = sum(r.n for r in ordered.select("raw").mapInArrow(put, "n long").collect())
    if written != total:
        raise OSError(f"{written} of {total} bytes are written")
    os.replace(aside, path)
    return total
