"""Ids, globs and labels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_id(column: Column | str) -> Column:
    """A positive id of 1 to 18 digits, without sign or blank; else null."""
    c = F.col(column) if isinstance(column, str) else column
    value = F.when(c.rlike("^[0-9]{1,18}$"), c.try_cast("bigint"))
    return F.when(value > 0, value)


def glob_regex(glob: str) -> str:
    """The anchored regular expression of a glob in which * is any run of characters and all else is itself."""
    return "(?s)^" + ".*".join(re.escape(part) for part in glob.split("*")) + "$"


def glob_matches(column: Column, glob: str) -> Column:
    head, star, tail = glob.partition("*")
    if not star:
        return column == glob
    if not tail:
        return column.startswith(head)
    return column.rlike(glob_regex(glob))


def list_ids(column: Column | str) -> Column:
    """Ids of an integer, or of a list such as 1,2,3 or [1,"2",'3'] with at least one comma; one bad element gives none. At most 1000."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    bare = F.when(c.startswith("[") & c.endswith("]"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    parts = F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    ids = F.transform(parts, parse_id)
    many = F.when(c.contains(",") & F.forall(ids, lambda x: x.isNotNull()), F.slice(ids, 1, 1000))
    one = parse_id(c)
    return F.coalesce(F.when(one.isNotNull(), F.array(one)), many, F.array().cast("array<bigint>"))


def name_pattern(column: Column | str) -> Column:
    """The name with each run of digits and points that begins with a digit as *."""
    return F.regexp_replace(column, "[0-9][0-9.]*", "*")


def format_bytes(n: int) -> str:
    """1024-based; megabytes and gigabytes with one decimal."""
    if n >= 1 << 30:
        return f"{n / (1 << 30):.1f} GB"
    if n >= 1 << 20:
        return f"{n / (1 << 20):.1f} MB"
    if n >= 1 << 10:
        return f"{n // (1 << 10)} KB"
    return f"{n} B"
