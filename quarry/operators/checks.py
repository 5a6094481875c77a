"""Checks of a reduced copy: references, personal data, counts. They tell numbers, never values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domains that the scrubber leaves, and addresses that are no one's.
ALLOWED_DOMAINS = ("example.com", "example.org", "example.net")
EMAIL = "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(\\.[A-Za-z0-9-]{1,63}){0,8}\\.[A-Za-z]{2,24}"
IPV4 = "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"
IP_COLUMN = "(^|_)ip($|_)|ip_?address"
TEST_NETS = ("192.0.2.", "198.51.100.", "203.0.113.")

PASS, WARNING, FAIL = "pass", "warning", "fail"
_RANK = {PASS: 0, WARNING: 1, FAIL: 2}


def worst(statuses: list[str]) -> str:
    """fail over warning over pass."""
    return max(statuses, key=_RANK.__getitem__, default=PASS)


def email_not_allowed(column: Column, domains: tuple[str, ...] = ALLOWED_DOMAINS, emails: tuple[str, ...] = ()) -> Column:
    """Has an @, and neither its domain after the last @ nor itself is allowed, whatever the case."""
    found = column.contains("@") & ~F.lower(F.substring_index(column, "@", -1)).isin(*[d.lower() for d in domains])
    return found & ~F.lower(column).isin(*[e.lower() for e in emails]) if emails else found


def ip_not_allowed(column: Column) -> Column:
    """A dotted quad or anything with a colon, but no loopback and no documentation net."""
    shaped = column.rlike(IPV4) | column.contains(":")
    return shaped & ~column.isin("127.0.0.1", "::1", "0.0.0.0") & ~reduce(lambda a, b: a | b, (column.startswith(n) for n in TEST_NETS))


def email_inside(column: Column) -> Column:
    return column.contains("@") & column.rlike(EMAIL)


def personal_columns(columns: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The text columns whose names say that they hold an email or an IP address, from (name, type)."""
    texts = [n for n, kind in columns if kind == "string"]
    return [n for n in texts if "email" in n.lower()], [n for n in texts if re.search(IP_COLUMN, n.lower())]


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; rows without a key are none."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def missing_targets(meta: DataFrame, key: str, kept: DataFrame, source: DataFrame) -> DataFrame:
    """(in_source, never) numbers of distinct targets of `key` that are not kept: those that were in the source, and those that never were."""
    from quarry.functions.ids import parse_id

    targets = meta.where(F.col("meta_key") == key).select(parse_id("value").alias("id")).where("id is not null").distinct()
    missing = targets.join(kept.select("id"), "id", "left_anti")
    found = missing.join(source.select("id").distinct().withColumn("was", F.lit(1)), "id", "left")
    return found.agg(F.count_if(F.col("was") == 1).alias("in_source"), F.count_if(F.col("was").isNull()).alias("never"))


def never_in_source(refs: DataFrame, entity: DataFrame, count: int = 5) -> DataFrame:
    """The sources (source, ref_id) with most references to rows that never were."""
    lost = refs.where("ref_id > 0").join(entity.select(F.col("id").alias("ref_id")), "ref_id", "left_anti")
    return lost.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(count)


def authors_missing(entity: DataFrame, user: DataFrame) -> DataFrame:
    """Entities whose author is set but is no user."""
    return entity.where("author > 0").join(user.select(F.col("id").alias("author")), "author", "left_anti")


def second_page(relationship: DataFrame, keep: DataFrame, term: DataFrame, page: int) -> DataFrame:
    """Terms with over `page` entities in the source of which the copy has `page` or fewer, so that a second page is lost."""
    source = relationship.groupBy("term_id").agg(F.count("*").alias("n"))
    kept = relationship.join(keep.select(F.col("id").alias("object_id")), "object_id", "left_semi").groupBy("term_id").agg(F.count("*").alias("kept"))
    both = source.where(F.col("n") > page).join(kept, "term_id", "left").join(term.select("term_id", "taxonomy"), "term_id")
    return both.select("taxonomy", "term_id", "n", F.coalesce("kept", F.lit(0)).alias("kept")).where(F.col("kept") <= page)


def breakdown(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(label, n) for each test that any row fails: one pass over the rows."""
    counted = rows.agg(*[F.count_if(test).alias(label) for label, test in tests.items()])
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"`{label}`").alias("n")) for label in tests])
    return counted.select(F.explode(pairs).alias("p")).select("p.label", "p.n").where("n > 0")
