"""What every other table keeps, given the kept entities (id). Where tables of several sites lie together, `scope` names the columns that tell them apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ids import glob_matches

from . import closure


def any_glob(column: Column, globs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (glob_matches(column, g) for g in globs), F.lit(False))


def keep_meta(meta: DataFrame, keep: DataFrame, exclude: tuple[str, ...] = (), key: str = "post_id", scope: tuple[str, ...] = ()) -> DataFrame:
    """Meta rows of kept entities, without keys that match a glob. A null key counts as empty."""
    return meta.where(~any_glob(F.coalesce("meta_key", F.lit("")), exclude)).join(keep.select(*scope, F.col("id").alias(key)), [*scope, key], "left_semi")


def prune_terms(term: DataFrame, relationship: DataFrame, keep: DataFrame, over: int, key: str = "term_id", scope: tuple[str, ...] = ()) -> DataFrame:
    """All terms, but of a flat taxonomy with more than `over` terms only those that kept entities use. Taxonomies without any parent value count as not flat, as SQL's three values have it."""
    kind = [*scope, "taxonomy"]
    flat = term.groupBy(*kind).agg(F.count("*").alias("n"), F.bool_or(F.col("parent") > 0).alias("tree")).where((F.col("n") > over) & ~F.col("tree")).select(*kind, F.lit(True).alias("big_flat"))
    used = relationship.join(keep.select(*scope, F.col("id").alias("object_id")), [*scope, "object_id"], "left_semi").select(*scope, key).distinct().withColumn("used", F.lit(True))
    return term.join(flat, kind, "left").join(used, [*scope, key], "left").where("big_flat is null or used").select(*term.columns)


def keep_relationships(relationship: DataFrame, terms: DataFrame, keep: DataFrame, whole_taxonomy: str, key: str = "term_id", scope: tuple[str, ...] = ()) -> DataFrame:
    """Relationships of kept terms, with their taxonomy: those with kept entities, and all of a taxonomy whose objects are all kept."""
    flag = keep.select(*scope, F.col("id").alias("object_id")).distinct().withColumn("kept", F.lit(True))
    kinds = terms.select(*scope, key, "taxonomy").distinct()
    own = relationship.select(*(c for c in relationship.columns if c != "taxonomy"))
    found = own.join(kinds, [*scope, key]).join(flag, [*scope, "object_id"], "left").where((F.col("taxonomy") == whole_taxonomy) | F.col("kept"))
    return found.select(*own.columns, "taxonomy")


def keep_users(user: DataFrame, entity: DataFrame, keep: DataFrame, holders: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Authors of kept entities, and the holders (id) of listed roles."""
    authors = entity.join(keep.select(*scope, "id"), [*scope, "id"], "left_semi").select(F.col("author").alias("id"))
    return user.join(authors.unionByName(holders).distinct(), "id", "left_semi")


#: Keys that are broadcast as they are, keys that a filter is made of, and the filter's bits for each.
BROADCAST_KEYS, FILTERED_KEYS, KEY_BITS = 100_000, 1 << 25, 8
_MAP_BITS = 1 << 15  # of one row of a bitmap


def slim(rows: DataFrame, keep: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is kept."""
    return semi_join(rows, keep, [key] if isinstance(key, str) else key)


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], broadcast: int = BROADCAST_KEYS, filtered: int = FILTERED_KEYS) -> DataFrame:
    """Rows whose columns `on` are among `keys`; null is never among them.

    Few keys are broadcast. Of more, a filter is: a bitmap of their hashes, KEY_BITS a key, made by an aggregate, which
    lets an eighth or less of other rows pass, so only what is likely to stay is shuffled for the exact join. Past `filtered` keys both sides are.
    """
    keys = closure.saved(keys.select(*on).distinct())
    n = keys.count()
    if n <= broadcast:
        return rows.join(F.broadcast(keys), on, "left_semi")
    if n > filtered:
        return rows.join(keys, on, "left_semi")
    kinds = dict(keys.dtypes)
    place = F.pmod(F.xxhash64(*(F.col(c).cast(kinds[c]) for c in on)), F.lit(n * KEY_BITS))
    bucket, bit = F.floor(place / _MAP_BITS).alias("__bucket"), (place % _MAP_BITS).alias("__bit")
    maps = keys.select(bucket, bit).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))  # n bytes in all
    byte = F.conv(F.hex(F.substring("__map", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = rows.select("*", bucket, bit).join(F.broadcast(maps), "__bucket").where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1)
    return likely.drop("__bucket", "__bit", "__map").join(keys, on, "left_semi").select(*rows.columns)


def reconcile(planned: DataFrame, written: DataFrame) -> DataFrame:
    """(tbl, planned, written, ok) for every table of either count; approximate plans are always ok."""
    both = planned.join(written, "tbl", "full")
    return both.select("tbl", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("written", F.lit(0)).alias("written")).withColumn("ok", F.col("planned") == F.col("written"))
