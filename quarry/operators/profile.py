"""Profiles: what is in the tables, how large it is, and where references lead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def type_profile(entity: DataFrame) -> DataFrame:
    """Per site and type: rows, first and last day, average and total bytes."""
    day = "yyyy-MM-dd"
    return entity.groupBy("site", "type").agg(
        F.count("*").alias("n"), F.date_format(F.min("date"), day).alias("first_day"), F.date_format(F.max("date"), day).alias("last_day"),
        F.round(F.avg("bytes")).cast("long").alias("avg_bytes"), F.sum("bytes").alias("bytes"),
    )


def status_profile(entity: DataFrame) -> DataFrame:
    return entity.groupBy("site", "type", "status").agg(F.count("*").alias("n"))


def taxonomy_profile(term: DataFrame) -> DataFrame:
    return term.groupBy("taxonomy").agg(F.count("*").alias("terms"), F.bool_or(F.col("parent") > 0).alias("hierarchical"))


def taxonomy_by_type(relationship: DataFrame, term: DataFrame, entity: DataFrame) -> DataFrame:
    """Relationships per taxonomy and type of the object, with a bucket for objects that are missing."""
    objects = entity.select(F.col("id").alias("object_id"), "type")
    rows = relationship.join(term.select("term_id", "taxonomy"), "term_id").join(objects, "object_id", "left")
    return rows.groupBy("taxonomy", F.coalesce("type", F.lit("(missing)")).alias("type")).agg(F.count("*").alias("n"))


def top_per_taxonomy(relationship: DataFrame, term: DataFrame, count: int = 5) -> DataFrame:
    """The `count` most used terms of each taxonomy; ties by name, nameless last, then by id."""
    counted = relationship.groupBy("term_id").agg(F.count("*").alias("n")).join(term.select("term_id", "taxonomy", "name"), "term_id")
    order = Window.partitionBy("taxonomy").orderBy(F.col("n").desc(), F.col("name").asc_nulls_last(), "term_id")
    return counted.withColumn("rn", F.row_number().over(order).cast("long")).where(F.col("rn") <= count)


def reference_resolution(meta: DataFrame, entity: DataFrame, count: int = 30) -> DataFrame:
    """The keys with most references: how many there are and how many lead to a row."""
    targets = entity.select(F.col("id").alias("ref_id"), F.lit(1).alias("there"))
    refs = meta.where("ref_id is not null").groupBy("meta_key", "ref_id").agg(F.count("*").alias("n"))  # fewer rows before the join
    found = refs.join(targets, "ref_id", "left").groupBy("meta_key").agg(F.sum("n").alias("refs"), F.coalesce(F.sum(F.when(F.col("there") == 1, F.col("n"))), F.lit(0)).alias("resolved"))
    return found.where("resolved > 0").orderBy(F.col("refs").desc(), "meta_key").limit(count)


def name_patterns(names: DataFrame, least_bytes: int) -> DataFrame:
    """Names (name, bytes) with digits as *, by pattern; patterns of over `least_bytes`."""
    from quarry.functions.ids import name_pattern

    return names.groupBy(name_pattern("name").alias("pattern")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("bytes") > least_bytes)


def type_report(entity: DataFrame, keep: DataFrame, meta: DataFrame) -> DataFrame:
    """Per site and type: rows and bytes, kept rows and bytes, and bytes of meta of kept rows. Meta is summed per row first; by site where it has one."""
    key = ["site", "id"] if "site" in meta.columns else ["id"]
    kept = keep.select("site", "id").distinct().withColumn("kept", F.lit(True))
    meta_bytes = meta.withColumnRenamed("post_id", "id").groupBy(*key).agg(F.sum("bytes").alias("meta_bytes"))
    rows = entity.join(kept, ["site", "id"], "left").join(meta_bytes, key, "left")
    return rows.groupBy("site", "type").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("kept").alias("kept_n"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).alias("kept_bytes"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("meta_bytes"))), F.lit(0)).alias("kept_meta_bytes"),
    )


def size_estimate(parts: dict[str, DataFrame]) -> DataFrame:
    """(tbl, n, bytes) of the kept rows of each table."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("tbl"), "n", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def added_by_reason(keep: DataFrame) -> DataFrame:
    return keep.where("depth > 0").groupBy("site", "reason").agg(F.count("*").alias("n"))
