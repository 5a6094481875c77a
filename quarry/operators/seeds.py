"""Choice of the first rows to keep: newest per type, newest of a status, newest per term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(entity: DataFrame, count: int | None, reason: str) -> DataFrame:
    """(site, id, reason) of the newest `count` rows, all if None. Undated rows are oldest; ties go to larger ids."""
    if count is not None:
        entity = entity.orderBy(F.col("date").desc_nulls_last(), F.col("id").desc()).limit(count)
    return entity.select("site", "id", F.lit(reason).alias("reason"))


def newest_per_type(entity: DataFrame, rules: DataFrame) -> DataFrame:
    """One pass for all sites and types: rules (site, type, status, count, reason), count null for all.

    Row numbers are per rule, so rules may overlap; Spark prunes groups before the shuffle where counts allow.
    """
    joined = entity.join(F.broadcast(rules), ["site", "type", "status"]) if "status" in rules.columns else entity.join(F.broadcast(rules), ["site", "type"])
    order = Window.partitionBy("site", "reason").orderBy(F.col("date").desc_nulls_last(), F.col("id").desc())
    return joined.withColumn("rn", F.row_number().over(order)).where("count is null or rn <= count").select("site", "id", "reason")


def top_terms(eligible: DataFrame, relationship: DataFrame, term: DataFrame, max_terms: int | None, by_name: bool = False) -> DataFrame:
    """(term_id, n): the terms with most eligible entities, or the first by name."""
    counted = relationship.join(eligible.select(F.col("id").alias("object_id")), "object_id").groupBy("term_id").agg(F.count("*").alias("n"))
    found = counted.join(term, "term_id")
    order = [F.col("name").asc_nulls_last()] if by_name else [F.col("n").desc()]
    found = found.orderBy(*order, "term_id")
    return (found if max_terms is None else found.limit(max_terms)).select("term_id", "n")


def newest_per_term(eligible: DataFrame, relationship: DataFrame, chosen: DataFrame, per_term: int, reason: str) -> DataFrame:
    """(site, id, term_id, rn, reason): the newest `per_term` entities of each chosen term."""
    order = Window.partitionBy("term_id").orderBy(F.col("date").desc_nulls_last(), F.col("id").desc())
    rows = relationship.join(chosen.select("term_id"), "term_id").join(eligible, relationship.object_id == eligible.id)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_term).select("site", "id", "term_id", F.col("rn").cast("long").alias("rn"), F.lit(reason).alias("reason"))


def per_term(entity: DataFrame, relationship: DataFrame, term: DataFrame, linked: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, id, reason): the newest of each chosen term, for all sites, types and taxonomies in one plan.

    rules (site, type, taxonomy, statuses, per_term, max_terms, by_name, linked_too, reason), max_terms null for all; entity (site,
    id, type, status, date), relationship (site, object_id, term_taxonomy_id), term (site, term_taxonomy_id, taxonomy, name),
    linked (site, taxonomy, term_taxonomy_id): terms that menus name. How many rows a window keeps is in the rule's row.
    """
    own = F.broadcast(rules)  # a row per site, type and taxonomy of the configuration
    eligible = entity.join(own, ["site", "type"]).where(F.array_contains("statuses", F.col("status"))).withColumnRenamed("id", "object_id")
    placed = relationship.join(term.select("site", "term_taxonomy_id", "taxonomy"), ["site", "term_taxonomy_id"])
    pairs = placed.join(eligible, ["site", "taxonomy", "object_id"])
    group = ["site", "type", "taxonomy"]
    counted = pairs.groupBy(*group, "term_taxonomy_id").agg(F.count("*").alias("n")).join(own.select(*group, "max_terms", "by_name"), group)
    counted = counted.join(term.select("site", "term_taxonomy_id", "name"), ["site", "term_taxonomy_id"])
    order = Window.partitionBy(*group).orderBy(F.when(F.col("by_name"), F.col("name").isNull()), F.when(F.col("by_name"), F.col("name")), F.when(~F.col("by_name"), -F.col("n")), "term_taxonomy_id")
    chosen = counted.withColumn("place", F.row_number().over(order)).where("max_terms is null or place <= max_terms").select(*group, "term_taxonomy_id")
    named = linked.join(own.where("linked_too").select(*group), ["site", "taxonomy"]).select(*group, "term_taxonomy_id")
    chosen = chosen.union(named).distinct()
    newest_first = Window.partitionBy(*group, "term_taxonomy_id").orderBy(F.col("date").desc_nulls_last(), F.col("object_id").desc())
    rows = pairs.join(chosen, [*group, "term_taxonomy_id"]).withColumn("rn", F.row_number().over(newest_first)).where("rn <= per_term")
    return rows.select("site", F.col("object_id").alias("id"), "reason").distinct()


def drop_filter(entity: DataFrame, dropped: tuple[str, ...], draft: str = "auto-draft") -> DataFrame:
    """Rows of types that may be kept. A null type is dropped, a null status is not."""
    return entity.where(~F.col("type").isin(*dropped) & (F.coalesce("status", F.lit("")) != draft))


def keep_seeds(seeds: DataFrame, entity: DataFrame) -> DataFrame:
    """(site, id, depth, reason): seeds that exist, each with the least of its reasons."""
    there = seeds.join(entity.select("site", "id"), ["site", "id"], "left_semi")
    return there.groupBy("site", "id").agg(F.min("reason").alias("reason")).select("site", "id", F.lit(0).alias("depth"), "reason")


def option_seeds(options: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(site, id, reason) of options (site, name, value) that hold an entity's id."""
    from quarry.functions.ids import parse_id

    return options.where(F.col("name").isin(*names)).select("site", parse_id("value").alias("id"), F.concat(F.lit("option:"), "name").alias("reason")).where("id is not null")
