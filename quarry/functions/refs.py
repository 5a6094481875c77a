"""Ids that meta values and content refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import list_ids, parse_id
from .php import php_ids

#: Attributes of content blocks that hold ids.
BLOCK_KEYS = ("id", "ref", "ids", "mediaId")
MOST = 1000


def meta_refs(meta: DataFrame, column: str = "value") -> DataFrame:
    """(site, meta_id, post_id, meta_key, ref_id): a row per id in each value. Only serialised values leave the JVM."""
    c = F.trim(column)
    short = meta.where((F.length(column) <= 1 << 20) & c.rlike("^[0-9\\[aO\"']"))
    php = c.rlike("^[aO]:") & (F.length(c) >= 3)
    keep = [x for x in ("site", "meta_id", "post_id", "meta_key") if x in meta.columns]
    plain = short.where(~php).select(*keep, F.explode(list_ids(column)).alias("ref_id"))
    packed = short.where(php).select(*keep, F.explode(php_ids(c)).alias("ref_id"))
    return plain.unionByName(packed)


#: Arrays within arrays are followed so deep.
NESTED = 8


def json_ids(value: Column) -> Column:
    """Ids in JSON text: see variant_ids. Text that is no JSON has none."""
    return variant_ids(F.try_parse_json(value))


def variant_ids(value: Column) -> Column:
    """Ids in a JSON value: a whole number over 0 however it is written, a string of digits with or without a sign, or an array of such, MOST at most."""
    nothing = F.array().cast("array<variant>")
    every = F.when(value.isNotNull(), F.array(value)).otherwise(nothing)
    for _ in range(NESTED):
        inner = F.transform(every, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v)))
        every = F.flatten(inner)

    def whole(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        of_number = F.when((number == F.floor(number)) & (number < 2.0**63), number.cast("bigint"))
        of_text = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
        return F.when(kind == "STRING", of_text).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), of_number)

    return F.slice(F.filter(F.transform(every, whole), lambda x: x > 0), 1, MOST)


def content_refs(posts: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, ref_id, source): ids in block attributes, image classes and galleries, each once per text and source; the first MOST of a text."""
    blocks = F.regexp_extract_all(column, F.lit(r"(?s)<!-- wp:([^ \t\n>]+[ \t\n]+\{.*?\})\s*/?\s*-->"), 1)
    marked = posts.where(F.col(column).contains("<!-- wp:") | F.col(column).contains("wp-image-") | F.col(column).contains("[gallery"))
    name = F.regexp_extract("b", r"^(\S+)", 1)
    attributes = F.try_parse_json(F.regexp_extract("b", r"(?s)^\S+\s+(.*)$", 1))
    named = F.when(name.contains("/"), name).otherwise(F.concat(F.lit("core/"), name))
    block = marked.select(id_column, F.posexplode(blocks).alias("at", "b")).select(id_column, (F.col("at") * len(BLOCK_KEYS)).alias("at"), named.alias("name"), attributes.alias("a"))
    values = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(key).alias("key"), F.try_variant_get("a", f"$.{key}", "variant").alias("v")) for i, key in enumerate(BLOCK_KEYS)])
    block = block.select(id_column, "at", "name", F.explode(values).alias("x")).select(id_column, (F.col("at") + F.col("x.k")).alias("at"), F.concat(F.lit("block:"), "name", F.lit(":"), "x.key").alias("source"), F.posexplode(variant_ids(F.col("x.v"))).alias("i", "ref_id"))
    image = marked.select(id_column, F.posexplode(F.regexp_extract_all(column, F.lit("wp-image-([0-9]+)"), 1)).alias("at", "v")).select(id_column, (F.col("at") + 100_000_000).alias("at"), F.lit("class:wp-image").alias("source"), F.lit(0).alias("i"), parse_id("v").alias("ref_id"))
    codes = F.regexp_extract_all(column, F.lit("\\[gallery([^\\]]*)\\]"), 1)
    held = F.regexp_extract("b", "ids=(?:\"([^\"]*)\"|'([^']*)'|([^\"'][^\\]]*))", 0)
    gallery = marked.select(id_column, F.posexplode(codes).alias("at", "b")).select(id_column, (F.col("at") + 200_000_000).alias("at"), F.trim(F.regexp_replace(held, "^ids=[\"']?|[\"']$", "")).alias("v"))
    gallery = gallery.select(id_column, "at", F.lit("shortcode:gallery").alias("source"), F.posexplode(list_ids("v")).alias("i", "ref_id"))
    every = block.unionByName(image).unionByName(gallery).where("ref_id is not null")
    firsts = every.groupBy(id_column, "ref_id", "source").agg(F.min(F.struct("at", "i")).alias("first"))
    order = Window.partitionBy(id_column).orderBy("first")
    return firsts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= MOST).select(id_column, "ref_id", "source")
