"""The inventory of an index: one DataFrame per result, for all sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import profile
from quarry.sources.config import ALWAYS_DROPPED, ALWAYS_KEPT

from .rules import suggest
from .subset import Index

LARGE_OPTION = 100 << 10
#: What says that an option is always loaded.
AUTOLOADED = ("yes", "on", "auto", "auto-on")
#: Comment states by their codes.
COMMENT_STATES = {"1": "approved", "0": "pending"}


def comment_state(column: str):
    c = F.col(column)
    out = c
    for code, name in COMMENT_STATES.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def inventory(index: Index) -> dict[str, DataFrame]:
    """Results by name. Null types and statuses are their own groups."""
    posts, tt, relationships = index.posts, index.term_taxonomy, index.term_relationships
    meta_bytes = index.postmeta.join(posts.select("site", F.col("id").alias("post_id"), "type"), ["site", "post_id"]).groupBy("site", "type").agg(F.sum("bytes").alias("meta_bytes"))
    terms = tt.select("site", "term_taxonomy_id", "taxonomy", "term_id", "parent")
    joined = relationships.select("site", "object_id", "term_taxonomy_id").join(terms, ["site", "term_taxonomy_id"])
    linked = index.menu.where("type = 'taxonomy'").select("site", F.col("object_id").try_cast("bigint").alias("term_id"), F.col("object").alias("taxonomy"))
    used = joined.select(F.col("term_taxonomy_id"), "site", "object_id")
    named = tt.join(index.terms.select("site", "term_id", F.coalesce("slug", "name").alias("slug")), ["site", "term_id"], "left")
    resolved = index.meta_refs.groupBy("site", "meta_key", "ref_id").agg(F.count("*").alias("n")).join(posts.select("site", F.col("id").alias("ref_id"), F.lit(1).alias("there")), ["site", "ref_id"], "left")
    resolved = resolved.groupBy("site", "meta_key").agg(F.sum("n").alias("refs"), F.coalesce(F.sum(F.when(F.col("there") == 1, F.col("n"))), F.lit(0)).alias("resolved"))
    content = index.content_refs.join(posts.select("site", F.col("id").alias("ref_id"), F.lit(1).alias("there")), ["site", "ref_id"], "left").groupBy("site", "source").agg(F.count("*").alias("refs"), F.count("there").alias("resolved"))
    options = index.options
    transient = F.col("name").startswith("_transient_") | F.col("name").startswith("_site_transient_")
    comments = index.comments.groupBy("site", comment_state("status").alias("status"), F.when(F.col("type") == "", "comment").otherwise(F.coalesce("type", F.lit("comment"))).alias("type")).agg(F.count("*").alias("n"))
    return {
        "tables": index.tables.select("tbl", "site", "role", "rows", "bad_rows", "row_bytes", (F.col("row_bytes") + F.col("other_bytes")).alias("bytes")).orderBy(F.col("bytes").desc(), "tbl"),
        "sites": index.frames["sites"].join(index.tables.groupBy("site").agg(F.sum(F.col("row_bytes") + F.col("other_bytes")).alias("bytes")), "site", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0))).orderBy("site"),
        "users": index.users.agg(F.count("*").alias("n")),
        "post_types": profile.type_profile(posts).join(meta_bytes, ["site", "type"], "left"),
        "statuses": profile.status_profile(posts),
        "taxonomies": tt.groupBy("site", "taxonomy").agg(F.count("*").alias("terms"), F.bool_or(F.col("parent") > 0).alias("hierarchical")),
        "taxonomy_types": joined.join(posts.select("site", F.col("id").alias("object_id"), "type"), ["site", "object_id"], "left").groupBy("site", "taxonomy", F.coalesce("type", F.lit("(missing post)")).alias("type")).agg(F.count("*").alias("n")),
        "menu_terms": tt.join(linked, ["site", "term_id", "taxonomy"]).groupBy("site", "taxonomy").agg(F.count_distinct("term_taxonomy_id").alias("n")),
        "top_terms": profile.top_per_taxonomy(
            used.select(F.struct("site", "term_taxonomy_id").alias("term_id"), "object_id"),
            named.select(F.struct("site", "term_taxonomy_id").alias("term_id"), F.concat_ws(":", F.col("site").cast("string"), "taxonomy").alias("taxonomy"), F.col("slug").alias("name")),
        ),
        "options": options.groupBy("site").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(transient).alias("transients"), F.coalesce(F.sum(F.when(transient, F.col("bytes"))), F.lit(0)).alias("transient_bytes"), F.coalesce(F.sum(F.when(F.col("autoload").isin(*AUTOLOADED), F.col("bytes"))), F.lit(0)).alias("autoload_bytes")),
        "large_options": options.where(F.col("bytes") > LARGE_OPTION).select("site", "name", "bytes").orderBy("site", F.col("bytes").desc(), "name"),
        "stored_options": options.where("value is not null").select("site", "name", "value"),
        "roles": index.user_roles.groupBy("meta_key", "role").agg(F.count_distinct("user_id").alias("users")),
        "meta_keys": resolved.where("resolved > 0"),
        "content_sources": content,
        "comments": comments,
        "network": index.blogs.select("blog_id", "domain", "path"),
    }


def suggestion(index: Index, site: int = 1) -> dict[str, dict]:
    """What a configuration may say of a site's types, from how many posts they have published, their taxonomies and menus."""
    posts = index.posts.where((F.col("site") == site) & F.col("type").isNotNull() & ~F.col("type").isin(*ALWAYS_KEPT, *ALWAYS_DROPPED, "attachment"))
    published = {r.type: r.n for r in posts.groupBy("type").agg(F.count_if(F.col("status") == "publish").alias("n")).collect()}  # a row per type
    terms = index.term_taxonomy.where(F.col("site") == site)
    of_types = index.term_relationships.join(terms.select("site", "term_taxonomy_id", "taxonomy"), ["site", "term_taxonomy_id"]).join(posts.select("site", F.col("id").alias("object_id"), "type"), ["site", "object_id"])
    linked = index.menu.where((F.col("site") == site) & (F.col("type") == "taxonomy")).select(F.col("object_id").try_cast("bigint").alias("term_id"), F.col("object").alias("taxonomy"))
    menus = {r.taxonomy: r["count"] for r in terms.join(linked, ["term_id", "taxonomy"], "left_semi").groupBy("taxonomy").count().collect()}  # a row per taxonomy
    taxonomies: dict[str, dict[str, int]] = {kind: {} for kind in published}
    for r in of_types.select("type", "taxonomy").distinct().collect():  # a row per type and taxonomy
        taxonomies[r.type][r.taxonomy] = menus.get(r.taxonomy, 0)
    page = next((int(r.value) for r in index.options.where((F.col("site") == site) & (F.col("name") == "posts_per_page")).select("value").collect() if (r.value or "").isdigit()), 10)
    return suggest([{"type": kind, "published": n, "taxonomies": taxonomies[kind]} for kind, n in sorted(published.items())], page)
