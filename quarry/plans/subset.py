"""From a dump to a small, closed copy: index, plan, slim, scrub, check, write.

A dump is parsed once, into Parquet by role. The index's frames hold ids, types, sizes and references, no texts and no
personal data, and read only their role's files and columns; the plan works on them alone. Slimming goes back to the stored
rows, which are the dump's with their bytes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions import ddl, ids, php, refs
from quarry.operators import closure, keep, match, profile, seeds
from quarry.sources import dump, sqldump, store
from quarry.sources.config import ALL, ALWAYS_DROPPED, ALWAYS_KEPT, Config

from . import rules

#: Keys, field types and options whose values are ids; options that are dropped or whose values are kept.
FOLLOWED = ("_thumbnail_id", "_product_image_gallery", "_upsell_ids", "_crosssell_ids", "_children", "_yoast_wpseo_opengraph-image-id", "_yoast_wpseo_twitter-image-id")
FIELD_TYPES = ("image", "file", "gallery", "relationship", "post_object", "page_link")
CHILD_TYPES = ("product_variation",)
OPTION_REFS = (
    "page_on_front", "page_for_posts", "wp_page_for_privacy_policy", "woocommerce_shop_page_id", "woocommerce_cart_page_id", "woocommerce_checkout_page_id",
    "woocommerce_myaccount_page_id", "woocommerce_terms_page_id",
)
DROPPED_OPTIONS = ("_transient_*", "_site_transient_*", "jpsq_*")
STORED_OPTIONS = ("siteurl", "home", "show_on_front", "sticky_posts", "posts_per_page", "template", "stylesheet", "active_plugins", "db_version") + OPTION_REFS
MENU_KEYS = ("_menu_item_type", "_menu_item_object_id", "_menu_item_object")
WANTED = (
    "id", "post_author", "post_date", "post_content", "post_excerpt", "post_name", "post_status", "post_parent", "post_type", "post_mime_type", "meta_id", "post_id", "meta_key", "meta_value",
    "option_id", "option_name", "option_value", "autoload", "term_id", "name", "slug", "term_taxonomy_id", "taxonomy", "parent", "count", "object_id", "umeta_id", "user_id", "blog_id", "domain", "path", "public", "archived", "deleted", "spam", "comment_id", "comment_post_id", "comment_approved", "comment_type",
)
#: The columns that a core table is filtered by.
KEYS = {"posts": "id", "postmeta": "meta_id", "terms": "term_id", "term_taxonomy": "term_taxonomy_id", "termmeta": "meta_id", "options": "option_id", "users": "id", "usermeta": "umeta_id"}


@dataclass
class Index:
    """A dump's rows and what is known of them."""

    rows: DataFrame
    statements: DataFrame
    sites: dict[int, str]
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError as e:
            raise AttributeError(name) from e


def _v(name: str) -> Column:
    return F.col("v_" + name)


def _id(name: str) -> Column:
    return _v(name).try_cast("bigint")


#: What a row has beside its values (v_ and a column's name, in lower case).
PLACE = {"_ord": "ord", "_row": "row", "_tbl": "tbl", "_bytes": "bytes", "_columns": "columns", "_body": "body", "_tail": "tail", "_fit": "fit", "_size": "size"}


def row_columns(columns: tuple[str, ...] = ()) -> str:
    """The columns of a dump's rows that the index wants, for the data source."""
    return f"{sqldump.BASE.replace(' long', ' bigint')}, " + ", ".join(f"`{c}` string" for c in dict.fromkeys(WANTED + tuple(c.lower() for c in columns)))


def placed_rows(rows: DataFrame, tables: list[str]) -> tuple[DataFrame, dict[int, str]]:
    """Rows of the data source with their site and role, and the sites' prefixes."""
    counts = {t: 0 for t in tables}
    if len(rules.main_prefixes(counts)) > 1:  # the one with most posts is the main one
        counts |= {r["_tbl"]: r["count"] for r in rows.where(F.col("_tbl").endswith("posts")).groupBy("_tbl").count().collect()}
    sites = rules.sites_of(counts)
    placed = rows.sparkSession.createDataFrame([(n, *rules.place(n, sites)) for n in tables], "tbl string, site int, role string")  # a row per table
    named = rows.select(*(F.col(c).alias(PLACE.get(c, "v_" + c)) for c in rows.columns))
    return named.join(F.broadcast(placed), "tbl"), sites


def build_index(spark: SparkSession, path: str, exact: bool = False, columns: tuple[str, ...] = (), folder: str | None = None) -> Index:
    """The index of the dump at `path`; columns are those of filter_by in the configuration. Rows of another length than their table's columns are not indexed.

    The dump is parsed once, into Parquet by role in `folder` (one of its own in the shared folder without one). An index in
    `folder` that is complete and fits the dump's size and time is used as it is. It holds the dump's rows, texts included: `store.drop` deletes it.
    """
    where = folder or f"{store.shared(spark)}/index-{uuid.uuid4().hex}"
    stamp = store.stamp(spark, path, WANTED + tuple(columns), exact)
    if not (folder and store.complete(spark, where, stamp)):
        store.drop(spark, where)
        layout = None
        if exact or not sqldump.reached(path):
            found = closure.saved(dump.read_statements(spark, path, exact))
            rows = sqldump.parsed(dump.read_rows(found), sqldump.declared_of(found), row_columns(columns)).drop("_size")
            rows = rows.join(found.select(F.col("ord").alias("_ord"), F.lit(0).alias("_row"), F.length("raw").cast("long").alias("_size")), ["_ord", "_row"], "left")
            tables = [r.tbl for r in found.where("tbl is not null and kind in ('insert', 'create_table')").select("tbl").distinct().collect()]  # a row per table
            others = found.where("kind <> 'insert'")
        else:
            layout = sqldump.scan(spark, path)
            rows, tables = sqldump.rows(spark, path, row_columns(columns), layout), layout.tables
            others = sqldump.statements(spark, path, False, layout)
        rows, sites = placed_rows(rows, sorted(tables))
        store.put(others, f"{where}/statements")
        store.put(rows, f"{where}/rows", "role")
        index = _framed(_stored(spark, where, rows.schema), store.get(spark, f"{where}/statements", others.schema), sites)
        for name in DERIVED:
            store.put(index.frames[name], f"{where}/{name}")
        store.commit(spark, where, stamp, sites, rows.schema, layout.packed() if layout else "")
    sites, schema, packed = store.known(spark, where)
    index = _framed(_stored(spark, where, schema), store.get(spark, f"{where}/statements"), sites)
    # All statements with their bytes are the dump's: they are read only where they are asked for.
    statements = sqldump.statements(spark, path, layout=sqldump.Layout.unpacked(packed)) if packed else dump.read_statements(spark, path, exact)
    return Index(index.rows, statements, sites, index.frames | {name: store.get(spark, f"{where}/{name}") for name in DERIVED})


def _stored(spark: SparkSession, where: str, schema: StructType) -> DataFrame:
    return store.get(spark, f"{where}/rows", schema).withColumn("role", F.coalesce("role", F.lit("")))  # a folder's name can't be empty


SITE_FLAGS = ("public", "archived", "deleted", "spam")


def sites_frame(prefixes: DataFrame, blogs: DataFrame, main: str) -> DataFrame:
    """(site, prefix, domain, path, public, archived, deleted, spam, has_tables): every site that has tables (site, prefix) or that the network lists (site, domain, path and flags), by a full join."""
    listed = blogs.where("site is not null").dropDuplicates(["site"])
    both = prefixes.withColumn("has_tables", F.lit(True)).join(listed, "site", "full")
    named = F.when(F.col("site") == 1, F.lit(main)).otherwise(F.concat(F.lit(main), F.col("site").cast("string"), F.lit("_")))
    return both.select("site", F.coalesce("prefix", named).alias("prefix"), "domain", "path", *SITE_FLAGS, F.coalesce("has_tables", F.lit(False)).alias("has_tables"))


#: Frames that are worked out from texts: these are kept.
DERIVED = ("tables", "meta_refs", "menu", "content_refs", "fields", "user_roles")


def index_of(statements: DataFrame, rows: DataFrame, columns: tuple[str, ...] = ()) -> Index:
    """The index of a dump's statements and rows, such as a copy's."""
    declared = sqldump.declared_of(statements)
    tables = sorted(set(declared) | {r.tbl for r in rows.select("tbl").distinct().collect()})  # a row per table
    found, sites = placed_rows(sqldump.parsed(rows, declared, row_columns(columns)), tables)
    return _framed(closure.saved(found), statements, sites)


def _framed(rows: DataFrame, statements: DataFrame, sites: dict[int, str]) -> Index:
    """The frames of placed rows."""
    counts = rows.groupBy("tbl", "site", "role").agg(F.count("*").alias("rows"), F.sum("bytes").alias("row_bytes"), F.count_if(~F.col("fit")).alias("bad_rows"), (F.coalesce(F.sum("size"), F.lit(0)) - F.sum("bytes")).alias("between"))
    creates = statements.where("tbl is not null").groupBy("tbl").agg(F.max(F.when(F.col("kind") == "create_table", F.decode("raw", "UTF-8"))).alias("create_sql"), F.sum(F.length("raw")).alias("beside"))
    place = F.udf(lambda n: rules.place(n, sites), "site int, role string")  # a row per table
    tables = creates.join(counts, "tbl", "full").withColumn("placed", place("tbl"))
    tables = tables.select("tbl", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("row_bytes", F.lit(0)).alias("row_bytes"), F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"), (F.coalesce("between", F.lit(0)) + F.coalesce("beside", F.lit(0))).alias("other_bytes"), "create_sql", F.coalesce("site", "placed.site").alias("site"), F.coalesce("role", "placed.role").alias("role"))
    named = rows.where("fit")

    def role(name: str) -> DataFrame:
        return named.where(F.col("role") == name)

    date = F.try_to_timestamp(_v("post_date"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    posts = role("posts").select("tbl", "site", _id("id").alias("id"), _v("post_type").alias("type"), _v("post_status").alias("status"), _id("post_author").alias("author"), _id("post_parent").alias("parent"), date.alias("date"), _v("post_mime_type").alias("mime"), "bytes")
    meta = role("postmeta").select("tbl", "site", _id("meta_id").alias("meta_id"), _id("post_id").alias("post_id"), _v("meta_key").alias("meta_key"), _v("meta_value").alias("value"), "bytes")
    fields = role("posts").where(_v("post_type") == "acf-field").select("site", _id("id").alias("id"), _v("post_excerpt").alias("name"), _id("post_parent").alias("parent"), php.php_lookup(_v("post_content"), "type").alias("field_type"))
    content = role("posts").where(_v("post_type") != "revision").select("site", _id("id").alias("id"), _v("post_content").alias("content"))
    contents = refs.content_refs(content.select(F.struct("site", "id").alias("key"), "content"), "key", "content").select("key.site", F.col("key.id").alias("post_id"), "ref_id", "source")
    menu = meta.where(F.col("meta_key").isin(*MENU_KEYS)).groupBy("site", "post_id").pivot("meta_key", list(MENU_KEYS)).agg(F.min("value"))
    menu = menu.select("site", "post_id", F.col("_menu_item_type").alias("type"), F.col("_menu_item_object_id").alias("object_id"), F.col("_menu_item_object").alias("object"))
    options = role("options").select("tbl", "site", _id("option_id").alias("option_id"), _v("option_name").alias("name"), F.when(_v("option_name").isin(*STORED_OPTIONS), _v("option_value")).alias("value"), _v("autoload").alias("autoload"), "bytes")
    user_meta = role("usermeta").select("tbl", _id("umeta_id").alias("umeta_id"), _id("user_id").alias("user_id"), _v("meta_key").alias("meta_key"), _v("meta_value").alias("value"), "bytes")
    frames = {
        "tables": tables,
        "others": statements,
        "posts": posts,
        "postmeta": meta.drop("value"),
        "meta_refs": refs.meta_refs(meta.select("site", "meta_id", "post_id", "meta_key", "value")),
        "menu": menu,
        "content_refs": contents,
        "fields": fields,
        "terms": role("terms").select("tbl", "site", _id("term_id").alias("term_id"), _v("name").alias("name"), _v("slug").alias("slug"), "bytes"),
        "term_taxonomy": role("term_taxonomy").select("tbl", "site", _id("term_taxonomy_id").alias("term_taxonomy_id"), _id("term_id").alias("term_id"), _v("taxonomy").alias("taxonomy"), _id("parent").alias("parent"), "bytes"),
        "term_relationships": role("term_relationships").select("tbl", "site", _id("object_id").alias("object_id"), _id("term_taxonomy_id").alias("term_taxonomy_id"), "bytes"),
        "termmeta": role("termmeta").select("tbl", "site", _id("meta_id").alias("meta_id"), _id("term_id").alias("term_id"), "bytes"),
        "options": options,
        "users": role("users").select("tbl", _id("id").alias("id"), "bytes"),
        "usermeta": user_meta.drop("value"),
        "user_roles": user_meta.where(F.col("meta_key").endswith("capabilities")).select("user_id", "meta_key", F.explode(php.php_true_keys("value")).alias("role")),
        "comments": role("comments").select("tbl", "site", _id("comment_id").alias("id"), _id("comment_post_id").alias("post_id"), _v("comment_approved").alias("status"), _v("comment_type").alias("type"), "bytes"),
        "commentmeta": role("commentmeta").select("tbl", "site", _id("meta_id").alias("meta_id"), _id("comment_id").alias("comment_id"), "bytes"),
        "blogs": role("blogs").select("tbl", _id("blog_id").alias("blog_id"), _v("domain").alias("domain"), _v("path").alias("path"), "bytes"),
        "sites": sites_frame(rows.sparkSession.createDataFrame(list(sites.items()), "site int, prefix string"), role("blogs").select(_id("blog_id").cast("int").alias("site"), *(_v(c).alias(c) for c in ("domain", "path")), *((_v(c) == "1").alias(c) for c in SITE_FLAGS)), sites[1]),
        "object_rows": named.where("role = ''").select("tbl", "site", F.coalesce(_id("post_id"), _id("object_id")).alias("object_id"), "ord", "row", "bytes").where("object_id is not null"),
        "named": named.withColumn("values", F.create_map(*[x for c in rows.columns if c.startswith("v_") for x in (F.lit(c[2:]), F.col(c))])),
    }
    return Index(rows, statements, sites, frames)


@dataclass
class Plan:
    """The keep set, what each core table keeps by its key, the rule of each table, estimates and warnings."""

    keep: DataFrame
    kept: dict[str, DataFrame]
    rules: dict[str, rules.Rule]
    estimate: DataFrame
    warnings: list[str]
    included: list[int]


def type_rules(index: Index, config: Config) -> list[tuple]:
    """(site, type, status, count, reason) for the types that a mode of all or latest applies to."""
    known = index.posts.select("site", "type").where("type is not null").distinct().collect()  # a row per site and type
    out = []
    for site, kind in known:
        own = config.for_site(site)
        if kind in ALWAYS_KEPT + ALWAYS_DROPPED or (kind == "attachment" and kind not in own.post_types):
            continue
        rule = own.post_types.get(kind, own.default_post_type)
        if rule.mode in ("all", "latest"):
            # Statuses marked all share one count.
            reason = f"type:{kind}:{rule.mode}"
            out += [(site, kind, s, None if rule.mode == "all" else rule.count, reason) for s, n in rule.statuses.items() if n == ALL]
        if rule.mode != "none":
            out += [(site, kind, s, n, f"type:{kind}:status:{s}") for s, n in rule.statuses.items() if n > 0]
    return out


def seed_frame(index: Index, config: Config, included: list[int]) -> DataFrame:
    spark = index.posts.sparkSession
    posts = index.posts.where(F.col("site").isin(*included))
    found = posts.where(F.col("type").isin(*ALWAYS_KEPT)).select("site", "id", F.lit("always kept").alias("reason"))
    own = spark.createDataFrame(type_rules(index, config), "site int, type string, status string, count int, reason string")
    found = found.unionByName(seeds.newest_per_type(posts, own))
    options = index.options.where(F.col("site").isin(*included))
    found = found.unionByName(seeds.option_seeds(options, OPTION_REFS))
    sticky = F.udf(lambda x: php.ids_in(x, ints_only=True), "array<bigint>")  # one row per site
    found = found.unionByName(options.where("name = 'sticky_posts'").select("site", F.explode(sticky("value")).alias("id"), F.lit("option:sticky_posts").alias("reason")))
    wanted = [
        (site, kind, taxonomy, [s for s, n in rule.statuses.items() if n == ALL], rule.per_term, None if pick.max_terms == ALL else pick.max_terms, pick.order == "name", bool(pick.include_menu_terms), f"type:{kind}:per_term:{taxonomy}")
        for site in included for kind, rule in config.for_site(site).post_types.items() if rule.mode == "per_term" for taxonomy, pick in rule.taxonomies.items()
    ]
    if wanted:
        own = spark.createDataFrame(wanted, "site int, type string, taxonomy string, statuses array<string>, per_term int, max_terms int, by_name boolean, linked_too boolean, reason string")
        terms = index.term_taxonomy.join(index.terms.select("site", "term_id", "name"), ["site", "term_id"], "left").select("site", "term_taxonomy_id", "term_id", "taxonomy", "name")
        linked = index.menu.where("type = 'taxonomy'").select("site", F.col("object").alias("taxonomy"), F.col("object_id").try_cast("bigint").alias("term_id"))
        linked = terms.join(linked, ["site", "taxonomy", "term_id"], "left_semi").select("site", "taxonomy", "term_taxonomy_id")
        found = found.unionByName(seeds.per_term(posts, index.term_relationships, terms, linked, own))
    return found


def follow_keys(index: Index, config: Config, included: list[int]) -> DataFrame:
    """(site, meta_key, reason): fixed and configured keys, and keys of fields that hold ids, also as parts of other fields."""
    spark = index.posts.sparkSession
    fixed = spark.createDataFrame([(s, k, "meta:" + k) for s in included for k in FOLLOWED + config.for_site(s).extra_meta_keys], "site int, meta_key string, reason string")
    return fixed.unionByName(field_keys(index, FIELD_TYPES).select("site", "meta_key", F.concat(F.lit("acf:"), "meta_key").alias("reason"))).groupBy("site", "meta_key").agg(F.min("reason").alias("reason"))


def field_keys(index: Index, types: tuple[str, ...]) -> DataFrame:
    """(site, meta_key): keys of fields of these types, also as parts of other fields."""
    by_id = index.fields.select("site", F.col("id").alias("parent"), F.lit(True).alias("sub"))
    names = index.fields.where(F.col("field_type").isin(*types)).join(by_id, ["site", "parent"], "left").select("site", "name", F.coalesce("sub", F.lit(False)).alias("sub"))
    keys = index.postmeta.where("meta_key is not null and not startswith(meta_key, '_')").select("site", "meta_key").distinct()
    found = keys.select("site", "meta_key", F.explode(match.suffixes("meta_key")).alias("name")).join(names, ["site", "name"]).where("meta_key = name or sub")
    return found.select("site", "meta_key").distinct()


def make_plan(index: Index, config: Config) -> Plan:
    # Sites that the network no longer lists are left over from deleted ones.
    listed_sites = {r.blog_id for r in index.blogs.select("blog_id").collect()} if "blogs" in index.frames else set()  # a row per site
    orphaned = [s for s in index.sites if listed_sites and s != 1 and s not in listed_sites and config.sites.get(str(s), {}).get("exclude") is None]
    included = [s for s in index.sites if not config.excluded(s) and s not in orphaned]
    excluded = frozenset(index.sites) - frozenset(included)
    posts = closure.saved(seeds.drop_filter(index.posts.where(F.col("site").isin(*included)), ALWAYS_DROPPED))
    start = seeds.keep_seeds(seed_frame(index, config, included), posts)
    edges = closure.saved(closure.edges_of(posts, index.meta_refs, follow_keys(index, config, included), CHILD_TYPES, content=index.content_refs, menu=index.menu))
    kept = closure.closure(start, edges, config.dependency_depth)
    site = ("site",)
    tt = index.term_taxonomy.where(F.col("site").isin(*included))
    base = keep.prune_terms(tt, index.term_relationships, kept, config.prune_unused_flat_terms_over, "term_taxonomy_id", site)
    # Taxonomies of one site are apart from those of another.
    tagged = lambda df: df.select("term_id", F.concat_ws(":", F.col("site").cast("string"), "taxonomy").alias("taxonomy"), "parent")
    lines = closure.ancestors(tagged(base), tagged(tt)).select("term_id", "taxonomy")
    keep_tt = closure.saved(tt.withColumn("key", F.concat_ws(":", F.col("site").cast("string"), "taxonomy")).join(lines.withColumnRenamed("taxonomy", "key"), ["term_id", "key"], "left_semi").select("site", "term_taxonomy_id", "term_id", "taxonomy"))
    meta = keep.keep_meta(index.postmeta, kept, config.meta_exclude_keys, scope=site)
    relationships = keep.keep_relationships(index.term_relationships, keep_tt, kept, "link_category", "term_taxonomy_id", site).drop("taxonomy").distinct()
    holders = index.user_roles.where(F.col("role").isin(*config.include_roles)).select(F.col("user_id").alias("id"))
    users = keep.keep_users(index.users, index.posts, kept, holders, site)
    gone = tuple(index.sites[s] + "*" for s in excluded)
    user_meta = keep.keep_meta(index.usermeta, users, gone, "user_id")
    options = index.options.where(F.col("site").isin(*included)).where(~keep.any_glob(F.col("name"), DROPPED_OPTIONS + config.options_exclude))
    kept_rows = {
        "posts": index.posts.join(kept.select("site", "id"), ["site", "id"], "left_semi"),
        "postmeta": meta,
        "term_taxonomy": tt.join(keep_tt.select("site", "term_taxonomy_id"), ["site", "term_taxonomy_id"], "left_semi"),
        "terms": index.terms.join(keep_tt.select("site", "term_id").distinct(), ["site", "term_id"], "left_semi"),
        "termmeta": index.termmeta.join(keep_tt.select("site", "term_id").distinct(), ["site", "term_id"], "left_semi"),
        "term_relationships": relationships,
        "options": options,
        "users": users,
        "usermeta": user_meta,
    }
    prefixes = {0: index.sites[1]} | index.sites
    found: dict[str, rules.Rule] = {}
    warnings = [f"sites.{s}: tables but no row in blogs, left over from a deleted site; dropped unless sites.{s}.exclude is false" for s in orphaned]
    listed = index.tables.collect()  # a row per table
    for t in listed:
        columns = tuple(n for n, _ in dump.declared_columns(t.create_sql.encode())) if t.create_sql else ()
        found[t.tbl] = rule = rules.resolve(rules.Table(t.tbl, t.role, t.site, t.row_bytes, columns), config, prefixes, excluded)
        if rule.source == "default" and rule.action == "empty":
            warnings.append(f"{t.tbl}: unknown table of {ids.format_bytes(t.row_bytes)} emptied")
    warnings += [f"tables.{name}: no such table" for name in config.tables if not set(name) & set("*?[") and name not in found]
    estimate = profile.size_estimate({name: rows for name, rows in kept_rows.items()})
    return Plan(kept, kept_rows, found, estimate, warnings, included)


def filtered_rows(index: Index, plan: Plan) -> DataFrame:
    """The rows of the tables that are filtered: by kept posts of their site, or by sites where the column is blog_id."""
    by = [(n, r.filter_by) for n, r in plan.rules.items() if r.action == "filter"]
    out = index.named.where(F.lit(False))
    for column in sorted({c for _, c in by}):
        own = index.named.where(F.col("tbl").isin(*[n for n, c in by if c == column])).withColumn("object_id", _id(column.lower()))
        if column == "blog_id":
            out = out.unionByName(own.where(F.col("object_id").isin(*plan.included)).drop("object_id"))
        else:
            out = out.unionByName(keep.semi_join(own, plan.keep.select("site", F.col("id").alias("object_id")), ["site", "object_id"]).drop("object_id"))
    return out


def kept_keys(plan: Plan) -> DataFrame:
    """(tbl, key, other): what the core tables keep; other is a relationship's second key, else 0."""
    out = None
    for role, rows in plan.kept.items():
        key, other = ("object_id", F.col("term_taxonomy_id")) if role == "term_relationships" else (KEYS[role], F.lit(0).cast("long"))
        own = rows.select("tbl", F.col(key).alias("key"), other.alias("other"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def slim(index: Index, plan: Plan) -> DataFrame:
    """The dump's rows (ord, row, tbl, columns, body, tail) that the plan keeps.

    The rows of all core tables meet the keys once, with their bytes beside them: a filter of the keys that each task
    holds leaves few rows for the exact semi-join. Other tables' rows pass by their rule.
    """
    key = F.lit(None).cast("long")
    for role, name in KEYS.items():
        key = F.when(F.col("role") == role, _id(name)).otherwise(key)
    link = F.col("role") == "term_relationships"
    core = index.named.where(F.col("role").isin(*plan.kept)).withColumn("key", F.when(link, _id("object_id")).otherwise(key)).withColumn("other", F.when(link, _id("term_taxonomy_id")).otherwise(0))
    places = [keep.semi_join(core, kept_keys(plan), ["tbl", "key", "other"])]
    whole = [n for n, r in plan.rules.items() if r.action == "keep"]
    # Links of a site have no key set: they are kept whole.
    places.append(index.rows.where((F.col("tbl").isin(*whole) if whole else F.lit(False)) & ~F.col("role").isin(*plan.kept) | (F.col("role") == "links") & F.col("fit")))
    filtered = [n for n, r in plan.rules.items() if r.action == "filter"]
    if filtered:
        places.append(filtered_rows(index, plan).where(~F.col("role").isin(*plan.kept, "links")))
    wanted = ("ord", "row", "tbl", "columns", "body", "tail")
    every = places[0].select(*wanted)
    for p in places[1:]:
        every = every.unionByName(p.select(*wanted))
    return every


def portable(statements: DataFrame) -> DataFrame:
    """The statements with definitions that more servers accept."""
    rewrite = F.udf(lambda raw: ddl.portable_defaults(bytes(raw).decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape"), "binary")  # a row per table
    return statements.withColumn("raw", F.when(F.col("kind") == "create_table", rewrite("raw")).otherwise(F.col("raw")))


def passed(index: Index, plan: Plan) -> DataFrame:
    """The statements that hold no rows, without those of dropped tables."""
    dropped = [n for n, r in plan.rules.items() if r.action == "drop"]
    return index.others.where("kind <> 'insert'").where(F.col("tbl").isNull() | ~F.col("tbl").isin(*dropped) if dropped else F.lit(True))


def write_dump(index: Index, plan: Plan, slimmed: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(place, raw): the statements of the copy in their order; statements of dropped tables are left out, definitions are made portable, all others pass as they are."""
    packed = dump.insert_statements(slimmed, most).select(F.struct(F.col("first_ord").alias("ord"), F.col("first_row").alias("row")).alias("place"), F.concat(F.lit(b"\n"), "raw").alias("raw"))
    return portable(passed(index, plan)).select(F.struct("ord", F.lit(-1).alias("row")).alias("place"), "raw").unionByName(packed).orderBy("place")
