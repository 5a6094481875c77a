"""A small seeded dump for tests: posts of several types, meta with references, terms, users, options, plugin tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dump as dumps

HOSTILE = ("O'Brien; DROP TABLE x;--", 'back\\slash "quoted"', "line\nbreak\ttab", "emoji \U0001f600 ünï", "(1,2),(3,4)", "/* no comment */ -- nor this", "")


def quote(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0")
    return f"'{text}'"


def dump(posts: int = 60, seed: int = 1, prefix: str = "wp_", subsite: bool = False, complete: bool = True, statement_rows: int = 7, personal: bool = False, triggers: bool = False, hex_blob: bool = False) -> str:
    """The dump's text. Posts 1 to `posts`, of which every seventh is a revision, every fifth a page; attachments follow.

    complete: INSERTs list their columns; statement_rows: rows of a statement; personal: a plugin's table of addresses;
    triggers: a DELIMITER block; hex_blob: a table of binary values as 0x literals.
    """
    rng = random.Random(seed)
    out = ["-- A seeded dump\n/*!40101 SET NAMES utf8mb4 */;\n"]

    def table(name: str, columns: dict[str, str], rows: list[tuple], per: int = statement_rows) -> None:
        body = ",\n".join(f"  `{c}` {t}" for c, t in columns.items())
        out.append(f"DROP TABLE IF EXISTS `{name}`;\nCREATE TABLE `{name}` (\n{body},\n  PRIMARY KEY (`{next(iter(columns))}`)\n) ENGINE=InnoDB;\nLOCK TABLES `{name}` WRITE;\n")
        names = " (" + ", ".join(f"`{c}`" for c in columns) + ")" if complete else ""
        for at in range(0, len(rows), per):
            out.append(f"INSERT INTO `{name}`{names} VALUES " + ",".join("(" + ",".join(map(quote, r)) + ")" for r in rows[at : at + per]) + ";\n")
        out.append("UNLOCK TABLES;\n")

    def site(p: str, n: int) -> None:
        kinds = lambda i: "revision" if i % 7 == 0 else "page" if i % 5 == 0 else "post"
        media = n + 1
        rows = [(i, 1 + i % 3, f"2024-01-{1 + i % 28:02d} 10:00:00" if i % 11 else "0000-00-00 00:00:00", f'<!-- wp:image {{"id":{media + i % 5}}} --><img class="wp-image-{media + i % 5}">' + rng.choice(HOSTILE), rng.choice(HOSTILE), "publish" if i % 4 else "draft", i // 10, kinds(i), "") for i in range(1, n + 1)]
        rows += [(media + i, 1, "2024-02-01 00:00:00", "", "", "inherit", 0, "attachment", "image/png") for i in range(10)]
        rows.append((media + 10, 1, "2024-02-01 00:00:00", "", "", "publish", 0, "nav_menu_item", ""))
        table(p + "posts", {"ID": "bigint unsigned NOT NULL", "post_author": "bigint", "post_date": "datetime", "post_content": "longtext", "post_excerpt": "text", "post_status": "varchar(20)", "post_parent": "bigint", "post_type": "varchar(20)", "post_mime_type": "varchar(100)"}, rows)
        meta = [(i, i, "_thumbnail_id", str(media + 5 + i % 5)) for i in range(1, n + 1)]
        meta += [(n + i, i, "_edit_lock", "1:1") for i in range(1, n + 1)]
        meta += [(3 * n + 1, media + 10, "_menu_item_type", "post_type"), (3 * n + 2, media + 10, "_menu_item_object_id", str(n)), (3 * n + 3, media + 10, "_menu_item_object", "post"), (3 * n + 4, 1, "_children", "a:2:{i:0;i:2;i:1;s:1:\"3\";}")]
        table(p + "postmeta", {"meta_id": "bigint", "post_id": "bigint", "meta_key": "varchar(255) DEFAULT NULL", "meta_value": "longtext"}, meta)
        table(p + "terms", {"term_id": "bigint", "name": "varchar(200)", "slug": "varchar(200)"}, [(i, f"Term {i}", f"term-{i}") for i in range(1, 13)])
        table(p + "term_taxonomy", {"term_taxonomy_id": "bigint", "term_id": "bigint", "taxonomy": "varchar(32)", "parent": "bigint", "count": "bigint"}, [(i, i, "category" if i < 7 else "post_tag", i // 2 if i < 7 else 0, 0) for i in range(1, 13)])
        table(p + "term_relationships", {"object_id": "bigint", "term_taxonomy_id": "bigint", "term_order": "int"}, [(i, 1 + (i + k) % 12, 0) for i in range(1, n + 1) for k in (0, 5)])
        options = [("siteurl", f"https://{p.strip('_')}.example.org"), ("page_on_front", "5"), ("posts_per_page", "10"), ("_transient_x", "y"), ("sticky_posts", "a:1:{i:0;i:9;}")]
        table(p + "options", {"option_id": "bigint", "option_name": "varchar(191)", "option_value": "longtext", "autoload": "varchar(20)"}, [(i, k, v, "yes") for i, (k, v) in enumerate(options, 1)])
        table(p + "comments", {"comment_ID": "bigint", "comment_post_ID": "bigint", "comment_author_email": "tinytext"}, [(i, i, f"c{i}@corp.test") for i in range(1, 9)])
        table(p + "example_bylines", {"byline_id": "bigint", "post_id": "bigint", "byline": "text"}, [(i, i, rng.choice(HOSTILE)) for i in range(1, n + 1)])
        table(p + "example_log", {"log_id": "bigint", "message": "text"}, [(i, rng.choice(HOSTILE)) for i in range(1, 30)])
        table(p + "yoast_indexable", {"id": "bigint", "permalink": "text"}, [(i, "x") for i in range(1, 9)])

    site(prefix, posts)
    if subsite:
        site(prefix + "2_", 6)
    table(prefix + "users", {"ID": "bigint", "user_login": "varchar(60)", "user_email": "varchar(100)"}, [(i, f"user{i}", f"user{i}@corp.test") for i in range(1, 6)])
    roles = ["administrator", "editor", "author", "subscriber", "administrator"]
    table(prefix + "usermeta", {"umeta_id": "bigint", "user_id": "bigint", "meta_key": "varchar(255)", "meta_value": "longtext"}, [(i, i, prefix + "capabilities", 'a:1:{s:%d:"%s";b:1;}' % (len(roles[i - 1]), roles[i - 1])) for i in range(1, 6)])
    if personal:
        table(prefix + "example_subscribers", {"id": "bigint", "subscriber_email": "varchar(100)", "signup_ip": "varchar(45)"}, [(i, f"reader{i}@corp.test", f"10.0.0.{i}") for i in range(1, 4)])
    if hex_blob:
        out.append(f"CREATE TABLE `{prefix}example_blobs` (\n  `blob_id` bigint,\n  `data` varbinary(16)\n);\nINSERT INTO `{prefix}example_blobs` VALUES (1,0x00FF27),(2,0x5C0A3B0A);\n")
    if triggers:
        out.append(f"DELIMITER ;;\nCREATE TRIGGER `t` BEFORE INSERT ON `{prefix}posts` FOR EACH ROW BEGIN SET NEW.post_type = 'post'; END ;;\nDELIMITER ;\n")
    return "".join(out)


def _drawn(salt: int, n: int) -> Column:
    """A number under n that a row's counter and a salt give."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))


def frames(spark: SparkSession, posts: int, words: int = 120, metas: int = 4) -> dict[str, DataFrame]:
    """The tables of a site of so many posts, made by all tasks: each value follows from the row's counter, whatever the partitions."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(5000)).cast("string"), F.when(i % 17 == 0, F.lit("'s\n")).otherwise(F.lit("")))), " ")
    ref = F.concat(F.lit('<!-- wp:image {"id":'), (_drawn(1, posts) + 1).cast("string"), F.lit("} -->"))
    day = F.date_format(F.timestamp_seconds(F.lit(1_500_000_000) + _drawn(2, 200_000_000)), "yyyy-MM-dd HH:mm:ss")
    kind = F.when(F.col("id") % 7 == 0, "revision").when(F.col("id") % 5 == 0, "page").when(F.col("id") % 11 == 0, "attachment").otherwise("post")
    row = spark.range(1, posts + 1)
    table = {
        "posts": row.select(F.col("id").alias("ID"), (_drawn(3, 50) + 1).alias("post_author"), day.alias("post_date"), F.concat(ref, text).alias("post_content"), F.lit("").alias("post_excerpt"), F.when(_drawn(4, 4) > 0, "publish").otherwise("draft").alias("post_status"), F.floor(F.col("id") / 10).alias("post_parent"), kind.alias("post_type"), F.lit("").alias("post_mime_type")),
        "postmeta": spark.range(1, posts * metas + 1).select(F.col("id").alias("meta_id"), (F.floor((F.col("id") - 1) / metas) + 1).alias("post_id"), F.when(F.col("id") % metas == 0, "_thumbnail_id").otherwise(F.concat(F.lit("_key_"), (F.col("id") % 40).cast("string"))).alias("meta_key"), F.when(F.col("id") % metas == 0, (_drawn(5, posts) + 1).cast("string")).otherwise(F.concat(F.lit("value "), _drawn(6, 10**6).cast("string"))).alias("meta_value")),
        "terms": spark.range(1, 201).select(F.col("id").alias("term_id"), F.concat(F.lit("Term "), "id").alias("name"), F.concat(F.lit("term-"), "id").alias("slug")),
        "term_taxonomy": spark.range(1, 201).select(F.col("id").alias("term_taxonomy_id"), F.col("id").alias("term_id"), F.when(F.col("id") < 40, "category").otherwise("post_tag").alias("taxonomy"), F.lit(0).alias("parent"), F.lit(0).alias("count")),
        "term_relationships": spark.range(1, posts * 2 + 1).select((F.floor((F.col("id") + 1) / 2)).alias("object_id"), (F.pmod(F.xxhash64(F.floor((F.col("id") + 1) / 2)), F.lit(100)) * 2 + F.col("id") % 2 + 1).alias("term_taxonomy_id"), F.lit(0).alias("term_order")),
        "options": spark.range(1, 4).select(F.col("id").alias("option_id"), F.element_at(F.array(*map(F.lit, ("siteurl", "page_on_front", "posts_per_page"))), F.col("id").cast("int")).alias("option_name"), F.element_at(F.array(*map(F.lit, ("https://wp.example.org", "5", "10"))), F.col("id").cast("int")).alias("option_value"), F.lit("yes").alias("autoload")),
    }
    return table | {"users": spark.range(1, 51).select(F.col("id").alias("ID"), F.concat(F.lit("user"), "id").alias("user_login"), F.concat(F.lit("user"), "id", F.lit("@corp.test")).alias("user_email"))}


def write(spark: SparkSession, path: str, posts: int, prefix: str = "wp_", words: int = 120) -> None:
    """A dump of a site of so many posts as the folder `path`: definitions, and INSERTs of 500 rows by all tasks."""
    made = frames(spark, posts, words)
    kinds = {"bigint": "bigint", "int": "int", "string": "longtext"}
    creates = [(f"CREATE TABLE `{prefix}{name}` (" + ", ".join(f"`{c}` {kinds[k]}" for c, k in df.dtypes) + ")",) for name, df in made.items()]
    every = spark.createDataFrame(creates, "value string").coalesce(1)
    for name, df in made.items():
        every = every.unionByName(dumps.to_dump(df, prefix + name))
    every.write.option("lineSep", ";\n").text(path)
