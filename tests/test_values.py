"""Values that readings of a dump must give, definitions, redaction, addresses, the export, the made dump."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import ids, refs
from quarry.functions.ddl import portable_defaults
from quarry.operators import checks, finish
from quarry.plans import subset, validate
from quarry.session import ship
from quarry.sources import config, sqldump, synth

#: What meta values hold.
META = {
    "123": [123], " 45 ": [45], "0": [], "-5": [], "12.5": [], "abc": [], "1,2, 3": [1, 2, 3], "1,x,3": [], "[4,5]": [4, 5], '["6","7"]': [6, 7], "'8','9'": [8, 9],
    'a:2:{i:0;s:3:"123";i:1;s:3:"456";}': [123, 456], 'a:2:{s:3:"one";i:7;s:3:"two";s:1:"x";}': [7], 'a:1:{i:0;a:1:{s:2:"id";i:99;}}': [99], 'a:1:{i:0;s:3:"123"': [],
    'O:8:"stdClass":1:{s:2:"id";i:42;}': [42], 'a:1:{i:0;s:10:"bad length";}': [], "9999999999999999999999": [], "a:3:{i:0;b:1;i:1;N;i:2;d:1.5;}": [],
}


def test_meta_values(spark):
    ship(spark)
    given = spark.createDataFrame([(i, 1, 1, "k", v) for i, v in enumerate(META)], "meta_id long, site int, post_id long, meta_key string, value string")
    found = {i: [] for i in range(len(META))}
    for r in refs.meta_refs(given).collect():
        found[r.meta_id].append(r.ref_id)
    assert {v: sorted(found[i]) for i, v in enumerate(META)} == META


def test_json_values(spark):
    ship(spark)
    cases = {
        "5": [5], "1e3": [1000], "1.5": [], "-2": [], "0": [], '"7"': [7], '"+7"': [7], '"-7"': [], '"x,7"': [], '"1e3"': [], "x,7": [], '[1,"2",[3,[4.0]],{"a":5},null,true]': [1, 2, 3, 4],
        "{": [], "null": [], '"99999999999999999999"': [], "[" + ",".join(["3"] * 1500) + "]": [3] * 1000,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, v string").select("n", refs.json_ids(F.col("v")).alias("own")).collect()
    assert {r.n: r.own or [] for r in rows} == dict(enumerate(cases.values()))


def test_content_values(spark):
    ship(spark)
    text = (
        '<!-- wp:image {"id":12,"sizeSlug":"large"} --><img class="wp-image-12"/><!-- /wp:image --> <!-- wp:gallery {"ids":[3,"4"],"linkTo":"none"} /--> <!-- wp:block {"ref":77} /-->'
        '<!-- wp:media-text {"mediaId":55} --><!-- wp:acme/hero {"id":"9","title":"x,7"} /--> [gallery ids="5,6" size="large"] and [gallery ids=\'7\'] <!-- wp:image {"id":12} /--> <!-- wp:broken {"id": -->'
    )
    found = {(r.ref_id, r.source) for r in refs.content_refs(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()}
    assert found == {
        (12, "block:core/image:id"), (3, "block:core/gallery:ids"), (4, "block:core/gallery:ids"), (77, "block:core/block:ref"), (55, "block:core/media-text:mediaId"), (9, "block:acme/hero:id"),
        (12, "class:wp-image"), (5, "shortcode:gallery"), (6, "shortcode:gallery"), (7, "shortcode:gallery"),
    }


def test_lists_in_either_quotes(spark):
    ship(spark)
    cases = {"'1','2'": [1, 2], "[\"3\",'4']": [3, 4], "'5'": [], "1,": [], ",": [], "": []}
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, v string").select("n", ids.list_ids("v").alias("own")).collect()
    assert {r.n: r.own for r in rows} == dict(enumerate(cases.values()))


def test_redaction(spark):
    ship(spark)
    long = "x" * 70
    cases = {
        "Duplicate entry 'a.b@corp.test' for key 'user_email'": "Duplicate entry '…' for key 'user_email'", "The table 'wp_2_options' is full": "The table 'wp_2_options' is full",
        "name 'Ann Other', 'a$b' and ''": "name '…', 'a$b' and '…'", f"'{long}' 'k'": "'…' 'k'", "mail u@host or u@host.org now": "mail u@host or <email> now", "it's open": "it's open", "x'a'b'c d'e": "x'a'b'…'e", "": "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, v string").select("n", finish.redact("v").alias("own"), checks.email_inside(F.col("v")).alias("mail")).collect()
    assert {r.n: r.own for r in rows} == dict(enumerate(cases.values()))
    assert [r.n for r in sorted(rows) if r.mail] == [0, 4]


def test_definitions_by_tokens():
    text = (
        "CREATE TABLE `s` (\n  `id` bigint(20) unsigned NOT NULL DEFAULT 0,\n  `label` varchar(20) NOT NULL DEFAULT '0',\n  `notes` longtext CHARACTER SET utf8mb4 COLLATE utf8mb4_bin NOT NULL DEFAULT _utf8mb4'0',\n"
        "  `quote` mediumtext NOT NULL DEFAULT 'it''s \\' DEFAULT x' COMMENT 'a DEFAULT ''b''',\n  `n` tinytext not null default 5,\n  `e` blob DEFAULT -1.5e+3,\n  `extra` longtext DEFAULT NULL,\n  `payload` blob NOT NULL DEFAULT ('x'),\n"
        "  `data` json NOT NULL DEFAULT '{}', `text` varchar(10) DEFAULT 'text', `default` text,\n  PRIMARY KEY (`id`), KEY `text` (`text`), CHECK (`label` <> 'text')\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4 COMMENT 'DEFAULT 5';\n"
    )
    made = text
    for old in ("_utf8mb4'0'", "'it''s \\' DEFAULT x'", "'{}'"):
        made = made.replace("DEFAULT " + old, f"DEFAULT ({old})")
    made = made.replace("default 5,", "default (5),").replace("DEFAULT -1.5e+3", "DEFAULT (-1.5e+3)")
    assert portable_defaults(text) == made and portable_defaults(made) == made
    assert portable_defaults("INSERT INTO t VALUES (1,'`x` text DEFAULT 1')") == "INSERT INTO t VALUES (1,'`x` text DEFAULT 1')"
    assert portable_defaults("") == "" and portable_defaults("/*!50001 CREATE VIEW v AS SELECT 1 */") == "/*!50001 CREATE VIEW v AS SELECT 1 */"


def test_copies_have_portable_definitions(spark, tmp_path):
    ship(spark)
    path = tmp_path / "d.sql"
    path.write_text(synth.dump(posts=12, seed=2).replace("`post_excerpt` text", "`post_excerpt` text NOT NULL DEFAULT ''"))
    index = subset.build_index(spark, str(path))
    plan = subset.make_plan(index, config.load(""))
    made = b"".join(bytes(r.raw) for r in subset.write_dump(index, plan, subset.slim(index, plan)).collect()).decode()
    assert "`post_excerpt` text NOT NULL DEFAULT ('')" in made


def test_local_addresses():
    sites = [(1, "vip.paper.example", "/"), (2, "www.valley.example", "/")]
    assert finish.targets(sites, "https://news.local/", {2: "https://v.local/x/"}) == {1: "news.local", 2: "v.local/x"}
    for bad in ("news.local", "ftp://news.local", "https://", "https://news.local?x=1", "https://news.local/#a", "https:///path"):
        with pytest.raises(ValueError):
            finish.targets(sites, bad)
    with pytest.raises(ValueError):
        finish.targets(sites, "https://news.local", {2: "https://news.local"})


def test_writing_in_order(spark, tmp_path):
    """All tasks write one file, with the bytes that one writer in order would give."""
    ship(spark)
    rng = random.Random(4)
    rows = [(i, rng.randbytes(rng.choice([0, 1, 50, 5000]))) for i in range(500)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "place long, raw binary").repartition(7)
    path = tmp_path / "out.sql"
    assert validate.write_in_order(df, str(path)) == sum(len(r) for _, r in rows)
    assert path.read_bytes() == b"".join(r for _, r in rows) and [p.name for p in tmp_path.iterdir()] == ["out.sql"]
    assert validate.write_in_order(df.limit(0), str(path)) == 0 and path.read_bytes() == b""


def test_made_dump(spark, tmp_path):
    """The dump that all tasks make is the same in any number of partitions, and an index of it has its rows."""
    ship(spark)
    synth.write(spark, str(tmp_path / "a"), 300, words=10)
    layout = sqldump.scan(spark, str(tmp_path / "a"), 20_000)
    counts = {r["_tbl"]: r["count"] for r in sqldump.rows(spark, str(tmp_path / "a"), "_tbl string, _fit boolean", layout).where("_fit").groupBy("_tbl").count().collect()}
    assert counts == {"wp_posts": 300, "wp_postmeta": 1200, "wp_terms": 200, "wp_term_taxonomy": 200, "wp_term_relationships": 600, "wp_options": 3, "wp_users": 50}
    one, other = (synth.frames(spark, 300, 10)["posts"].repartition(n).orderBy("ID").collect() for n in (1, 5))
    assert one == other
    pairs = synth.frames(spark, 300, 10)["term_relationships"]
    assert pairs.count() == pairs.distinct().count()


def test_suggestions(spark, tmp_path, capsys):
    """The suggested configuration is one that loads, and keeps large types by category or the newest of them."""
    import json

    from quarry.__main__ import main

    path = tmp_path / "d.sql"
    path.write_text(synth.dump(posts=400, seed=3, statement_rows=100))
    assert main(["suggest", str(path)]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made == {"post_types": {"page": {"mode": "latest", "count": 20}, "post": {"mode": "per_term", "per_term": 11, "taxonomies": {"category": {"max_terms": 10, "include_menu_terms": True}}}}}
    settings = config.load(json.dumps(made))
    assert settings.post_types["post"].mode == "per_term"
    index = subset.build_index(spark, str(path))
    kept = subset.make_plan(index, settings).keep
    assert kept.where("reason = 'type:page:latest'").count() == 20 and kept.where("reason like 'type:post:per_term:%'").count() > 0


def test_field_checks(spark, tmp_path):
    """Fields that hold images or files are checked like featured images."""
    ship(spark)
    path = tmp_path / "d.sql"
    field = 'a:1:{s:4:"type";s:5:"image";}'
    extra = f"INSERT INTO `wp_posts` (`ID`,`post_content`,`post_excerpt`,`post_status`,`post_parent`,`post_type`) VALUES (900,'{field}','portrait','publish',0,'acf-field');\nINSERT INTO `wp_postmeta` (`meta_id`,`post_id`,`meta_key`,`meta_value`) VALUES (9000,1,'portrait','41'),(9001,2,'portrait','7777');\n"
    path.write_text(synth.dump(posts=30, seed=3) + extra)
    source = subset.build_index(spark, str(path))
    found = {c.name: c for c in validate.reference_checks(source, source)}
    assert (found["image and file fields exist"].status, found["image and file fields exist"].count) == ("warning", 1)
    copy = subset.Index(source.rows, source.statements, source.sites, source.frames | {"posts": source.posts.where("id <> 41 and id <> 1")})
    assert {c.name: c for c in validate.reference_checks(copy, source)}["image and file fields exist"].status == ("fail" if source.posts.where("id = 41").count() else "warning")
