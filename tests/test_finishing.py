"""The last steps on a copy, its checks, and the gate."""

import json

import pytest

from quarry.__main__ import main
from quarry.functions import php
from quarry.plans import finishing, subset, validate
from quarry.session import ship
from quarry.sources import config, dump, synth


def index(spark, path, text, exact=False):
    ship(spark)
    path.write_text(text)
    return subset.build_index(spark, str(path), exact)


def test_build_scrubs(spark, tmp_path, capsys):
    """No address but allowed ones and no login is left, terms are counted, pages that are gone are 0, addresses are local."""
    path, out, settings = tmp_path / "dump.sql", tmp_path / "copy.sql", tmp_path / "site.yml"
    box = 'a:1:{i:0;O:3:"Box":1:{s:3:"url";s:24:"https://wp.example.org/a";}}'
    extra = f"INSERT INTO `wp_options` VALUES (90,'admin_email','boss@corp.test','yes'),(91,'home','https://wp.example.org','yes'),(92,'page_for_posts','777','yes'),(93,'widget','{box}','yes');\n"
    more = "INSERT INTO `wp_usermeta` VALUES (50,1,'nickname','Hans Muster'),(51,1,'session_tokens','secret'),(52,1,'billing_phone','0791234567');\n"
    path.write_text(synth.dump(posts=40, seed=5).replace("a:1:{i:0;i:9;}", "a:2:{i:0;i:9;i:1;i:7777;}") + extra + more)
    settings.write_text("post_types: {post: {mode: latest, count: 6}}\nlocal: {url: 'http://localhost:8080'}")
    assert main(["build", str(path), "--config", str(settings), "--out", str(out), "--salt", "s"]) == 0
    assert json.loads(capsys.readouterr().err)["status"] in ("pass", "warning")
    text = out.read_text()
    assert not any(x in text for x in ("corp.test", "user1", "Hans", "0791234567", "secret", "//wp.example.org"))
    assert 's:24:"https://localhost:8080/a"' in text
    copy = subset.build_index(spark, str(out))
    options = {r.name: r.value for r in copy.options.collect()}
    assert options["page_for_posts"] == "0" and options["home"] == "http://localhost:8080" == options["siteurl"]
    assert options["sticky_posts"] in ("a:1:{i:0;i:9;}", "a:0:{}")
    published = {r.id for r in copy.posts.where("status = 'publish' or (type = 'attachment' and status = 'inherit') or type = 'nav_menu_item'").collect()}
    counted = {r.term_taxonomy_id: int(r["count"]) for r in copy.named.where("role = 'term_taxonomy'").selectExpr("cast(values['term_taxonomy_id'] as bigint) as term_taxonomy_id", "values['count'] as count").collect()}
    want = dict.fromkeys(counted, 0)
    for r in copy.term_relationships.collect():
        want[r.term_taxonomy_id] += r.object_id in published
    assert counted == want and sum(want.values())


def test_gate(spark, tmp_path):
    """A table of addresses stops the export; nothing is written without checks."""
    path, out = tmp_path / "dump.sql", tmp_path / "copy.sql"
    path.write_text(synth.dump(posts=20, seed=2, personal=True))
    assert main(["build", str(path), "--out", str(out)]) == 1 and not out.exists()
    with pytest.raises(ValueError):
        validate.export(spark.createDataFrame([], "place int, raw binary"), [], str(out))


def test_network(spark, tmp_path):
    """A site that the network does not list goes, and posts of one site are no posts of the other."""
    whole = index(spark, tmp_path / "d.sql", synth.dump(posts=20, seed=4, subsite=True) + "CREATE TABLE `wp_blogs` (\n  `blog_id` bigint,\n  `domain` varchar(200),\n  `path` varchar(100)\n);\nINSERT INTO `wp_blogs` VALUES (1,'a.example','/');\n")
    plan = subset.make_plan(whole, config.load(""))
    assert plan.included == [1] and any(w.startswith("sites.2") for w in plan.warnings)
    kept = subset.make_plan(whole, config.load("sites: {'2': {exclude: false}}"))
    assert kept.included == [1, 2]
    from quarry.operators import profile

    found = {(r.site, r.type): r for r in profile.type_report(whole.posts, kept.keep, whole.postmeta).collect()}
    per_site = {r.site: r.b for r in whole.postmeta.join(kept.keep.selectExpr("site", "id as post_id"), ["site", "post_id"], "left_semi").groupBy("site").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "b").collect()}
    for site in (1, 2):
        assert sum(r.kept_meta_bytes for (s, _), r in found.items() if s == site) == per_site[site]


def test_objects():
    text = 'a:2:{i:0;O:3:"Box":2:{s:1:"u";s:11:"//a.b/lengt";s:1:"n";d:0.5;}s:1:"k";s:8:"O:1 //a.b";}'.replace('s:8:"O:1 //a.b"', 's:9:"O:1 //a.b"')
    want = text.replace('s:11:"//a.b/lengt"', 's:20:"//long.example/lengt"').replace('s:9:"O:1 //a.b"', 's:18:"O:1 //long.example"')
    assert php.replaced(text, [("//a.b", "//long.example")]) == want
    assert php.replaced("plain //a.b", [("//a.b", "//c")]) == "plain //c" and php.replaced(None, []) is None
    assert php.serialise(php.unserialise(text.encode())).decode() == text


def test_quoted():
    for raw in (b"", b"a'b", b"\\", b"\0\n\r\x1a", "é;\n".encode()):
        assert dump.decode("string", dump.quoted(raw)) == raw


def test_stand_ins():
    own = {"id": "7", "user_login": "a", "user_email": "A@Good.org", "user_pass": "x"}
    out = finishing.scrubbed("users", own, "s", ("good.org",), ())
    assert out["user_login"].startswith("user_") and "user_email" not in out and out["user_pass"] == "" and "user_url" not in out
    assert finishing.scrubbed("sitemeta", {"meta_key": "_site_transient_x", "meta_value": "1"}, "s", (), ()) is None
    assert finishing.scrubbed("comments", {"comment_author_email": "x@y.z", "comment_author_ip": "1.2.3.4"}, "s", (), ())["comment_author_ip"] == "127.0.0.1"
