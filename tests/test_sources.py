"""Dumps, values, configuration, rules and the whole way from a dump to its copy."""

import random

import pytest

from quarry.functions import php
from quarry.operators import checks, finish
from quarry.plans import rules, subset
from quarry.sources import config, dump, synth

EDGES = b"""-- a comment; with a semicolon
/* another; one */
/*!40101 SET NAMES utf8 */;
CREATE TABLE `odd-name` (`id` int(11) NOT NULL, `select` decimal(10,2) DEFAULT '1,5', `t` text COMMENT 'a, (b', PRIMARY KEY (`id`), KEY `k` (`t`(10))) ENGINE=InnoDB;
insert into `odd-name` values (1, 1.50, 'it''s; \\'q\\' \\\\'),
  (2, NULL, 'line
break;
here');
INSERT IGNORE INTO odd.`odd-name` (`t`, id) VALUES (_utf8mb4'x', 3), (concat('a', 'b,)'), 4);
DELIMITER ;;
CREATE TRIGGER tr BEFORE INSERT ON `odd-name` FOR EACH ROW BEGIN SET @a = 1; SET @b = 2; END ;;
DELIMITER ;
INSERT INTO `odd-name` (id, t) VALUES (5, 0x414), (6, X'4142'), (7, b'1') ON DUPLICATE KEY UPDATE id = id;
"""


def test_exact_statements():
    found = list(dump.statements(EDGES))
    assert b"".join(found) == EDGES
    kinds = [dump.classify(s) for s in found if s.strip()]
    assert kinds == [("other", None), ("create_table", "odd-name"), ("insert", "odd-name"), ("insert", "odd-name"), ("delimiter", None), ("create_trigger", "odd-name"), ("delimiter", None), ("insert", "odd-name")]
    rows = [dump.tuples(s) for s in found]
    values = [[v for _, vs in own for v in vs] for _, own in rows]
    assert values[2][2] == ("string", b"'it''s; \\'q\\' \\\\'") and dump.decode(*values[2][2]) == b"it's; 'q' \\"
    assert dump.decode(*values[2][5]) == b"line\nbreak;\nhere"
    assert values[3][2][0] == "expr" and values[3][0] == ("string", b"_utf8mb4'x'") and dump.decode(*values[3][0]) == b"x"
    assert [dump.decode(*v) for v in values[7][1::2][:2]] == [b"\x04\x14", b"AB"]
    with pytest.raises(dump.DumpError):
        dump.decode(*values[7][5])
    assert dump.declared_columns(found[1]) == [("id", "int(11)"), ("select", "decimal(10,2)"), ("t", "text")]


def test_truncated():
    with pytest.raises(dump.DumpError):
        list(dump.statements(b"INSERT INTO t VALUES ('abc"))


def test_escapes():
    for raw, value in ((rb"'\0\n\r\t\Z\b'", b"\0\n\r\t\x1a\b"), (rb"'\%\_\x'", rb"\%\_x"), (rb"'a''b'", b"a'b"), (rb'"a""b"', b'a"b')):
        assert dump.decode("string", raw) == value


def test_php():
    assert php.unserialise(b'a:2:{i:0;s:2:"ab";s:1:"k";a:1:{i:0;b:1;}}') == [(0, b"ab"), (b"k", [(0, True)])]
    for bad in (b"", b"i:1", b"i:1;x", b's:3:"ab";', b"a:1:{i:0;}", b"R:1;", b"C:1:x", b'a:1:{d:1.5;i:1;}', b"b:2;", b'O:1:"A":1:{i:0;'):
        with pytest.raises(php.PhpError):
            php.unserialise(bad)
    assert php.ids_in('a:4:{i:0;i:5;i:1;s:2:"07";i:2;d:9.0;i:3;b:1;}') == [5, 7]
    assert php.ids_in("5") == [] and php.ids_in(None) == [] and php.ids_in('a:1:{i:0;s:1:"9";}', ints_only=True) == []
    assert php.true_keys('a:2:{s:5:"admin";b:1;s:2:"no";b:0;}') == ["admin"]
    assert php.lookup('a:1:{s:4:"type";s:5:"image";}', "type") == "image"
    assert php.replaced('a:1:{i:0;s:5:"//a.b";}', [("//a.b", "//long.example")]) == 'a:1:{i:0;s:14:"//long.example";}'
    assert php.unserialise(php.serialise_ids([3, 4])) == [(0, 3), (1, 4)]
    rng = random.Random(1)
    for _ in range(500):
        junk = bytes(rng.choice(b'aiOsbdN:;{}"0123') for _ in range(rng.randrange(20)))
        try:
            assert php.unserialise(php.serialise(php.unserialise(junk))) is not Ellipsis
        except php.PhpError:
            pass


def test_config():
    c = config.load("post_types: {post: {mode: latest, count: 3}}\nreferences: {extra_meta_keys: [a]}\nsites: {'*': {references: {extra_meta_keys: [b]}}, '2': {exclude: true, post_types: {post: {mode: all}}}}")
    assert c.for_site(2).post_types["post"].mode == "all" and c.for_site(3).extra_meta_keys == ("a", "b") and c.excluded(2) and not c.excluded(3)
    assert config.load("").dependency_depth == 2 and config.load("dependency_depth: 0").dependency_depth == 0
    for bad in ("x: 1", "comments: {}", "target_size_mb: -1", "dependency_depth: -1", "post_types: {revision: {mode: all}}", "post_types: {post: {mode: some}}", "post_types: {post: {mode: per_term}}", "post_types: {post: {mode: latest, count: 0}}", "tables: {t: maybe}", "local: {sites: {2: x}}", "local: {url: x, sites: {1: y}}", "scrub: {profile: odd}", "sites: {'1': {exclude: true}}", "sites: {a: {}}", "users: {include_roles: admin}", "post_types: {post: {mode: all, statuses: {draft: -2}}}"):
        with pytest.raises(config.ConfigError):
            config.load(bad)


def test_rules():
    c = config.load("tables: {wp_odd: empty, 'wp_glob*': keep, wp_by: {filter_by: owner}}")
    one = lambda name, **more: rules.resolve(rules.Table(name, **more), c, {0: "wp_", 1: "wp_"})
    assert one("wp_posts", role="posts", site=1).action == "core" and one("wp_comments", role="comments", site=1).action == "empty"
    assert one("wp_odd", site=1).action == "empty" and one("wp_globs", site=1).action == "keep" and one("wp_icl_translations", site=1).note == "kept whole"
    assert one("wp_by", site=1, columns=("owner",)).filter_by == "owner" and one("wp_x", site=1, columns=("post_id",)).action == "filter"
    assert one("wp_big", site=1, row_bytes=2 << 20).action == "empty" and one("wp_small", site=1).action == "keep" and one("wp_yoast_seo_links", site=1).action == "empty"
    with pytest.raises(config.ConfigError):
        one("wp_by", site=1, columns=("other",))
    assert rules.sites_of({"wp_posts": 5, "wp_options": 1, "wp_3_posts": 2, "wp_3_options": 1}) == {1: "wp_", 3: "wp_3_"}
    assert rules.place("wp_3_postmeta", {1: "wp_", 3: "wp_3_"}) == (3, "postmeta") and rules.place("wp_users", {1: "wp_"}) == (0, "users") and rules.place("x", {1: "wp_"}) == (0, "")
    with pytest.raises(ValueError):
        rules.sites_of({"a": 1})
    assert rules.suggest([{"type": "page", "published": 3, "taxonomies": {}}, {"type": "post", "published": 900, "taxonomies": {"category": 4}}])["post"]["per_term"] == 11


def test_local_urls():
    sites = [(1, "www.example.org", "/"), (2, "www.example.org", "/shop/"), (3, "stage.blog.example.org", "/"), (4, "blog.example.net", "/")]
    to = finish.targets(sites, "https://x.test")
    assert to == {1: "x.test", 2: "x.test/shop", 3: "x.test/blog", 4: "x.test/blog-4"}
    assert finish.replacements(sites, to)[0] == ("stage.blog.example.org", "x.test/blog")
    assert finish.slug("www.example.org") == "example" and finish.slug("www.com") == "site"
    assert checks.worst(["pass", "fail", "warning"]) == "fail" and checks.worst([]) == "pass"
    assert checks.personal_columns([("user_email", "string"), ("signup_ip", "string"), ("zip", "string"), ("email_count", "bigint")]) == (["user_email"], ["signup_ip"])


@pytest.mark.parametrize("exact", [False, True])
def test_copy_of_a_dump(spark, tmp_path, exact):
    from quarry.session import ship

    ship(spark)
    text = synth.dump(posts=60, subsite=True, complete=not exact)
    path = tmp_path / "dump.sql"
    path.write_text(text)
    index = subset.build_index(spark, str(path), exact)
    whole = b"".join(bytes(r.raw) for r in index.statements.orderBy("ord").collect())
    assert whole.rstrip(b";\n") == text.encode().rstrip(b";\n")
    plan = subset.make_plan(index, config.load("post_types:\n  post: {mode: latest, count: 5}\n  page: {mode: all}\nsites: {'2': {exclude: true}}"))
    kept = {r.id: r for r in plan.keep.collect()}
    posts = {r.id: r for r in index.posts.where("site = 1").collect()}
    assert all(posts[i].type != "revision" for i in kept) and 5 in kept and 9 in kept
    assert all(posts[i].parent in kept or not posts[i].parent or posts[posts[i].parent].type == "revision" for i in kept if posts[i].type != "attachment")
    slimmed = subset.slim(index, plan)
    counts = {r.tbl: r["count"] for r in slimmed.groupBy("tbl").count().collect()}
    planned = {"wp_" + r.tbl: r.n for r in plan.estimate.collect() if r.n}
    assert {k: counts.get(k) for k in planned} == planned and not any(k.startswith("wp_2_") for k in counts) and "wp_comments" not in counts
    out = b"".join(bytes(r.raw) for r in subset.write_dump(index, plan, slimmed, 2000).collect())
    again = tmp_path / "copy.sql"
    again.write_bytes(out)
    back = dump.read_rows(dump.read_statements(spark, str(again), exact))
    assert back.count() == slimmed.count() and sorted(bytes(r.body) for r in back.collect()) == sorted(bytes(r.body) for r in slimmed.collect())
    assert b"wp_2_" not in out and len(out) < len(text) // 2


def test_clause_after_rows(spark, tmp_path):
    from quarry.session import ship

    ship(spark)
    path = tmp_path / "edges.sql.gz"
    import gzip

    path.write_bytes(gzip.compress(EDGES))
    rows = dump.read_rows(dump.read_statements(spark, str(path), exact=True))
    assert {bytes(r.tail) for r in rows.where("tail is not null").collect()} == {b"ON DUPLICATE KEY UPDATE id = id"}
    packed = b"".join(bytes(r.raw) for r in dump.insert_statements(rows, 1000).collect())
    assert packed.count(b"ON DUPLICATE KEY") == 1 and rows.count() == 7
    with pytest.raises(Exception, match="allows no cut"):
        dump.insert_statements(rows, 50).collect()
    plain = tmp_path / "plain.sql.gz"
    plain.write_bytes(gzip.compress(synth.dump(posts=8).encode()))
    assert dump.read_rows(dump.read_statements(spark, str(plain))).count() > 50
