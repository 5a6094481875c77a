"""Inventory, checks of a copy, the stored index, definitions."""

import pytest

from quarry.functions.ddl import portable_defaults
from quarry.plans import inventory, subset, validate
from quarry.session import ship
from quarry.sources import config, dump, store, synth


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    ship(spark)
    path = tmp_path_factory.mktemp("dumps") / "dump.sql"
    path.write_text(synth.dump(posts=40, seed=3))
    return subset.build_index(spark, str(path))


def test_inventory(whole):
    found = {k: v.collect() for k, v in inventory.inventory(whole).items()}
    types = {r.type: r for r in found["post_types"]}
    assert types["revision"].n == 5 and types["attachment"].n == 10 and types["page"].first_day.startswith("2024")
    assert found["users"][0].n == 5 and {r.taxonomy: r.hierarchical for r in found["taxonomies"]} == {"category": True, "post_tag": False}
    assert {r.role: r.users for r in found["roles"]}["administrator"] == 2 and found["options"][0].transients == 1
    assert all(r.value for r in found["stored_options"]) and not any(r.name == "_transient_x" for r in found["stored_options"])
    assert {r.meta_key: (r.refs, r.resolved) for r in found["meta_keys"]}["_thumbnail_id"] == (40, 40)
    assert max(sum(1 for r in found["top_terms"] if r.taxonomy == t) for t in ("1:category", "1:post_tag")) <= 5


def test_checks_and_gate(spark, whole, tmp_path):
    plan = subset.make_plan(whole, config.load("post_types: {post: {mode: latest, count: 4}}"))
    text = subset.write_dump(whole, plan, subset.slim(whole, plan))
    path = tmp_path / "copy.sql"
    path.write_bytes(b"".join(bytes(r.raw) for r in text.collect()))
    copy = subset.build_index(spark, str(path))
    found = validate.reference_checks(copy, whole) + validate.plan_checks(copy, whole, 10)
    assert validate.status(found) in ("pass", "warning"), found
    users = spark.createDataFrame([(1, "a@corp.test", "10.0.0.1", "x"), (2, "b@example.com", "127.0.0.1", "mail c@corp.test")], "id long, user_email string, signup_ip string, note string")
    personal = validate.personal_checks({"users": users})
    assert [(c.status, c.count) for c in personal] == [("fail", 1), ("fail", 1), ("warning", 1)] and "corp" not in str(personal)
    assert not validate.export(text, personal, str(tmp_path / "no.sql")) and not (tmp_path / "no.sql").exists()
    assert validate.export(text, found, str(tmp_path / "yes.sql")) and (tmp_path / "yes.sql").read_bytes() == path.read_bytes()
    broken = subset.Index(copy.rows, copy.statements, copy.sites, copy.frames | {"posts": copy.posts.where("type <> 'attachment'")})
    assert validate.status(validate.reference_checks(broken, whole)) == "fail"


def test_stored_index(spark, whole, tmp_path):
    path = str(tmp_path / "index")
    assert not store.is_fresh(spark, path, 1, 2)
    store.save(whole, path, 1, 2)
    assert store.is_fresh(spark, path, 1, 2) and not store.is_fresh(spark, path, 1, 3)
    back = store.load(spark, path, ("posts", "meta_refs"))
    assert back.sites == whole.sites and back.posts.count() == whole.posts.count()


def test_definitions():
    text = "CREATE TABLE `t` (\n  `a` text DEFAULT 'x''y',\n  `b` varchar(9) DEFAULT 'z',\n  `c` longtext DEFAULT NULL,\n  `d` json NOT NULL DEFAULT '{}' COMMENT 'e'\n)"
    assert portable_defaults(text) == text.replace("text DEFAULT 'x''y'", "text DEFAULT ('x''y')").replace("NOT NULL DEFAULT '{}'", "NOT NULL DEFAULT ('{}')")
    assert [n for n, _ in dump.declared_columns(text.encode())] == ["a", "b", "c", "d"]


def test_report_and_command(spark, tmp_path, capsys):
    import json

    from quarry.__main__ import main

    path, out = tmp_path / "dump.sql", tmp_path / "copy.sql"
    path.write_text(synth.dump(posts=40, seed=5))
    settings = tmp_path / "site.yml"
    settings.write_text("post_types: {post: {mode: latest, count: 4}, film: {mode: all}}\nreferences: {extra_meta_keys: [odd]}\ntables: {wp_none: keep}\nsites: {'9': {exclude: true}}")
    assert main(["build", str(path), "--config", str(settings), "--out", str(out)]) == 0
    found = json.loads(capsys.readouterr().out)
    assert 0.8 < found["bytes"] / out.stat().st_size < 1.5 and found["sites"][0]["prefix"] == "wp_"
    said = "\n".join(found["warnings"])
    for part in ("post_types.film", "extra_meta_keys: odd", "tables.wp_none", "sites.9", "page: not configured"):
        assert part in said


def test_index_is_used_again(spark, tmp_path, monkeypatch):
    """A second build parses nothing; another dump, other columns or an index without its mark are parsed."""
    from quarry.sources import sqldump

    ship(spark)
    path, folder = tmp_path / "dump.sql", str(tmp_path / "kept")
    path.write_text(synth.dump(posts=30, seed=6))
    settings = config.load("post_types: {post: {mode: latest, count: 4}}")
    first = subset.build_index(spark, str(path), folder=folder)
    slimmed = sorted((r.ord, r.row, bytes(r.body)) for r in subset.slim(first, subset.make_plan(first, settings)).collect())
    calls = []
    real = sqldump.scan
    monkeypatch.setattr(sqldump, "scan", lambda *a, **k: calls.append(1) or real(*a, **k))
    again = subset.build_index(spark, str(path), folder=folder)
    assert not calls and again.sites == first.sites
    assert sorted((r.ord, r.row, bytes(r.body)) for r in subset.slim(again, subset.make_plan(again, settings)).collect()) == slimmed
    plan = again.posts.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(coalesce(role" in plan and "v_meta_value" not in plan and "body" not in plan
    subset.build_index(spark, str(path), columns=("message",), folder=folder)
    assert len(calls) == 1
    path.write_text(synth.dump(posts=31, seed=6))
    subset.build_index(spark, str(path), columns=("message",), folder=folder)
    assert len(calls) == 2
    store.drop(spark, folder)
    assert not store.complete(spark, folder, {}) and not (tmp_path / "kept" / "rows").exists()
    subset.build_index(spark, str(path), columns=("message",), folder=folder)
    assert len(calls) == 3


def test_exact_reading_gives_the_same_index(spark, tmp_path):
    ship(spark)
    path = tmp_path / "dump.sql"
    path.write_text(synth.dump(posts=30, seed=8, complete=False, triggers=True))
    one, other = subset.build_index(spark, str(path)), subset.build_index(spark, str(path), exact=True)
    for name in ("posts", "postmeta", "meta_refs", "term_relationships", "tables"):
        first, second = (x.frames[name].drop("create_sql", "other_bytes").collect() for x in (one, other))  # the walk leaves a line break to the next statement
        assert sorted(map(str, first)) == sorted(map(str, second)), name


@pytest.mark.parametrize(("broadcast", "filtered"), [(1000, 1000), (0, 1000), (0, 0)])
def test_semi_joins(spark, broadcast, filtered):
    """By broadcast, by the filter, by a shuffle: the same rows."""
    from quarry.operators import keep

    ship(spark)
    rows = spark.range(3000).selectExpr("cast(id % 7 as int) as site", "if(id % 11 = 0, null, id) as id", "id as payload")
    keys = spark.range(0, 6000, 9).selectExpr("cast(id % 7 as int) as site", "cast(id as int) as id").union(spark.createDataFrame([(1, None), (0, 0)], "site int, id int"))
    found = keep.semi_join(rows, keys, ["site", "id"], broadcast, filtered)
    assert found.columns == rows.columns
    assert sorted(r.payload for r in found.collect()) == [i for i in range(3000) if i % 9 == 0 and i % 11]
    assert keep.semi_join(rows, keys.limit(0), ["site", "id"], broadcast, filtered).count() == 0
