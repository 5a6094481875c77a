"""The dump as a data source: ranges of any size give what one walk gives, columns are picked and typed, other spellings are read alike."""

import gzip
import random

import pytest

from quarry.session import ship
from quarry.sources import dump, sqldump, synth

from .test_dump_splits import HOSTILE


def walked(data):
    """(kind, table, bytes) of a dump's statements by the walk over lines."""
    cutter, out = dump.Cutter(), []
    for line in data.splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data.split(b"\n")[:-1]]:
        out += cutter.feed(line)
    return out + ([b"".join(cutter.parts)] if cutter.parts else []), cutter.state


def read(spark, path, data, size):
    ship(spark)
    path.write_bytes(data)
    found = sqldump.scan(spark, str(path), size)
    return found, [bytes(r.raw) for r in sqldump.statements(spark, str(path), layout=found).orderBy("ord").collect()]


@pytest.mark.parametrize("size", [1 << 20, 300, 64, 23, 7])
def test_ranges_of_hostile_text(spark, tmp_path, size):
    layout, found = read(spark, tmp_path / "d.sql", HOSTILE, size)
    assert found == walked(HOSTILE)[0]
    assert layout.tables == ["a`b", "t"] and layout.declared == {"a`b": ["x;y", "z"]}


@pytest.mark.parametrize("block", [4 << 20, 16])
def test_ranges_like_one_walk(spark, tmp_path, monkeypatch, block):
    rng = random.Random(3)
    monkeypatch.setattr(sqldump, "BLOCK", block)  # of this process: the listing below
    pieces = [b"INSERT INTO t VALUES ('", b"'", b'"x;\n"', b";\n", b";", b"\n", b"\\'", b"-- c'\n", b"/* ;\n' */", b"a", b"`k;`", b"(", b")", b"# '\n", b"\r\n", b"\nDELIMITER ;;\n", b"\nDELIMITER ;\n"]
    for _ in range(40):
        data = b"".join(rng.choice(pieces) for _ in range(120)) + b"\n"
        want, state = walked(data)
        path = tmp_path / "r.sql"
        path.write_bytes(data)
        for size in (61, 17):
            # Ranges and their starts as `scan` chains them, without Spark.
            now, starts = sqldump.Start(), []
            for at in range(0, len(data), size):
                own = sqldump.Range(str(path), 0, at, min(len(data), at + size))
                starts.append(sqldump.Range(own.path, 0, own.begin, own.end, now))
                end, free, *_ = sqldump._looked(own, now)
                if free:
                    for fresh, is_open in ((True, False), (True, True), (False, True)):
                        assert sqldump._looked(own, sqldump.Start(now.state, now.delimiter, fresh, is_open))[0] == end
                now = end
            assert bool(now.state) == bool(state)
            if not state:
                assert [raw for r in starts for _, raw in sqldump.statements_of(r)] == want, data


def test_scan_chains_states(spark, tmp_path):
    rng = random.Random(8)
    pieces = [b"INSERT INTO t VALUES ('", b"');\n", b"x;\n", b"\\'", b"'' ", b"\n", b"/* '\n */", b"DELIMITER ;;\n", b"q ;;\nDELIMITER ;\n"]
    for _ in range(3):
        data = b"".join(rng.choice(pieces) for _ in range(150)) + b"\n"
        want, state = walked(data)
        if state:
            with pytest.raises(dump.DumpError):
                read(spark, tmp_path / "s.sql", data, 61)
        else:
            assert read(spark, tmp_path / "s.sql", data, 61)[1] == want


def test_rows_like_the_tuples(spark, tmp_path):
    ship(spark)
    text = synth.dump(posts=60, seed=9, triggers=True, hex_blob=True, statement_rows=3, complete=False).encode()
    path = tmp_path / "b.sql"
    path.write_bytes(text)
    want = [(t[1], body) for s in dump.statements(text) for t in [dump.classify(s)] if t[0] == "insert" for body, _ in dump.tuples(s)[1]]
    for size in (1 << 22, 900):
        layout = sqldump.scan(spark, str(path), size)
        found = sqldump.rows(spark, str(path), "_ord long, _row int, _tbl string, _bytes bigint, _body binary, id bigint, post_content string, meta_value string, data binary", layout).orderBy("_ord", "_row").collect()
        assert [(r._tbl, bytes(r._body)) for r in found] == want
        assert all(r._bytes == len(r._body) for r in found)
    statements = dump.read_statements(spark, str(path))
    named = {(r.tbl, r.bytes, r["values"].get("id"), r["values"].get("post_content"), r["values"].get("meta_value")) for r in dump.named_values(dump.read_rows(statements), statements, ("id", "post_content", "meta_value")).collect()}
    assert {(r._tbl, r._bytes, None if r.id is None else str(r.id), r.post_content, r.meta_value) for r in found} == named
    assert [bytes(r.data) for r in found if r.data] == [b"\x00\xff'", b"\x5c\x0a;\x0a"]


def test_values_and_types(spark, tmp_path):
    ship(spark)
    path = tmp_path / "v.sql"
    path.write_bytes(
        b"CREATE TABLE `t` (`id` int, `S` text, `x` double);\nINSERT INTO t VALUES (1,'a\\'b''c\\n',1.5),(-2,NULL,null),(3,0x4142,-1e3), (4 , 'x' , 7);\n"
        b"INSERT INTO t (x, id) VALUES (concat('a','b,)'),5),(b'1',6) ON DUPLICATE KEY UPDATE id = values(id);\nREPLACE INTO `t` VALUES (7,_utf8mb4'\xc3\xa9',.5),('8',\"d\"\"q\",'9'),(9,'\xff',1,2);\nINSERT INTO u VALUES (1,'no columns are known');\n"
    )
    for layout in (sqldump.scan(spark, str(path)), None):
        reader = sqldump.source(spark, str(path), layout)
        found = reader.schema("_tbl string, _tail binary, id bigint, s string, x double").load().where("_tbl = 't'").collect()
        assert [(r.id, r.s, r.x) for r in found] == [(1, "a'b'c\n", 1.5), (-2, None, None), (3, "AB", -1000.0), (4, "x", 7.0), (5, None, None), (6, None, None), (7, "é", 0.5), (8, 'd"q', 9.0), (None, None, None)]
        assert [bytes(r._tail) if r._tail else None for r in found][4:6] == [b"ON DUPLICATE KEY UPDATE id = values(id)"] * 2 and found[0]._tail is None
    base = sqldump.source(spark, str(path)).load()
    assert base.columns == ["_ord", "_row", "_tbl", "_bytes", "_columns", "_body", "_tail", "_fit", "_size"] and base.count() == 10
    assert base.where("_columns is not null").select("_columns").first()[0] == ["x", "id"]


def test_folders_gzip_nothing(spark, tmp_path):
    ship(spark)
    text = synth.dump(posts=20, seed=2).encode()
    (tmp_path / "many").mkdir()
    for i, own in enumerate((text, text)):
        (tmp_path / "many" / f"part-{i}").write_bytes(own)
    (tmp_path / "many" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "a.sql.gz").write_bytes(gzip.compress(text))
    (tmp_path / "none.sql").write_bytes(b"")
    one = sum(len(list(dump.tuples(s)[1])) for s in dump.statements(text))
    assert sqldump.rows(spark, str(tmp_path / "many"), "_tbl string").count() == 2 * one
    assert sqldump.rows(spark, str(tmp_path / "a.sql.gz"), "_tbl string").count() == one == sqldump.rows(spark, f"file://{tmp_path}/a.sql.gz", "_tbl string").count()
    assert sqldump.rows(spark, str(tmp_path / "none.sql"), "_tbl string").count() == 0
    (tmp_path / "open.sql").write_bytes(b"INSERT INTO t VALUES ('abc\n")
    with pytest.raises(dump.DumpError):
        sqldump.scan(spark, str(tmp_path / "open.sql"))


def test_tuples_again(spark, tmp_path):
    """Rows as tuples, as a copy has them, give the same columns."""
    ship(spark)
    path = tmp_path / "c.sql"
    path.write_bytes(synth.dump(posts=15, seed=4, complete=False).encode())
    statements = dump.read_statements(spark, str(path))
    layout = sqldump.scan(spark, str(path))
    ddl = "_row int, _tbl string, _body binary, id bigint, post_excerpt string"
    again = sqldump.parsed(dump.read_rows(statements), layout.declared, ddl)
    key = lambda r: (r._tbl, r._row, bytes(r._body), r.id or 0, r.post_excerpt or "")
    assert sorted(map(key, again.collect())) == sorted(map(key, sqldump.rows(spark, str(path), ddl, layout).collect()))
