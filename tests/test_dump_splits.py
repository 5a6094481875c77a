"""Dumps read in splits: any bytes in strings, line ends of either kind, delimiters, statements that go over splits."""

import random

import pytest

from quarry.session import ship
from quarry.sources import dump, synth


def read(spark, path, data, size):
    ship(spark)
    path.write_bytes(data)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for key, value in zip(keys, (str(size), "0", "1"), strict=True):
        spark.conf.set(key, value)
    try:
        return sorted((r.ord, bytes(r.raw), r.kind, r.tbl) for r in dump.read_statements(spark, str(path)).collect())
    finally:
        for key in keys:
            spark.conf.unset(key)


HOSTILE = (
    b"-- head; 'not a string\n/*!40101 SET NAMES latin1 */;\r\nCREATE TABLE `a``b` (\r\n  `x;y` int,\n  `z` text DEFAULT ';\n'\n);\n"
    b"INSERT INTO `a``b` VALUES (1,'a;\nb'),(2,'it''s \\' ;\\\n'),\n(3,'\xe9\xff\x00-- \"');\r\nINSERT INTO t VALUES (1); INSERT INTO t VALUES ('/*');\n"
    b"/* a; comment\n over ' lines; */ SELECT 1;\n# DELIMITER ;;\n-- x\nDELIMITER ;;\nCREATE TRIGGER q BEFORE INSERT ON t FOR EACH ROW BEGIN SET @a = ';;'; SELECT 1; END ;;\nDELIMITER ;\n"
    b"INSERT INTO t VALUES (5-1,'x--y',\"a;\n';\");\n-- done\n"
)


@pytest.mark.parametrize("size", [1 << 20, 64, 23])
def test_hostile(spark, tmp_path, size):
    found = read(spark, tmp_path / "d.sql", HOSTILE, size)
    assert b"".join(r for _, r, _, _ in found) == HOSTILE
    assert [(k, t) for _, _, k, t in found if k in ("insert", "create_table", "create_trigger")] == [("create_table", "a`b"), ("insert", "a`b"), ("insert", "t"), ("insert", "t"), ("create_trigger", "t"), ("insert", "t")]
    columns, rows = dump.tuples(found[2][1])
    values = [[dump.decode(*v) for v in own] for _, own in rows]
    assert columns is None and values == [[b"1", b"a;\nb"], [b"2", b"it's ' ;\n"], [b"3", b"\xe9\xff\x00-- \""]]


def test_like_one_walk(spark, tmp_path):
    """Random texts of quotes, comments and ends, in small splits, against a walk of the whole."""
    rng = random.Random(3)
    pieces = [b"INSERT INTO t VALUES ('", b"'", b'"x;\n"', b";\n", b";", b"\n", b"\\'", b"-- c'\n", b"/* ;\n' */", b"a", b"`k;`", b"(", b")", b"# '\n", b"\r\n"]
    for _ in range(4):
        data = b"".join(rng.choice(pieces) for _ in range(150))
        cutter, want = dump.Cutter(), []
        for line in [x + b"\n" for x in data.split(b"\n")]:
            want += cutter.feed(line)
        if cutter.state:
            with pytest.raises(dump.DumpError):
                read(spark, tmp_path / "r.sql", data + b"\n", 61)
            continue
        want += [b"".join(cutter.parts)] if cutter.parts else []
        assert [r for _, r, _, _ in read(spark, tmp_path / "r.sql", data + b"\n", 61)] == want


def test_synth_in_splits(spark, tmp_path):
    text = synth.dump(posts=60, seed=9, triggers=True, hex_blob=True, statement_rows=3).encode()
    one, many = read(spark, tmp_path / "a.sql", text, 1 << 22), read(spark, tmp_path / "b.sql", text, 4000)
    assert [x[1:] for x in one] == [x[1:] for x in many] and b"".join(x[1] for x in many) == text
    bodies = lambda found: [b for x in found for b, _ in dump.tuples(x)[1]]
    assert bodies(x[1] for x in one if x[2] == "insert") == bodies(x for x in dump.statements(text) if dump.classify(x)[0] == "insert")
