"""Table definitions that more servers accept, by a walk over their tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Types whose columns take a default only as an expression.
EXPRESSION_ONLY = frozenset("tinytext text mediumtext longtext tinyblob blob mediumblob longblob json geometry point linestring polygon multipoint multilinestring multipolygon geometrycollection".split())
_TOKEN = re.compile(
    r"""(?P<blank>\s+|/\*.*?\*/)|(?P<string>(?:_\w+\s*)?'(?:[^'\\]|\\.|'')*')|(?P<name>`(?:[^`]|``)*`)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?(?![\w.]))|(?P<word>[\w$.]+)|(?P<mark>.)""",
    re.S | re.I | re.X,
)


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, token, place) of a definition; an introducer is part of its string, a sign and an exponent of their number."""
    for found in _TOKEN.finditer(text):
        yield found.lastgroup, found[0], found.start()


def portable_defaults(create: str) -> str:
    """Literal defaults of text, blob, JSON and spatial columns in parentheses, which makes them expressions. NULL and expressions stay, and so does text that defines no table."""
    depth, opened = 0, False
    column: list[str] = []  # the name, type and words of the column at hand
    out, done = [], 0
    for kind, token, at in tokens(create):
        if kind == "blank":
            continue
        if token == "(":
            depth += 1
            if not opened:
                opened, column = True, []
                continue
        elif token == ")":
            depth -= 1
            if opened and depth == 0:
                break
        elif token == "," and depth == 1:
            column = []
            continue
        if not opened:
            continue
        if depth == 1 and token != ")":
            literal = kind in ("string", "number")
            if literal and column and column[-1] == "default" and len(column) > 2 and column[0] == "" and column[1] in EXPRESSION_ONLY:
                out += [create[done:at], "(", token, ")"]
                done = at + len(token)
            # A column's own name is none of its words.
            column.append("" if not column and kind in ("name", "word") and token.upper() not in _KEYS else token.lower())
    return "".join(out) + create[done:]


_KEYS = frozenset("PRIMARY UNIQUE FULLTEXT SPATIAL KEY INDEX CONSTRAINT FOREIGN CHECK PERIOD".split())
