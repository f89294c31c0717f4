"""JSON (RFC 8259): grammar and lexer."""

from __future__ import annotations

import re

GRAMMAR = """
text: value ;
value: OBJECT | '{' '}' | '{' members '}' | '[' ']' | '[' values ']' | STRING | NUMBER | NAME ;
members: STRING ':' value | members ',' STRING ':' value ;
values: value | values ',' value ;
"""

_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(true|false|null)\b|([{}\[\]:,])|(.)|\Z)', re.S | re.A)


def tokens(text: str) -> tuple[list[str], list[int]]:
    """Token kinds and their places; a character that begins no token is a token ERROR."""
    kinds: list[str] = []
    places: list[int] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        group = m.lastindex
        if group is None:
            break
        kinds.append(("STRING", "NUMBER", "NAME", f"'{m[4]}'", "ERROR")[group - 1])
        places.append(m.start(group))
        at = m.end()
    return kinds, places
