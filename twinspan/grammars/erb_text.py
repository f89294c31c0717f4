"""HTML with Ruby in tags: grammar and lexer.

Every element that isn't void and every Ruby construct opened is closed, one within the other. The Ruby code of all tags
together is a Ruby program, which the Ruby tables check.
"""

from __future__ import annotations

import re
from functools import lru_cache

from twinspan.grammars import lr, ruby_text

GRAMMAR = """
text: nodes ;
nodes: | nodes node ;
node: RUBY | OPEN nodes CLOSE | RUBY_OPEN nodes branches RUBY_CLOSE ;
branches: | branches RUBY_BRANCH nodes ;
"""

#: Elements without content: fixed list of the HTML standard.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements whose content is text, not markup.
RAW = frozenset(("script", "style", "textarea", "title"))
_TAG = re.compile(r"<%(%|#|=|-)?(.*?)(?:-)?%>", re.S)
_MARK = ""
_OPEN = re.compile(r"<([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*?)(/?)>")
_CLOSE = re.compile(r"</([A-Za-z][^\s/>]*)\s*>")
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?=[ \t\r\n]|\Z)", re.M)


@lru_cache(maxsize=1)
def ruby_tables() -> lr.Tables:
    return lr.build(ruby_text.GRAMMAR)


def ruby_error(text: str) -> int | None:
    """The place of the first error in a Ruby text, or None."""
    lexer = ruby_text.Lexer(text)
    try:
        lexer.run()
        end = None
    except ruby_text.Unlexable as e:
        end = e.place
    tables = ruby_tables()
    first = [end] if end is not None else []
    for kinds, places in lexer.parts:
        if (k := lr.parse(tables, kinds)) is not None and (end is None or k < len(places)):
            first.append(places[k] if k < len(places) else len(text))
    return min(first) if first else None


@lru_cache(maxsize=100_000)
def _fragment(code: str) -> str:
    """What the code of one tag is to the constructs around it."""
    word = re.match(r"\s*(\}|[a-z]+\b)", code)
    first = word[1] if word else ""
    if first in ("else", "elsif", "when", "in", "rescue", "ensure"):
        return "RUBY_BRANCH"
    if first in ("end", "}"):
        return "RUBY_CLOSE"
    if ruby_error(code) is None:
        return "RUBY"
    if any(ruby_error(f"{code}\n{rest}") is None for rest in ("end", "}", "when 1\nend", "in 1\nend")):
        return "RUBY_OPEN"
    return "ERROR"


def tokens(text: str) -> tuple[list[str], list[int], list[str], list[tuple[int, str]]]:
    """Token kinds, places and element names, and the Ruby code of the tags with its places. A place where no token
    begins is a token ERROR, and so is a line of an unresolved merge in the markup."""
    codes: list[tuple[int, str]] = []
    tags: dict[int, tuple[str, str]] = {}
    pieces, at = [], 0
    for m in _TAG.finditer(text):
        pieces.append(text[at : m.start()])
        at = m.end()
        if m[1] == "%":
            pieces.append(" " * len(m[0]))
        else:
            tags[m.start()] = m[1] or "", m[2]
            pieces.append(_MARK + " " * (len(m[0]) - 1))
    pieces.append(text[at:])
    html = "".join(pieces)
    kinds: list[str] = []
    places: list[int] = []
    names: list[str] = []

    def put(kind: str, place: int, name: str = "") -> None:
        kinds.append(kind)
        places.append(place)
        names.append(name)

    def ruby(start: int, end: int, nested: bool) -> None:
        place = html.find(_MARK, start, end)
        while place >= 0:
            sign, code = tags.get(place, ("", ""))
            if sign != "#":
                codes.append((place, code))
                put(_fragment(code.strip()), place)
            place = html.find(_MARK, place + 1, end)

    at, n = 0, len(html)
    while at < n:
        sign = re.compile(r"<|\Z").search(html, at).start()
        if sign > at or sign < n:
            m = _CONFLICT.search(html, at, min(sign + 7, n))
            if m and (m.start() == 0 or html[m.start() - 1] == "\n"):
                ruby(at, m.start(), False)
                put("ERROR", m.start())
                break
        ruby(at, sign, False)
        if sign >= n:
            break
        if html.startswith("<%", sign):
            put("ERROR", sign)
            break
        if html.startswith("<!--", sign):
            end = html.find("-->", sign + 4)
            if end < 0:
                put("ERROR", sign)
                break
            ruby(sign, end, True)
            at = end + 3
        elif html.startswith("</", sign):
            m = _CLOSE.match(html, sign)
            if m is None:
                put("ERROR", sign)
                break
            put("CLOSE", sign, m[1].lower())
            at = m.end()
        elif html.startswith(("<!", "<?"), sign):
            end = html.find(">", sign)
            if end < 0:
                put("ERROR", sign)
                break
            at = end + 1
        elif sign + 1 < n and html[sign + 1].isalpha():
            m = _OPEN.match(html, sign)
            if m is None:
                put("ERROR", sign)
                break
            name = m[1].lower()
            ruby(sign, m.end(), True)
            at = m.end()
            if name not in VOID and not m[3]:
                put("OPEN", sign, name)
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                    if end is None:
                        put("ERROR", sign)
                        break
                    ruby(at, end.start(), True)
                    at = end.start()
        else:
            at = sign + 1
    return kinds, places, names, codes
