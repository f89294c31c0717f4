"""ERB front end: a template is one unit, a tree of elements, text left out, with the Ruby of its tags in it."""

from __future__ import annotations

import re
from functools import lru_cache

from twinspan.grammars import erb_text, lr
from twinspan.sources import ruby

_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_LOCALS = re.compile(r"#\s*locals:\s*\((.*)\)\s*\Z", re.S)
#: Attributes whose values say what an element does.
BEHAVIOUR = ("data-controller", "data-action")
_tables: list[lr.Tables] = []


def _check(text: str) -> None:
    if not _tables:
        _tables.append(lr.build(erb_text.GRAMMAR))
    kinds, places, names, codes = erb_text.tokens(text)
    pairs = {i for i, r in enumerate(_tables[0].rules) if r == ("node", 3)}

    def reduced(rule: int, first: int, last: int) -> bool:
        return rule not in pairs or kinds[first] != "OPEN" or names[first] == names[last - 1]

    k = lr.parse(_tables[0], kinds, reduced)
    if k is not None:
        place = places[k] if k < len(places) else len(text)
        raise ruby.Unreadable(text.count("\n", 0, place) + 1, f"unexpected {kinds[k] if k < len(kinds) else 'end of the file'}")
    if erb_text.ruby_error("\n".join(code for _, code in codes)) is not None:
        raise ruby.Unreadable(1, "the code of the tags is no program")


def identity(path: str) -> str:
    """A template's name: its path in app/, without its extensions and a partial's underscore kept."""
    return path.removeprefix("app/")


def _code(code: str) -> list[tuple]:
    """Trees of the statements of a tag's code, which may open a construct that others close."""
    tail = next((t for t in ("", "\nend", "\n}", "\nwhen 1\nend", "\nin 1\nend") if erb_text.ruby_error(code + t) is None), None)
    if tail is None:
        return []
    program = ruby.Reader(code + tail).program()
    return [ruby.normalized(c, template=True) for c in (program.children if program.kind == "statements" else [program])]


#: Code of up to so many characters, which templates repeat, is kept with its trees.
_SHORT = 100
_short_code = lru_cache(maxsize=10_000)(_code)


def template_tree(text: str) -> tuple:
    """The tree of a template; an error is an Unreadable."""
    _check(text)
    tags: dict[int, tuple[str, str, int]] = {}
    for m in erb_text._TAG.finditer(text):
        if m[1] != "%":
            tags[m.start()] = m[1] or "", m[2], m.end()
    line = lambda place: text.count("\n", 0, place) + 1
    last = max(text.count("\n") + (not text.endswith("\n")), 1)
    root: list = ["document", None, 1, last, [], True]
    stack: list[list] = [root]
    for sign, code, _ in tags.values():
        if sign == "#" and (m := _LOCALS.match("#" + code)):
            names = [x.split(":")[0].strip() for x in m[1].split(",") if x.strip()]
            root[4].append(("strict_locals", None, 1, 1, [(":local", None, 1, 1, [], False) for _ in names], False))

    def shape(code: str, place: int) -> list[tuple]:
        """Trees of a tag's statements, on the tag's lines."""
        own = line(place)

        def moved(tree: tuple) -> tuple:
            kind, label, first, end, children, sequence = tree
            return (kind, label, min(first + own - 1, last), min(end + own - 1, last), [moved(c) for c in children], sequence)

        return [moved(c) for c in (_short_code if len(code) <= _SHORT else _code)(code)]

    def put(tree: object) -> None:
        stack[-1][4].append(tree)

    def code_tag(place: int) -> None:
        sign, code, end = tags[place]
        code = code.strip()
        if sign == "#" or not code:
            return
        role, own, until = erb_text._fragment(code), line(place), line(end - 1)
        if role == "RUBY":
            put(("erb_output" if sign == "=" else "erb_code", None, own, until, shape(code, place), False))
        elif role == "RUBY_OPEN":
            node: list = ["erb_construct", None, own, until, shape(code, place), False]
            body: list = ["erb_body", None, until, until, [], True]
            node[4].append(body)
            put(node)
            stack.extend((node, body))
        elif role == "RUBY_BRANCH":
            stack.pop()
            word, _, rest = code.partition(" ")
            body = ["erb_body", None, until, until, [], True]
            stack[-1][4].append(["erb_branch", word, own, until, [*shape(rest.removesuffix("then"), place), body], False])
            stack.append(body)
        elif role == "RUBY_CLOSE" and len(stack) > 2:
            stack.pop()
            stack.pop()

    at, n = 0, len(text)
    while at < n:
        sign = text.find("<", at)
        if sign < 0:
            break
        if sign in tags:
            code_tag(sign)
            at = tags[sign][2]
        elif text.startswith("<!--", sign):
            at = text.index("-->", sign) + 3
        elif m := erb_text._CLOSE.match(text, sign):
            while len(stack) > 1 and not (stack[-1][0] == "element"):
                stack.pop()
            if len(stack) > 1:
                stack.pop()
            at = m.end()
        elif sign + 1 < n and text[sign + 1].isalpha() and (m := _open(text, sign, tags)):
            name, inner, closed, at = m
            own, until = line(sign), line(at - 1)
            children: list = [_attribute(a, own, until) for a in _ATTRIBUTE.finditer(inner)]
            node = ["element", name, own, until, children, False]
            put(node)
            for place in [p for p in tags if sign < p < at]:
                sort, code, _ = tags[place]
                if sort != "#" and erb_text._fragment(code.strip()) == "RUBY":
                    children.append(("erb_value", None, line(place), line(place), shape(code.strip(), place), False))
            if name not in erb_text.VOID and not closed:
                body = ["html_body", None, until, until, [], True]
                children.append(body)
                stack.extend((node, body))
                if name in erb_text.RAW:
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
                    for place in [p for p in tags if at <= p < end.start()]:
                        code_tag(place)
                    at = end.start()
        else:
            at = sign + 1
    return _closed(root)


def _open(text: str, sign: int, tags: dict[int, tuple[str, str, int]]) -> tuple[str, str, bool, int] | None:
    """(name, attributes with code blanked out, closed by itself, place after) of an opening tag."""
    blank = list(text[sign : sign + 100_000])
    for place, (_, _, end) in tags.items():
        if sign <= place < sign + len(blank):
            for k in range(place - sign, min(end - sign, len(blank))):
                blank[k] = "\n" if blank[k] == "\n" else "_"
    m = erb_text._OPEN.match("".join(blank))
    return (m[1].lower(), m[2], bool(m[3]), sign + m.end()) if m else None


def _attribute(m: re.Match, first: int, last: int) -> tuple:
    name, value = m[1].lower(), m[2]
    if value is None:
        return ("attribute", name, first, last, [], False)
    kept = value.strip("\"'") if name in BEHAVIOUR and "_" * 4 not in value else None
    return ("attribute", name, first, last, [("stimulus_value" if kept is not None else ":literal", kept, first, last, [], False)], False)


def _closed(node: list | tuple) -> tuple:
    """A tree of tuples, every node reaching to its children's last line."""
    kind, label, first, last, children, sequence = node
    own = [_closed(c) for c in children]
    return (kind, label, first, max([last, *(c[3] for c in own)]), own, sequence)
