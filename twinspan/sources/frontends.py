"""Front ends: texts to tables of tree nodes, by language.

Rows are those of ``twinspan.operators.fingerprints``: (entry_id, preorder, subtree_end, parent, pos, depth, kind, label,
start_line, end_line, is_sequence), with digest, size and child_digests. Plain text and baskets need no parser and stay in the engine; the others are parsed by
the executors, a text at a time.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.operators.fingerprints import node_digests

NODES = "entry_id bigint, preorder int, subtree_end int, parent int, pos int, depth int, kind string, label string, start_line int, end_line int, is_sequence boolean, digest string, size int, child_digests array<string>"
#: Their types in Arrow, but for the entry's.
NODE_TYPES = (*(pa.int32(),) * 5, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.string()))
#: A tree while it is built: kind, label, first and last line, children, whether they are a run of statements.
Tree = tuple[str, str | None, int, int, list, bool]


def flattened(tree: Tree) -> list[tuple]:
    """Rows of a tree in preorder, without recursion: (preorder, subtree_end, parent, pos, depth, kind, label, ...)."""
    rows: list[list] = []
    todo: list[tuple[Tree | int, int, int, int]] = [(tree, -1, 0, 0)]
    while todo:
        node, parent, pos, depth = todo.pop()
        if isinstance(node, int):
            rows[node][1] = len(rows) - 1
            continue
        kind, label, first, last, children, sequence = node
        at = len(rows)
        rows.append([at, at, parent, pos, depth, kind, label, first, last, sequence])
        todo.append((at, 0, 0, 0))
        todo += [(child, at, k, depth + 1) for k, child in reversed(list(enumerate(children)))]
    return [tuple(r) for r in rows]


def tree_rows(tree: Tree) -> list[tuple]:
    """Rows of a tree in preorder, with digests."""
    rows = flattened(tree)
    return [(*r, *d) for r, d in zip(rows, zip(*node_digests([(r[0], r[2], r[3], r[5], r[6]) for r in rows]), strict=True), strict=True)]


def _text_digest(kind: str, label: Column, children: Column | None = None) -> Column:
    head = F.concat(F.encode(F.lit(kind), "utf-8"), F.lit(b"\0"), F.encode(label, "utf-8"), F.lit(b"\0"))
    whole = head if children is None else F.concat(head, F.unhex(F.array_join(children, "")))
    return F.substring(F.sha2(whole, 256), 1, 16)


def text_fingerprints(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digests, lines, at): a text as a tree of lines of words: the distinct digests of its words, lines and whole, its
    lines' digests in order, and their numbers. Blank lines have no node; null texts give no row. All inside the engine."""
    rows = documents.where(F.col(text).isNotNull()).select(key, F.split(text, r"\r?\n").alias("_l"))
    words = F.transform("_l", lambda x, i: F.struct(F.filter(F.split(x, r"\s+"), lambda w: w != "").alias("w"), (i + 1).alias("at")))
    rows = rows.select(key, F.filter(words, lambda x: F.size(x["w"]) > 0).alias("_s")).select(key, F.col("_s.w").alias("_w"), F.col("_s.at").alias("at"))
    digests = rows.select(key, "at", F.transform("_w", lambda x: F.transform(x, lambda w: _text_digest("word", w))).alias("_d"))
    lines = digests.select(key, "at", "_d", F.transform("_d", lambda x: _text_digest("line", F.lit(""), x)).alias("lines"))
    whole = _text_digest("text", F.lit(""), F.col("lines"))
    return lines.select(key, F.array_distinct(F.concat(F.flatten("_d"), "lines", F.array(whole))).alias("digests"), "lines", "at")


def basket_sets(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, digests): the distinct items of each basket; null items add nothing."""
    return rows.where(F.col(item).isNotNull()).groupBy(key).agg(F.collect_set(item).alias("digests"))


class _Html(HTMLParser):
    """A tree of elements, attribute names and text marks."""

    VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
    #: Attributes whose values say what an element does.
    BEHAVIOUR = ("data-controller", "data-action")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["document", None, 1, 1, [], True]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line = self.getpos()[0]
        last = line + (self.get_starttag_text() or "").count("\n")
        own = [("attribute", name, line, last, [("literal", value if name in self.BEHAVIOUR else None, line, last, [], False)] if value is not None else [], False) for name, value in attrs]
        node: list = ["element", tag, line, last, own, False]
        self.open[-1][4].append(node)
        if tag not in self.VOID:
            body: list = ["html_body", None, last, last, [], True]
            node[4].append(body)
            self.open += [node, body]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == "element" and self.open[k][1] == tag:
                for node in self.open[k:]:
                    node[3] = max(node[3], self.getpos()[0])
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        for body in self.open:
            body[3] = max(body[3], self.getpos()[0] + data.count("\n"))


def html_tree(text: str) -> Tree:
    parser = _Html()
    parser.feed(text)
    parser.close()
    return tuple(parser.root)


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^\s{}\[\],:"]+|(:)|\n')


def json_tree(text: str) -> Tree:
    """Objects, arrays and literals of a JSON text, with the lines that each takes. A repeated name's members all count."""
    json.loads(text)  # raises where the text is none
    line, open_nodes = 1, [["text", None, 1, 1, [], True]]
    last = ""  # the last string, which a colon makes a name
    for m in _JSON.finditer(text):
        token = m.group()
        if token == "\n":
            line += 1
        elif m[1]:
            held = open_nodes[-1][4].pop()
            member = ["member", json.loads(last), held[2], line, [], False]
            open_nodes[-1][4].append(member)
            open_nodes.append(member)
        elif token in "}]":
            open_nodes.pop()[3] = line
            _shut(open_nodes, line)
        else:
            last = token
            node = [{"{": "object", "[": "array"}.get(token, "literal"), None, line, line, [], token in "{["]
            open_nodes[-1][4].append(node)
            if token in "{[":
                open_nodes.append(node)
            else:
                _shut(open_nodes, line)
    return _frozen(open_nodes[0][4][0])


def _shut(open_nodes: list[list], line: int) -> None:
    """A value has ended: so has the member that it is the value of."""
    if open_nodes[-1][0] == "member":
        open_nodes.pop()[3] = line


def _frozen(node: list) -> Tree:
    return (*node[:4], [_frozen(x) for x in node[4]], node[5])


#: Fields of Python nodes that name what is called or defined and stay; other names become marks.
_KEPT = {"Attribute": "attr", "FunctionDef": None, "Call": None}


def python_tree(text: str) -> Tree:
    """Statements and expressions; variables, constants and definitions' names are marks, called names and attributes stay."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        module = ast.parse(text)

    def tree(node: ast.AST, called: bool = False) -> Tree:
        first = getattr(node, "lineno", 1)
        last = getattr(node, "end_lineno", None) or first
        if isinstance(node, ast.Constant):
            return ("literal", None, first, last, [], False)
        if isinstance(node, ast.Name):
            return ("name", node.id, first, last, [], False) if called else ("local", None, first, last, [], False)
        label = node.attr if isinstance(node, ast.Attribute) else type(node.op).__name__ if isinstance(node, ast.BinOp | ast.UnaryOp | ast.BoolOp | ast.AugAssign) else None
        children: list[Tree] = []
        for name, value in ast.iter_fields(node):
            if isinstance(value, ast.AST) and not isinstance(value, ast.operator | ast.unaryop | ast.boolop | ast.expr_context):
                children.append(tree(value, isinstance(node, ast.Call) and name == "func"))
            elif isinstance(value, list):
                own = [tree(x) for x in value if isinstance(x, ast.AST)]
                if name in ("body", "orelse", "finalbody") and own:
                    children.append((name, None, own[0][2], own[-1][3], own, True))
                else:
                    children += own
        return (type(node).__name__, label, first, max([last, *(c[3] for c in children)]), children, isinstance(node, ast.Module))

    return tree(module)


#: Front ends by language. Each takes a text and gives its tree; an error means that the text has none.
FRONT_ENDS: dict[str, Callable[[str], Tree]] = {"html": html_tree, "json": json_tree, "python": python_tree}


def tree_nodes(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """Node rows of every text by the front end its language column names (null and unknown languages, null texts, and texts
    that the front end can't read give none). key is a BIGINT and becomes entry_id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), *NODE_TYPES)
        names = [part.split()[0] for part in NODES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for own, value, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                front = FRONT_ENDS.get(kind)
                if front is None or value is None:
                    continue
                try:
                    rows += [(own, *r) for r in tree_rows(front(value))]
                except (ValueError, SyntaxError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return texts.select(F.col(key).cast("bigint"), text, language).mapInArrow(read, NODES)
