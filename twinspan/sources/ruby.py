"""Ruby front end: units of a source text, and their trees with names of things replaced by marks.

The bundled tables parse the text; what a rule stands for becomes a node. Normalizing keeps names of behaviour (methods
called, operators) and replaces names of things (variables, constants, literals), so that two methods that do the same with
other names have one tree.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from twinspan.grammars import lr, ruby_text
from twinspan.grammars.erb_text import ruby_error, ruby_tables

#: Class-level macros whose block or lambda is a unit.
DSL = frozenset(
    """scope default_scope validate validates_each before_validation after_validation before_save around_save after_save before_create around_create after_create
    before_update around_update after_update before_destroy around_destroy after_destroy after_commit after_create_commit after_update_commit after_destroy_commit
    after_save_commit after_rollback after_initialize after_find after_touch before_action after_action around_action prepend_before_action append_before_action
    prepend_after_action append_after_action rescue_from before_perform after_perform around_perform before_enqueue after_enqueue around_enqueue""".split()
)
CLASS_BODIES = frozenset(("included", "prepended", "concerning"))
CLASS_EVALS = frozenset(("class_eval", "class_exec", "module_eval", "module_exec"))
DEFINERS = {"define_method": False, "define_singleton_method": True}
ROUTE_PROXIES = frozenset(("url_helpers", "main_app", "helpers", "routes"))
ROUTE = ":route"
STIMULUS_HASH_KEYS, STIMULUS_KEYS = ("controller", "action"), ("data-controller", "data-action")
_CONSTANT = re.compile(r"(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*\Z")
_RECEIVER = re.compile(r"(.+?)\s*(?:\.|::)\s*", re.S)
_MARKS = {"const": ":const", "constpath": ":const", "ivar": ":ivar", "cvar": ":cvar", "gvar": ":gvar", "number": ":literal", "symbol": ":literal", "string": ":literal", "regex": ":literal", "words": ":literal"}


class Unreadable(ValueError):
    """A text with an error; ``line`` is where."""

    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line = line


@dataclass(slots=True)
class Node:
    """A piece of syntax. ``name`` is a method's, variable's or operator's; ``text`` a literal's content."""

    kind: str
    children: list[Node] = field(default_factory=list)
    name: str | None = None
    text: str | None = None
    first: int = 1
    last: int = 1

    def child(self, kind: str) -> Node | None:
        return next((c for c in self.children if c.kind == kind), None)


@dataclass
class Unit:
    kind: str
    identity: str
    namespace: str | None
    name: str | None
    start_line: int
    end_line: int
    node: Node


#: Rules that only hold what a nonterminal holds, or list their parts.
_LISTS = frozenset("stmts args params bparams pairs items whens ins rescues plist pargs pairs_pattern mlist names many rhs_list command_args mlhs bparam_list".split())
#: Kinds of the nodes that tokens become; a class variable is told by its marks.
_LEAVES = {"IDENT": "ident", "FID": "ident", "CONST": "const", "IVAR": "ivar", "GVAR": "gvar", "NUMBER": "number", "SYMBOL": "symbol", "REGEX": "regex", "WORDS": "words", "FNAME": "fname", "LABEL": "symbol", "STRING": "string"}
#: Rules whose node is that of their only part.
_PASSING = frozenset(
    (("stmt", "expr"), ("expr", "arg"), ("expr", "command_call"), ("command_call", "command"), ("arg", "primary"), ("argument", "arg"), ("lhs", "variable"), ("primary", "variable"), ("primary", "literal"), ("primary", "call"), ("literal", "strings"))
)


@lru_cache(maxsize=1)
def _passing() -> frozenset[int]:
    tables = ruby_tables()
    return frozenset(k for k, (name, size) in enumerate(tables.rules) if size == 1 and (name, tables.rights[k][0]) in _PASSING)


class Reader:
    """Nodes of a Ruby text."""

    def __init__(self, text: str):
        self.text = text
        self.lexer = ruby_text.Lexer(text)
        try:
            self.lexer.run()
        except ruby_text.Unlexable as e:
            place = ruby_error(text) or e.place
            raise Unreadable(text.count("\n", 0, place) + 1, "text that no token begins with" if place == e.place else "unexpected token") from None
        self.breaks = [m.end() for m in re.finditer("\n", text)]

    def line(self, place: int) -> int:
        return bisect_right(self.breaks, place) + 1

    def program(self) -> Node:
        return self.part(len(self.lexer.parts) - 1)

    def part(self, index: int) -> Node:
        kinds, places = self.lexer.parts[index]
        self.kinds, self.places, self.ends = kinds, places, self.lexer.ends[index]
        made = lr.derive(ruby_tables(), kinds, self.made, _passing())
        if made is None:
            k = lr.parse(ruby_tables(), kinds) or 0
            place = places[k] if k < len(places) else len(self.text)
            raise Unreadable(self.line(place), f"unexpected {kinds[k] if k < len(kinds) else 'end of the file'}")
        return made if isinstance(made, Node) else Node("statements")

    def token(self, k: int) -> str:
        return self.text[self.places[k] : self.ends[k]]

    def node(self, kind: str, parts: list, first: int, last: int, name: str | None = None, text: str | None = None) -> Node:
        """A node over tokens first..last - 1, with the nodes among parts as children; lists among them are spliced."""
        children: list[Node] = []
        for part in parts:
            if isinstance(part, Node):
                children.append(part)
            elif isinstance(part, list):
                children += [x for x in part if isinstance(x, Node)]
        start = self.line(self.places[first]) if first < len(self.places) else 1
        end = self.line(max(self.ends[last - 1] - 1, self.places[last - 1])) if last > first else start
        if self.lexer.bottom:
            for k in range(first, last):
                if self.places[k] in self.lexer.bottom:
                    end = max(end, self.line(self.lexer.bottom[self.places[k]]))
        return Node(kind, children, name, text, start, max([end, *(c.last for c in children)]))

    def leaf(self, k: int) -> Node | None:
        made = _LEAVES.get(self.kinds[k])
        if made is None:
            return None
        word = self.token(k)
        if made == "ivar" and word.startswith("@@"):
            made = "cvar"
        inside = self.lexer.inner.get(self.places[k])
        out = self.node(made, [], k, k + 1, word, self.content(k))
        if inside:
            saved = self.kinds, self.places, self.ends
            out.kind = f"interpolated_{made}"
            out.children = [Node("embedded_statements_node", [c] if c.children else [], first=c.first, last=c.last) for c in (self.part(i) for i in inside)]
            self.kinds, self.places, self.ends = saved
        return out

    def content(self, k: int) -> str | None:
        word = self.token(k)
        if self.kinds[k] == "LABEL":
            word = word[:-1]
            return word[1:-1] if word[:1] in "\"'" else word
        if self.kinds[k] == "SYMBOL":
            return word[1:].strip("\"'")
        if self.kinds[k] == "STRING" and word[:1] in "\"'":
            return word[1:-1]
        return None

    def made(self, name: str, right: tuple[str, ...], parts: list, first: int, last: int) -> object:
        own = _handler(name)
        if own is not None:
            found = own(self, right, parts, first, last)
            if found is not NotImplemented:
                return found
        values = [self.leaf(p) if isinstance(p, int) else p for p in parts]
        values = [v for v in values if v is not None]
        if name in _LISTS:
            out: list = values.pop(0) if values and isinstance(values[0], list) else []  # grown in place, as nothing else holds it
            for v in values:
                out += v if isinstance(v, list) else [v]
            return out
        if len(values) == 1:
            return values[0]
        if not values:
            return None if name not in ("primary",) else self.node(self.kinds[first].lower() + "_node", [], first, last)
        return self.node(f"{name}_node", values, first, last)

    # what each rule stands for

    def _program(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return parts[0] or Node("statements")

    def _compstmt(self, right, parts, first, last):  # noqa: ANN001, ANN202
        body = next((p for p in parts if isinstance(p, list)), None)
        if body is None:
            return None
        return Node("statements", body, first=body[0].first, last=max(x.last for x in body))

    def _stmt(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if len(right) == 3 and right[1] in ("IF_MOD", "UNLESS_MOD", "WHILE_MOD", "UNTIL_MOD"):
            body = Node("statements", [parts[0]], first=parts[0].first, last=parts[0].last)
            return self.node(right[1][:-4].lower() + "_node", [parts[2], body], first, last)
        if right[1:2] == ("RESCUE_MOD",):
            return self.node("rescue_modifier_node", parts, first, last)
        if right[:1] in (("lhs",), ("mlhs",)):
            value = parts[2] if isinstance(parts[2], Node) else self.node("array_node", [parts[2]], first, last)
            if right[0] == "mlhs":
                return self.node("multi_write_node", [*parts[0], value], first, last)
            return self._write(parts[0], value, first, last)
        return NotImplemented

    def _write(self, target: Node, value: Node, first: int, last: int, operator: str | None = None) -> Node:
        sort = {"ident": "local_variable", "ivar": "instance_variable", "cvar": "class_variable", "gvar": "global_variable", "const": "constant", "constpath": "constant_path"}.get(target.kind)
        word = {"||": "or", "&&": "and"}.get(operator or "", "operator")
        if sort is None:  # an attribute or an element
            name = target.name or ""
            if operator is None:
                return self.node("call_node", [*target.children, value], first, last, name + "=")
            index = name == "[]"
            return self.node(f"{'index' if index else 'call'}_{word}_write_node", [*target.children, value], first, last, " ".join(x for x in ("" if index else name, operator if word == "operator" else "") if x) or None)
        children = [target, value] if sort == "constant_path" else [value]
        if operator is None:
            return self.node(f"{sort}_write_node", children, first, last, text=target.name)
        return self.node(f"{sort}_{word}_write_node", children, first, last, operator if word == "operator" else None, target.name)

    def _lhs(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[:2] == ("primary", "INDEX"):
            return self.node("element", parts, first, last, "[]")
        if right[:2] == ("primary", "'.'") or right == ("primary", "'::'", "IDENT"):
            return self.node("attribute", [parts[0]], first, last, self.token(parts[2]))
        if right == ("primary", "'::'", "CONST"):
            return self.node("constpath", [parts[0]], first, last, self.token(parts[2]))
        if right == ("'::B'", "CONST"):
            return self.node("constpath", [], first, last, self.token(parts[1]))
        return NotImplemented

    _target = _lhs

    def _variable(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.leaf(parts[0])

    def _expr(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[0] == "NOT":
            return self.node("call_node", [parts[1]], first, last, "!")
        if right[1:2] in (("AND",), ("OR",)):
            return self.node(right[1].lower() + "_node", parts, first, last)
        if right[1:2] in (("'=>'",), ("IN",)):
            return self.node("match_required_node" if right[1] == "'=>'" else "match_predicate_node", parts, first, last)
        return NotImplemented

    def _command_call(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[0] == "'!'":
            return self.node("call_node", [parts[1]], first, last, "!")
        if right[0] == "lhs":
            if len(right) == 5:
                return self._write(parts[0], self.node("rescue_modifier_node", [parts[2], parts[4]], first, last), first, last)
            return self._write(parts[0], parts[2], first, last, None if right[1] == "'='" else self.token(parts[1])[:-1])
        return NotImplemented

    def _arguments(self, items: list[Node]) -> list[Node]:
        """An arguments node with trailing pairs in a keyword hash, and a block argument beside it."""
        block = [x for x in items if x.kind == "block_argument_node"]
        plain = [x for x in items if x.kind not in ("block_argument_node", "assoc_node", "assoc_splat_node")]
        pairs = [x for x in items if x.kind in ("assoc_node", "assoc_splat_node")]
        if pairs:
            plain.append(Node("keyword_hash_node", pairs, first=pairs[0].first, last=max(p.last for p in pairs)))
        out = [Node("arguments_node", plain, first=plain[0].first, last=max(p.last for p in plain))] if plain else []
        return out + block

    def _call_node(self, receiver: list, name: str, items: list | None, first: int, last: int, paren: bool = False) -> Node:
        out = self.node("call_node", [*receiver, *self._arguments([x for x in items or [] if isinstance(x, Node)])], first, last, name)
        out.text = "receiver" if receiver else "paren" if paren or items else None
        return out

    def _command(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[0] in ("IDENT", "FID", "CONST"):
            return self._call_node([], self.token(parts[0]), self._flat(parts[1]), first, last)
        if right[0] == "primary":
            name = self.token(parts[2]) if isinstance(parts[2], int) else parts[2].name
            return self._call_node([parts[0]], name, self._flat(parts[3]), first, last)
        if right[0] == "command":
            return self._with_block(parts[0], parts[2], first, last)
        kind = {"SUPER": "super_node", "YIELD": "yield_node", "RETURN": "return_node", "BREAK": "break_node", "NEXT": "next_node"}[right[0]]
        return self.node(kind, self._arguments(self._flat(parts[1])), first, last)

    def _flat(self, part: object) -> list[Node]:
        return [x for x in part if isinstance(x, Node)] if isinstance(part, list) else [part] if isinstance(part, Node) else []

    def _with_block(self, call: Node, block: Node, first: int, last: int) -> Node:
        if call.kind in ("ident", "const"):
            call = Node("call_node", [], call.name, None, call.first, call.last)
        out = self.node(call.kind, [*call.children, block], first, last, call.name, call.text)
        if call.kind == "super_node" and call.text == "bare":
            out.kind = "forwarding_super_node"
        return out

    def _method(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("ident", [], first, last, self.token(parts[0]))

    def _argument(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[0] == "STAR":
            return self.node("splat_node", parts, first, last)
        if right[0] == "AMPER":
            return self.node("block_argument_node", parts, first, last)
        return self._pair(right, parts, first, last)

    def _pair(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[0] == "DSTAR":
            return self.node("assoc_splat_node", parts, first, last)
        if right[0] == "LABEL":
            value = parts[1] if len(parts) > 1 else Node("implicit_node", first=self.line(self.places[first]), last=self.line(self.places[first]))
            return self.node("assoc_node", [self.leaf(parts[0]), value], first, last)
        if right[1:2] == ("'=>'",):
            return self.node("assoc_node", parts, first, last)
        if right[0] == "BDOT2":
            return self.node("forwarding_arguments_node", [], first, last)
        return NotImplemented

    def _item(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("splat_node", parts, first, last) if right[0] == "STAR" else NotImplemented

    def _arg(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[0] == "lhs":
            value = parts[2]
            if right[3:4] == ("RESCUE_MOD",):
                value = self.node("rescue_modifier_node", [parts[2], parts[4]], first, last)
            return self._write(parts[0], value, first, last, None if right[1] == "'='" else self.token(parts[1])[:-1])
        if len(right) == 1:
            return NotImplemented
        word = self.token(parts[1]) if isinstance(parts[1], int) else ""
        if right[1:2] in (("'&&'",), ("'||'",)):
            return self.node("and_node" if word == "&&" else "or_node", parts, first, last)
        if "DOT2" in right or "BDOT2" in right:
            return self.node("range_node", parts, first, last)
        if right[1] == "'?'":
            if right[2] == "LABEL":
                yes = Node("ident", name=self.token(parts[2])[:-1], first=self.line(self.places[first]), last=self.line(self.places[first]))
                return self._ternary(parts[0], yes, parts[3], first, last)
            return self._ternary(parts[0], parts[2], parts[4], first, last)
        if right[0] == "DEFINED":
            return self.node("defined_node", parts, first, last)
        if right[0] == "DEF":
            params = next((p for p in parts if isinstance(p, list)), None)
            return self._definition(parts[1], params, self.block_of([parts[-1]]), first, last)
        if right[0] in ("UMINUS", "'!'", "'~'"):
            sign = {"-": "-@", "+": "+@"}.get(self.token(parts[0]), self.token(parts[0]))
            if parts[1].kind == "number" and sign == "-@":
                return self.node("number", [], first, last)
            return self.node("call_node", [parts[1]], first, last, sign, "receiver")
        if len(right) == 3:
            return self._call_node([parts[0]], word, [parts[2]], first, last)
        return NotImplemented

    def _ternary(self, test: Node, yes: Node, no: Node, first: int, last: int) -> Node:
        other = Node("else_node", [self.block_of([no])], first=no.first, last=no.last)
        return self.node("if_node", [test, self.block_of([yes]), other], first, last)

    @staticmethod
    def block_of(items: list[Node]) -> Node:
        return Node("statements", items, first=items[0].first, last=max(x.last for x in items))

    def _endless(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("rescue_modifier_node", parts, first, last) if len(right) == 3 else NotImplemented

    def _paren_args(self, right, parts, first, last):  # noqa: ANN001, ANN202
        out: list[Node] = []
        for p in parts:
            out += self._flat(p)
        return out

    def _call(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right[0] in ("IDENT", "FID", "CONST"):
            return self._call_node([], self.token(parts[0]), parts[1], first, last, True)
        if right[0] == "SUPER":
            return self.node("super_node", self._arguments(parts[1]), first, last, text="paren")
        if right[1] == "INDEX":
            return self._call_node([parts[0]], "[]", self._flat(parts[2]), first, last)
        if right[2] == "paren_args":
            return self._call_node([parts[0]], "call", parts[2], first, last)
        name = self.token(parts[2]) if isinstance(parts[2], int) else parts[2].name
        return self._call_node([parts[0]], name, parts[3] if len(parts) > 3 else None, first, last)

    def _brace(self, right, parts, first, last):  # noqa: ANN001, ANN202
        inner = parts[1]
        return self.node("block_node", inner if isinstance(inner, list) else [inner], first, last)

    def _block_brace(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return [p for p in parts if isinstance(p, Node)]

    _block_body = _block_brace

    def _command_block(self, inner: object, first: int, last: int) -> Node:
        return self.node("block_node", inner if isinstance(inner, list) else [inner], first, last)

    def _block_params(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self._parameters(next((p for p in parts if isinstance(p, list)), []), first, last, "block_parameters_node")

    def _parameters(self, items: list[Node], first: int, last: int, wrap: str | None = None) -> Node:
        nodes = [x for x in items if isinstance(x, Node)]
        line = self.line(self.places[first]) if first < len(self.places) else 1
        out = Node("parameters_node", nodes, first=min([x.first for x in nodes], default=line), last=max([x.last for x in nodes], default=line))
        return Node(wrap, [out], first=out.first, last=out.last) if wrap else out

    def _param(self, right, parts, first, last):  # noqa: ANN001, ANN202
        sign = right[0]
        name = self.token(parts[0] if sign in ("IDENT", "LABEL") else parts[1]) if sign in ("IDENT", "LABEL") or len(right) > 1 and right[1] == "IDENT" else None
        kind = {"STAR": "rest_parameter_node", "DSTAR": "keyword_rest_parameter_node", "AMPER": "block_parameter_node", "BDOT2": "forwarding_parameter_node"}.get(sign)
        if sign == "IDENT":
            kind = "required_parameter" if len(right) == 1 else "optional_parameter_node"
        elif sign == "LABEL":
            name = name[:-1]
            kind = "required_keyword_parameter_node" if len(right) == 1 else "optional_keyword_parameter_node"
        elif sign == "LPAREN":
            return self.node("multi_target_node", [parts[1]], first, last)
        return self.node(kind, [p for p in parts if isinstance(p, Node)], first, last, text=name)

    _bparam = _param

    def _lambda_params(self, right, parts, first, last):  # noqa: ANN001, ANN202
        items = next((p for p in parts if isinstance(p, list)), None)
        return self._parameters(items, first, last, "block_parameters_node") if items else None

    def _def_args(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return next((p for p in parts if isinstance(p, list)), [])

    def _definition(self, name_at: int, params: list[Node] | None, body: Node | None, first: int, last: int) -> Node:
        name = self.token(name_at)
        whole = self.text[self.ends[first] : self.ends[name_at]].strip()
        receiver = _RECEIVER.fullmatch(whole[: -len(name)]) if whole.endswith(name) else None
        children = [self._parameters(params, first, last)] if params else []
        return self.node("def_node", [*children, body], first, last, name, receiver[1] if receiver else None)

    def _primary(self, right, parts, first, last):  # noqa: ANN001, ANN202
        head = right[0]
        if head == "LPAREN":
            return self.node("parentheses_node", [parts[1]], first, last)
        if head == "SELF":
            word = self.token(parts[0])
            return self.node("self_node" if word == "self" else "constant_literal", [], first, last, word)
        if head in ("call", "IDENT", "FID", "CONST", "SUPER") and right[1:] == ("brace",):
            base = parts[0] if isinstance(parts[0], Node) else self.leaf(parts[0]) or Node("super_node", [], None, "bare")
            return self._with_block(base, parts[1], first, last)
        if head == "LBRACK":
            return self.node("array_node", self._gathered(parts), first, last)
        if head == "HASH":
            return self.node("hash_node", parts, first, last)
        if right == ("primary", "'::'", "CONST"):
            return self.node("constpath", [parts[0]], first, last, self.token(parts[2]))
        if head == "'::B'":
            return self.node("constpath", [], first, last, self.token(parts[1]))
        if head in ("DEFINED", "NOT"):
            return self.node("defined_node" if head == "DEFINED" else "call_node", parts, first, last, None if head == "DEFINED" else "!")
        if head in ("RETURN", "BREAK", "NEXT"):
            return self.node(head.lower() + "_node", [], first, last)
        if head == "YIELD":
            return self.node("yield_node", self._arguments(parts[1]) if len(parts) > 1 else [], first, last)
        if head == "SUPER":
            return self.node("forwarding_super_node", [], first, last)
        if head == "BEGIN":
            return self.node("begin_node", [parts[1]] if parts[1] is None or parts[1].kind != "begin_node" else parts[1].children, first, last)
        if head in ("IF", "UNLESS", "WHILE", "UNTIL"):
            return self.node(head.lower() + "_node", [parts[1], *(p for p in parts[2:] if isinstance(p, Node))], first, last)
        if head == "FOR":
            return self.node("for_node", parts, first, last)
        if head == "CASE":
            return self.node("case_node" if "whens" in right else "case_match_node", parts, first, last)
        if head == "DEF":
            return self._definition(parts[1], parts[2], parts[3], first, last)
        if head == "CLASS":
            if right[1] == "SHIFT":
                return self.node("singleton_class_node", [parts[2], parts[4]], first, last)
            parent = parts[3] if right[2] == "REL" else None
            body = parts[5] if parent is not None else parts[3]
            return self.node("class_node", [parts[1], parent, body], first, last, "<" if parent else None)
        if head == "MODULE":
            return self.node("module_node", [parts[1], parts[2]], first, last)
        if head == "LAMBDA":
            return self.node("lambda_node", [parts[1], parts[3]], first, last)
        return NotImplemented

    def _gathered(self, parts: list) -> list[Node]:
        items: list[Node] = []
        for p in parts:
            items += self._flat(p)
        pairs = [x for x in items if x.kind in ("assoc_node", "assoc_splat_node")]
        rest = [x for x in items if x not in pairs]
        return [*rest, Node("keyword_hash_node", pairs, first=pairs[0].first, last=max(p.last for p in pairs))] if pairs else rest

    def _cpath(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if right == ("CONST",):
            return self.leaf(parts[0])
        return self.node("constpath", parts[:1] if isinstance(parts[0], Node) else [], first, last, self.token(parts[-1]))

    def _strings(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.leaf(parts[0]) if len(parts) == 1 else self.node("interpolated_string", [parts[0], self.leaf(parts[1])], first, last)

    def _body(self, right, parts, first, last):  # noqa: ANN001, ANN202
        body, rescues, other, ensure = parts
        if not rescues and other is None and ensure is None:
            return body
        return self.node("begin_node", [body, *(rescues or []), other, ensure], first, last)

    def _rescues(self, right, parts, first, last):  # noqa: ANN001, ANN202
        if not parts:
            return []
        caught = self._flat(parts[2])
        start = self.line(self.places[parts[1]])
        body = [parts[4]] if isinstance(parts[4], Node) else []
        every = [*caught, *body]
        return [*parts[0], Node("rescue_node", every, first=start, last=max([start, *(x.last for x in every)]))]

    def _rescued(self, right, parts, first, last):  # noqa: ANN001, ANN202
        out: list[Node] = []
        for p in parts:
            out += self._flat(p)
        if right[-1:] == ("target",):
            out[-1] = self._as_target(out[-1])
        return out

    def _as_target(self, node: Node) -> Node:
        return Node("local_target", [], None, node.name, node.first, node.last) if node.kind == "ident" else node

    def _ensure(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("ensure_node", parts, first, last) if parts else None

    def _else(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("else_node", parts, first, last) if parts else None

    def _if_tail(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("if_node", parts, first, last) if right[0] == "ELSIF" else parts[0]

    def _then(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return None

    _do = _then

    def _when(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("when_node", parts, first, last)

    def _in(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self.node("in_node", parts, first, last)

    def _mnode(self, right, parts, first, last):  # noqa: ANN001, ANN202
        node = next((p for p in parts if isinstance(p, Node)), None)
        if right[0] == "STAR":
            return self.node("splat_node", [self._as_target(node)] if node else [], first, last)
        return self._as_target(node) if node else NotImplemented

    def _mitem(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self._as_target(parts[0]) if right == ("target",) else NotImplemented

    def _for_var(self, right, parts, first, last):  # noqa: ANN001, ANN202
        return self._as_target(parts[0]) if right == ("target",) else self.node("multi_target_node", parts, first, last)


@lru_cache(maxsize=None)
def _handler(name: str) -> Callable | None:
    """What a rule's name stands for, where it isn't plain."""
    return getattr(Reader, f"_{name}", None)


def constant_name(node: Node) -> tuple[str | None, str]:
    """(anchor, name) of a constant: root after a leading ::, self after self::, else None."""
    if node.kind == "const":
        return None, node.name
    if not node.children:
        return "root", node.name
    if node.children[0].kind == "self_node":
        return "self", node.name
    anchor, outer = constant_name(node.children[0])
    return anchor, f"{outer}::{node.name}"


def _is_constant(node: Node | None) -> bool:
    return node is not None and (node.kind == "const" or node.kind == "constpath" and (not node.children or node.children[0].kind in ("self_node",) or _is_constant(node.children[0])))


def _join(namespace: str, name: str) -> str:
    return name if namespace == "Object" else f"{namespace}::{name}"


def _nest(namespace: str, path: Node) -> str:
    anchor, name = constant_name(path)
    return name if anchor == "root" else _join(namespace, name)


def _resolved(namespace: str, node: Node) -> str:
    """A constant that is named, not defined: it lies in an enclosing namespace that its first segment names, else it is as
    written."""
    anchor, name = constant_name(node)
    if anchor == "root":
        return name
    if anchor == "self":
        return _join(namespace, name)
    parts = namespace.split("::")
    first = name.split("::")[0]
    if first in parts:
        at = len(parts) - 1 - parts[::-1].index(first)
        return "::".join([*parts[:at], name])
    return name


def units(text: str) -> list[Unit]:
    """Methods and macro bodies of a source text, in order; an error is an Unreadable."""
    found: list[Unit] = []
    ordinals: Counter = Counter()

    def add(kind: str, node: Node, namespace: str, name: str, mark: str) -> None:
        found.append(Unit(kind, f"{namespace}{mark}{name}", namespace, name, node.first, node.last, node))

    def ordinal(namespace: str, macro: str) -> int:
        ordinals[namespace, macro] += 1
        return ordinals[namespace, macro]

    def owner(node: Node, namespace: str) -> str | None:
        if node.kind == "self_node":
            return namespace
        return _resolved(namespace, node) if _is_constant(node) else None

    def visit(node: Node | None, namespace: str, single: bool) -> None:
        if node is None:
            return
        if node.kind in ("class_node", "module_node"):
            for body in node.children[2 if node.name else 1 :]:
                visit(body, _nest(namespace, node.children[0]), False)
        elif node.kind == "singleton_class_node":
            own = owner(node.children[0], namespace)
            if own is not None:
                for body in node.children[1:]:
                    visit(body, own, True)
        elif node.kind == "def_node":
            if node.text is None:
                add("method", node, namespace, node.name, "." if single else "#")
            elif node.text == "self":
                add("method", node, namespace, node.name, ".")
            elif _CONSTANT.match(node.text):
                add("method", node, _resolved(namespace, _path(node.text)), node.name, ".")
        elif node.kind in ("constant_write_node", "constant_path_write_node") and node.children[-1].kind == "call_node" and node.children[-1].child("block_node"):
            name = _join(namespace, node.text) if node.kind == "constant_write_node" else _nest(namespace, node.children[0])
            for body in _bodies(node.children[-1].child("block_node")):
                visit(body, name, False)
        elif node.kind == "call_node":
            call(node, namespace, single)
        else:
            for child in node.children:
                visit(child, namespace, single)

    def call(node: Node, namespace: str, single: bool) -> None:
        block = node.child("block_node")
        receiver = node.children[0] if node.text == "receiver" else None
        if block and node.name in DEFINERS and (receiver is None or receiver.kind == "self_node"):
            name = _literal(node) or f"{node.name}[{ordinal(namespace, node.name)}]"
            add("method", block, namespace, name, "." if single or DEFINERS[node.name] else "#")
        elif receiver is not None:
            inside = block and node.name in CLASS_EVALS and _is_constant(receiver)
            for child in _bodies(block) if inside else node.children:
                visit(child, _resolved(namespace, receiver) if inside else namespace, False if inside else single)
        elif node.name in CLASS_BODIES | {"class_methods"} and block:
            for body in _bodies(block):
                visit(body, namespace, node.name == "class_methods")
        elif node.name in DSL and (body := block or _lambda(node)):
            add("dsl", body, namespace, _macro(node) or f"{node.name}[{ordinal(namespace, node.name)}]", ".")
        else:
            for child in node.children:
                visit(child, namespace, single)

    visit(Reader(text).program(), "Object", False)
    seen: Counter = Counter()
    for unit in found:
        identity = unit.identity
        seen[identity] += 1
        if seen[identity] > 1:
            unit.identity, unit.name = f"{identity}[{seen[identity]}]", f"{unit.name}[{seen[identity]}]"
    return found


def _path(text: str) -> Node:
    node: Node | None = None
    for k, part in enumerate(text.split("::")):
        if part:
            node = Node("const", name=part) if k == 0 else Node("constpath", [node] if node else [], part)
    return node


def _bodies(block: Node) -> list[Node]:
    return [c for c in block.children if c.kind != "block_parameters_node"]


def _given(node: Node) -> list[Node]:
    held = node.child("arguments_node")
    return held.children if held else []


def _literal(node: Node) -> str | None:
    first = next(iter(_given(node)), None)
    return first.text if first is not None and first.kind in ("symbol", "string") else None


def _macro(node: Node) -> str | None:
    names = []
    for given in _given(node):
        if _is_constant(given):
            names.append(constant_name(given)[1])
        elif given.kind == "string" and _CONSTANT.match(given.text or ""):
            names.append(given.text.removeprefix("::"))
        else:
            break
    if names:
        return f"{node.name}({', '.join(names)})"
    name = _literal(node)
    return f"{node.name}(:{name})" if name else None


def _lambda(node: Node) -> Node | None:
    for given in _given(node):
        if given.kind == "lambda_node":
            return given
        if given.kind == "call_node" and given.text != "receiver" and given.name in ("lambda", "proc") and given.child("block_node"):
            return given.child("block_node")
    return None


def normalized(node: Node, template: bool = False, known: frozenset[str] = frozenset()) -> tuple:
    """The tree of a node. In a template a bare name is a variable; elsewhere it is one where it was assigned before."""
    return _Normalizer(template).tree(node, set(known))


class _Normalizer:
    def __init__(self, template: bool):
        self.template = template

    def tree(self, node: Node, known: set[str]) -> tuple:
        kind = node.kind
        mark = _MARKS.get(kind) or (":literal" if kind == "constant_literal" else ":local" if kind in ("required_parameter", "local_target") else None)
        if kind in ("required_parameter", "local_target") or kind.endswith("_parameter_node") or kind.startswith("local_variable"):
            known.add(node.text or "")
        if mark:
            return (mark, None, node.first, node.last, [], False)
        if kind == "ident":
            if node.name in known or self.template:
                return (":local", None, node.first, node.last, [], False)
            return ("call_node", self.label(node, None), node.first, node.last, [], False)
        if kind == "statements":
            return ("statements_node", None, node.first, node.last, [self.tree(c, known) for c in node.children], True)
        if kind == "parentheses_node" and node.children:
            body = node.children[0]
            return self.tree(body.children[0] if body.kind == "statements" and len(body.children) == 1 else body, known)
        if kind in ("def_node", "class_node", "module_node", "singleton_class_node"):
            known = set()
        elif kind in ("block_node", "lambda_node"):
            known = set(known)
        if kind == "assoc_node":
            return self.pair(node, known)
        children = [self.tree(c, known) for c in node.children]
        label = None
        if kind == "call_node":
            label = self.label(node, node.children[0] if node.text == "receiver" else None)
        elif kind.endswith("_write_node") and "operator" in kind or kind.startswith("call_") and kind.endswith("_write_node"):
            label = node.name
        if kind.startswith("interpolated_"):
            kind += "_node"
        return (kind, label, node.first, max([node.last, *(c[3] for c in children)]), children, False)

    @staticmethod
    def label(node: Node, receiver: Node | None) -> str:
        name = node.name or ""
        if re.search(r"_(?:path|url)\Z", name) and (receiver is None or receiver.kind in ("call_node", "ident") and receiver.name in ROUTE_PROXIES):
            return ROUTE
        return name

    def pair(self, node: Node, known: set[str]) -> tuple:
        key, value = node.children[0], node.children[-1]
        text = key.text if key.kind in ("symbol", "string") else None
        own = self.tree(key, known)
        if text == "data" and value.kind == "hash_node":
            inner = [self.stimulus_pair(c, known) for c in value.children]
            told = ("hash_node", None, value.first, value.last, inner, False)
        elif text in STIMULUS_KEYS and value.kind == "string":
            told = self.stimulus(value)
        else:
            told = self.tree(value, known)
        return ("assoc_node", None, node.first, node.last, [own, told], False)

    def stimulus_pair(self, node: Node, known: set[str]) -> tuple:
        if node.kind == "assoc_node" and node.children[0].text in STIMULUS_HASH_KEYS and node.children[-1].kind == "string":
            return ("assoc_node", None, node.first, node.last, [self.tree(node.children[0], known), self.stimulus(node.children[-1])], False)
        return self.tree(node, known)

    @staticmethod
    def stimulus(node: Node) -> tuple:
        return ("stimulus_value", node.text, node.first, node.last, [], False)


def unit_trees(text: str) -> Iterator[tuple[Unit, tuple]]:
    """Units of a source text with their trees."""
    for unit in units(text):
        yield unit, normalized(unit.node)
