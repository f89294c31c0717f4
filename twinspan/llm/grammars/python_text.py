"""Python 3.13: grammar, what it leaves to a look at the tokens, and tokens from the standard lexer.

Parameters and arguments come in the order that the language asks for, and the code in f-strings is parsed like any other.
Three things no LALR(1) grammar tells at the place are told from a rule's tokens when it is reduced: what stands left of an
assignment (or after for, as, del) must be a target, and ``(x as y)`` stands only in a with statement or a pattern.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
import unicodedata
from token import tok_name

_PARAMETERS = """
{p}params: | {p}plain | {p}plain ',' | {p}slash | {p}slash ',' | {p}given | {p}given ',' | {p}gslash | {p}gslash ',' | {p}named | {p}named ',' | {p}rest | {p}rest ',' ;
{p}plain: {p}one | {p}plain ',' {p}one ;
{p}slash: {p}plain ',' '/' | {p}slash ',' {p}one ;
{p}given: {p}dflt | {p}plain ',' {p}dflt | {p}given ',' {p}dflt ;
{p}gslash: {p}given ',' '/' | {p}slash ',' {p}dflt | {p}gslash ',' {p}dflt ;
{p}star: {p}args | {p}plain ',' {p}args | {p}slash ',' {p}args | {p}given ',' {p}args | {p}gslash ',' {p}args ;
{p}bare: '*' | {p}plain ',' '*' | {p}slash ',' '*' | {p}given ',' '*' | {p}gslash ',' '*' ;
{p}named: {p}star | {p}bare ',' {p}one | {p}bare ',' {p}dflt | {p}named ',' {p}one | {p}named ',' {p}dflt ;
{p}rest: {p}kwds | {p}plain ',' {p}kwds | {p}slash ',' {p}kwds | {p}given ',' {p}kwds | {p}gslash ',' {p}kwds | {p}named ',' {p}kwds ;
"""

GRAMMAR = (
    """
file: | stmts ;
stmts: stmt | stmts stmt ;
stmt: simples | compound ;
simples: small_list NEWLINE | small_list ';' NEWLINE ;
small_list: small | small_list ';' small ;
small: expr_stmt | pass | break | continue | return | return star_tests | raise | raise test | raise test from test
  | global names | nonlocal names | del_stmt | assert test | assert test ',' test | import dotted_as_names
  | from module import '*' | from module import as_names | from module import '(' as_names ')' | from module import '(' as_names ',' ')'
  | TYPE NAME type_params '=' test ;
names: NAME | names ',' NAME ;
del_stmt: del targets | del targets ',' ;
targets: expr | targets ',' expr ;
dotted: NAME | dotted '.' NAME ;
dotted_as_names: dotted_as | dotted_as_names ',' dotted_as ;
dotted_as: dotted | dotted as NAME ;
module: dotted | dots | dots dotted ;
dots: '.' | '...' | dots '.' | dots '...' ;
as_names: as_name | as_names ',' as_name ;
as_name: NAME | NAME as NAME ;
expr_stmt: star_tests | yield_expr | annotated | augmented | assigns ;
annotated: star_tests ':' test | star_tests ':' test '=' value ;
augmented: star_tests AUG value ;
assigns: star_tests '=' value | assigns '=' value ;
value: star_tests | yield_expr ;
yield_expr: yield | yield star_tests | yield from test ;
compound: if named ':' suite elifs | while named ':' suite orelse | for targets_in in star_tests ':' suite orelse | async for targets_in in star_tests ':' suite orelse
  | try ':' suite finally ':' suite | try ':' suite excepts orelse | try ':' suite excepts orelse finally ':' suite
  | try ':' suite star_excepts orelse | try ':' suite star_excepts orelse finally ':' suite
  | with with_items ':' suite | async with with_items ':' suite | funcdef | classdef | decorators funcdef | decorators classdef
  | MATCH subject ':' NEWLINE INDENT cases DEDENT ;
subject: named | '*' expr ',' | named ',' | '*' expr ',' elements | named ',' elements | '*' expr ',' elements ',' | named ',' elements ',' ;
elifs: orelse | elif named ':' suite elifs ;
orelse: | else ':' suite ;
excepts: except_clause | excepts except_clause ;
except_clause: except ':' suite | except test ':' suite | except test as NAME ':' suite ;
star_excepts: star_clause | star_excepts star_clause ;
star_clause: except '*' test ':' suite | except '*' test as NAME ':' suite ;
with_items: with_item | with_items ',' with_item ;
with_item: test | test as with_target ;
with_target: star_expr ;
decorators: '@' named NEWLINE | decorators '@' named NEWLINE ;
funcdef: def NAME type_params '(' d_params ')' arrow ':' suite | async def NAME type_params '(' d_params ')' arrow ':' suite ;
arrow: | '->' test ;
type_params: | '[' type_list ']' | '[' type_list ',' ']' ;
type_list: type_param | type_list ',' type_param ;
type_param: NAME default | NAME ':' test default | '*' NAME | '*' NAME '=' star_test | '**' NAME default ;
default: | '=' test ;
annotation: | ':' test ;
d_one: NAME annotation ;
d_dflt: NAME annotation '=' test ;
d_args: '*' NAME annotation | '*' NAME ':' '*' expr ;
d_kwds: '**' NAME annotation ;
l_one: NAME ;
l_dflt: NAME '=' test ;
l_args: '*' NAME ;
l_kwds: '**' NAME ;
"""
    + _PARAMETERS.format(p="d_")
    + _PARAMETERS.format(p="l_")
    + """
classdef: class NAME type_params ':' suite | class NAME type_params '(' ')' ':' suite | class NAME type_params '(' arguments ')' ':' suite ;
suite: simples | NEWLINE INDENT stmts DEDENT ;
cases: case_block | cases case_block ;
case_block: CASE case_patterns ':' suite | CASE case_patterns if named ':' suite ;
case_patterns: pattern | item ',' | item ',' item_list | item ',' item_list ',' ;
item: pattern | '*' NAME ;
item_list: item | item_list ',' item ;
pattern: or_pattern | or_pattern as NAME ;
or_pattern: closed | or_pattern '|' closed ;
closed: number | strings | None | True | False | dotted | '(' ')' | '(' pattern ')' | '(' item ',' ')' | '(' item ',' item_list ')' | '(' item ',' item_list ',' ')'
  | '[' ']' | '[' item_list ']' | '[' item_list ',' ']' | '{' '}' | '{' fields '}' | '{' fields ',' '}' | dotted '(' ')' | dotted '(' class_args ')' ;
number: signed | signed '+' NUMBER | signed '-' NUMBER ;
signed: NUMBER | '-' NUMBER ;
fields: field | fields ',' field ;
field: number ':' pattern | strings ':' pattern | None ':' pattern | True ':' pattern | False ':' pattern | dotted '.' NAME ':' pattern | '**' NAME ;
class_args: class_pos | class_pos ',' | class_named | class_named ',' ;
class_pos: pattern | class_pos ',' pattern ;
class_named: NAME '=' pattern | class_pos ',' NAME '=' pattern | class_named ',' NAME '=' pattern ;

star_tests: star_test | star_test ',' | star_test ',' star_list | star_test ',' star_list ',' ;
star_list: star_test | star_list ',' star_test ;
star_test: test | '*' expr ;
star_named: named | '*' expr ;
targets_in: star_expr | star_expr ',' | star_expr ',' targets_rest | star_expr ',' targets_rest ',' ;
targets_rest: star_expr | targets_rest ',' star_expr ;
star_expr: expr | '*' expr ;
named: test | NAME ':=' test ;
test: or_test | or_test if or_test else test | lambda l_params ':' test ;
or_test: and_test | or_test or and_test ;
and_test: not_test | and_test and not_test ;
not_test: not not_test | comparison ;
comparison: expr | comparison comp expr ;
comp: COMP | in | not in | is | is not ;
expr: xor | expr '|' xor ;
xor: and_expr | xor '^' and_expr ;
and_expr: shift | and_expr '&' shift ;
shift: arith | shift SHIFT arith ;
arith: term | arith '+' term | arith '-' term ;
term: factor | term '*' factor | term '/' factor | term MUL factor | term '@' factor ;
factor: power | '+' factor | '-' factor | '~' factor ;
power: awaited | awaited '**' factor ;
awaited: primary | await primary ;
primary: atom | primary '.' NAME | primary '(' ')' | primary '(' arguments ')' | primary '(' named comps ')' | primary '[' subscripts ']' ;
arguments: places | places ',' | keywords | keywords ',' | unpacked | unpacked ',' ;
places: place | places ',' place ;
place: test | NAME ':=' test | '*' test ;
keywords: NAME '=' test | places ',' NAME '=' test | keywords ',' NAME '=' test | keywords ',' '*' test ;
unpacked: '**' test | places ',' '**' test | keywords ',' '**' test | unpacked ',' '**' test | unpacked ',' NAME '=' test ;
subscripts: subscript | subscript ',' | subscript ',' subscript_list | subscript ',' subscript_list ',' ;
subscript_list: subscript | subscript_list ',' subscript ;
subscript: named | '*' expr | slice ;
slice: opt_test ':' opt_test | opt_test ':' opt_test ':' opt_test ;
opt_test: | test ;
atom: NAME | NUMBER | strings | '...' | None | True | False | '(' ')' | '(' yield_expr ')' | '(' named ')' | '(' renamed ')' | '(' group_item ',' ')' | '(' group_item ',' group ')' | '(' group_item ',' group ',' ')' | '(' named comps ')'
  | '[' ']' | '[' elements ']' | '[' elements ',' ']' | '[' named comps ']' | '{' '}' | '{' elements '}' | '{' elements ',' '}' | '{' named comps '}'
  | '{' pairs '}' | '{' pairs ',' '}' | '{' test ':' test comps '}' ;
group: group_item | group ',' group_item ;
group_item: star_named | renamed ;
renamed: test as star_expr ;
elements: star_named | elements ',' star_named ;
pairs: pair | pairs ',' pair ;
pair: test ':' test | '**' expr ;
strings: texts | bytes ;
texts: text | texts text ;
text: STRING | FSTRING_START fparts FSTRING_END ;
bytes: BYTES | bytes BYTES ;
fparts: | fparts FSTRING_MIDDLE | fparts '{' fvalue fequal fconversion fformat '}' ;
fvalue: star_tests | yield_expr ;
fequal: | '=' ;
fconversion: | '!' CONVERSION ;
fformat: | ':' fparts ;
comps: comp_for | comps comp_for | comps if or_test ;
comp_for: for targets_in in or_test | async for targets_in in or_test ;
"""
)

_AUG = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
_COMP = {"==", "!=", "<", ">", "<=", ">="}
_SKIP = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.TYPE_COMMENT}
_OPEN, _CLOSE = {"'('", "'['", "'{'", "FSTRING_START"}, {"')'", "']'", "'}'", "FSTRING_END"}
#: Tokens outside brackets that a target may have besides a name: what its first part or a trailer is made of.
_PRIMARY = {"NAME", "NUMBER", "STRING", "BYTES", "'.'", "'...'", "None", "True", "False"}
_LITERAL = re.compile(r"([A-Za-z]*)('''|\"\"\"|'|\")(.*)\2", re.DOTALL)
_OCTAL = re.compile(r"0[0-9_]*[1-9][0-9_]*")
_WIDE = re.compile(r"\\(?:\\|x(?P<x>[0-9a-fA-F]{2})?|u(?P<u>[0-9a-fA-F]{4})?|U(?P<U>[0-9a-fA-F]{8})?|N(?P<N>\{[^}]+\})?|.)", re.DOTALL)


def _kind(kind: int, text: str) -> str:
    if kind == tokenize.NAME:
        return text if keyword.iskeyword(text) else "NAME" if text.isidentifier() else "ERROR"
    if kind == tokenize.NUMBER and _OCTAL.fullmatch(text):
        return "ERROR"
    if kind == tokenize.OP:
        if text in _AUG:
            return "AUG"
        if text in _COMP:
            return "COMP"
        return {"<<": "SHIFT", ">>": "SHIFT", "//": "MUL", "%": "MUL"}.get(text, f"'{text}'")
    if kind == tokenize.STRING:
        return _literal(text)
    return {tokenize.ENDMARKER: ""}.get(kind, tok_name[kind])


def _escapes(body: str, wide: bool) -> bool:
    """The escapes of a literal are whole; \\u, \\U and \\N count where wide."""
    for m in _WIDE.finditer(body) if "\\" in body else ():
        key = m.group()[1:2]
        if key == "x" or wide and key in "uUN":
            value = m.group(key)
            if value is None or key == "U" and int(value, 16) > 0x10FFFF:
                return False
            if key == "N":
                try:
                    unicodedata.lookup(value[1:-1])
                except KeyError:
                    return False
    return True


def _literal(text: str) -> str:
    found = _LITERAL.fullmatch(text)
    if not found:
        return "ERROR"
    prefix, _, body = found.groups()
    raw, binary = "r" in prefix.lower(), "b" in prefix.lower()
    if binary and not body.isascii() or not raw and not _escapes(body, not binary):
        return "ERROR"
    return "BYTES" if binary else "STRING"


def tokens(text: str) -> tuple[list[str], list[int]]:
    """Token kinds and their lines; text that the lexer rejects ends in a token ERROR."""
    kinds: list[str] = []
    lines: list[int] = []
    raw: list[bool] = []  # of the f-strings around
    line, end = 1, (0, 0)
    if "\0" in text:
        return ["ERROR"], [text.count("\n", 0, text.index("\0")) + 1]
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            line = t.start[0]
            if t.type in _SKIP or not (kind := _kind(t.type, t.string)):
                continue
            if kind == "FSTRING_START":
                raw.append("r" in t.string.lower())
            elif kind == "FSTRING_END":
                raw.pop()
            elif kind == "FSTRING_MIDDLE" and not raw[-1] and not _escapes(t.string, True):
                kind = "ERROR"
            elif kind == "NAME" and kinds and kinds[-1] == "'!'" and t.start == end and t.string in ("s", "r", "a"):
                kind = "CONVERSION"
            end = t.end
            kinds.append("ERROR" if kind == "ERRORTOKEN" else kind)
            lines.append(line)
            if kind == "NAME" and t.string in ("match", "case", "type") and (len(kinds) < 2 or kinds[-2] in ("NEWLINE", "INDENT", "DEDENT", "';'") or t.string == "type" and kinds[-2] == "':'"):
                kinds[-1] = f"?{t.string}"
    except (tokenize.TokenError, SyntaxError) as e:
        kinds.append("ERROR")
        place = getattr(e, "lineno", None) or (e.args[1][0] if len(e.args) > 1 and isinstance(e.args[1], tuple) else line)
        lines.append(place or line)
    for k, kind in enumerate(kinds):
        if kind[0] == "?":
            kinds[k] = _soft(kinds, k)
    return kinds, lines


def _soft(kinds: list[str], k: int) -> str:
    """What match, case or type at the beginning of a statement is."""
    end = next((j for j in range(k, len(kinds)) if kinds[j] == "NEWLINE"), len(kinds))
    after = kinds[k + 1] if k + 1 < len(kinds) else ""
    if kinds[k] == "?type":
        return "TYPE" if after == "NAME" else "NAME"
    if after in ("'='", "'.'", "','", "')'", "':'", "':='", "AUG", "COMP", "NEWLINE", "';'"):
        return "NAME"
    opens = any(x == "':'" for x in kinds[k + 1 : end])
    return kinds[k][1:].upper() if opens and (kinds[end - 1] == "':'" or kinds[k] == "?case") else "NAME"


def _outer(kinds: list[str], first: int, last: int) -> list[int]:
    """Places of the tokens from first to last - 1 outside brackets, and of outermost brackets."""
    out, depth = [], 0
    for k in range(first, last):
        kind = kinds[k]
        if kind in _CLOSE:
            depth -= 1
        if not depth:
            out.append(k)
        if kind in _OPEN:
            depth += 1
    return out


def _single(kinds: list[str], first: int, last: int) -> bool:
    """A name, attribute or subscript, maybe in parentheses."""
    if last - first == 1:
        return kinds[first] == "NAME"
    outer = _outer(kinds, first, last)
    if outer == [first, last - 1] and kinds[first] == "'('":
        return last - first > 2 and _single(kinds, first + 1, last - 1)
    if any(kinds[k] not in _PRIMARY and kinds[k] not in _OPEN and kinds[k] not in _CLOSE for k in outer):
        return False
    if kinds[last - 1] == "']'":
        return outer[-2] > first
    return last - first > 2 and kinds[last - 1] == "NAME" and kinds[last - 2] == "'.'"


def target(kinds: list[str], first: int, last: int, starred: bool = True) -> bool:
    """The tokens are what can be assigned to, one by one or as a tuple or list; starred: a part may have a star."""
    outer = _outer(kinds, first, last)
    commas = [k for k in outer if kinds[k] == "','"]
    if commas:
        bounds = [first - 1, *commas, *([last] if commas[-1] != last - 1 else [])]
        return all(target(kinds, a + 1, b, starred) for a, b in zip(bounds, bounds[1:], strict=False))
    if starred and kinds[first] == "'*'":
        return kinds[first + 1] != "'*'" and target(kinds, first + 1, last)
    if outer == [first, last - 1] and kinds[first] in ("'('", "'['"):
        if last - first == 2:
            return True
        alone = kinds[first] == "'('" and kinds[first + 1] == "'*'" and not any(kinds[k] == "','" for k in _outer(kinds, first + 1, last - 1))
        return not alone and target(kinds, first + 1, last - 1, starred)
    return _single(kinds, first, last)


def _renames(kinds: list[str], first: int) -> bool:
    """A (x as y) whose item begins at first stands in the parentheses of a with statement."""
    depth, k = 0, first - 1
    while k >= 0 and (depth or kinds[k] not in _OPEN):
        depth += (kinds[k] in _CLOSE) - (kinds[k] in _OPEN)
        k -= 1
    end = first
    while end < len(kinds) and (depth or kinds[end] not in _CLOSE):
        depth += (kinds[end] in _OPEN) - (kinds[end] in _CLOSE)
        end += 1
    return k > 0 and kinds[k] == "'('" and kinds[k - 1] == "with" and kinds[end + 1 : end + 2] == ["':'"]


def fits(kinds: list[str], name: str, first: int, last: int) -> bool:
    """What the grammar leaves open about a rule over tokens first to last - 1."""
    if name == "assigns":
        equals = []
        for k in _outer(kinds, first, last):
            if kinds[k] == "lambda":
                break
            if kinds[k] == "'='":
                equals.append(k)
        return bool(equals) and target(kinds, equals[-2] + 1 if len(equals) > 1 else first, equals[-1])
    if name in ("annotated", "augmented"):
        at = next(k for k in _outer(kinds, first, last) if kinds[k] in ("':'", "AUG", "lambda"))
        return _single(kinds, first, at)
    if name == "del_stmt":
        return target(kinds, first + 1, last, False)
    if name in ("targets_in", "with_target"):
        return target(kinds, first, last)
    if name == "renamed":
        at = next(k for k in _outer(kinds, first, last) if kinds[k] == "as")
        return _renames(kinds, first) and target(kinds, at + 1, last)
    return True


#: Rules that ``fits`` looks at.
CHECKED = frozenset({"assigns", "annotated", "augmented", "del_stmt", "targets_in", "with_target", "renamed"})
