"""Ruby 3.4: grammar and lexer.

The lexer keeps the states the language needs to tell operators from the beginnings of operands: BEG (an operand comes),
END (an operand has ended), ARG (a name that may take arguments without parentheses), MID (after return and the like),
DOT (a method name comes), NAME (after alias and undef). Code inside strings is lexed with them and parsed on its own.
"""

from __future__ import annotations

import re

GRAMMAR = """
%nonassoc LOWEST
%nonassoc IF_MOD UNLESS_MOD WHILE_MOD UNTIL_MOD IN
%left AND OR
%right NOT
%nonassoc DEFINED
%right '=' OPASGN
%left RESCUE_MOD
%right '?' ':'
%nonassoc DOT2
%left '||'
%left '&&'
%nonassoc CMP
%left REL
%left '|' '^'
%left '&'
%left SHIFT
%left '+' '-'
%left '*' '/' '%'
%right UMINUS
%right '**'
%right '!' '~'

program: compstmt ;
compstmt: | NL | stmts | NL stmts | stmts NL | NL stmts NL ;
stmts: stmt | stmts NL stmt ;
stmt: expr | stmt IF_MOD expr | stmt UNLESS_MOD expr | stmt WHILE_MOD expr | stmt UNTIL_MOD expr | stmt RESCUE_MOD stmt
  | ALIAS name name | UNDEF names | mlhs '=' rhs_list | lhs '=' many | mlhs '=' command_call | BEGIN_BLOCK '{' compstmt '}' ;
names: name | names ',' name ;
name: FNAME | SYMBOL | GVAR ;
many: item ',' items | STAR arg | STAR arg ',' items ;
rhs_list: item | many ;
items: item | items ',' item ;
item: arg | STAR arg ;
mlhs: mitem ',' | mitem ',' mlist | mitem ',' mlist ',' | STAR target | STAR | STAR target ',' mlist | STAR ',' mlist | LPAREN mlhs ')' ;
mlist: mnode | mlist ',' mnode ;
mnode: target | STAR target | STAR | LPAREN mlhs ')' | LPAREN target ')' ;
mitem: target | LPAREN mlhs ')' ;
lhs: variable | primary INDEX ']' | primary INDEX args ']' | primary '.' IDENT | primary '.' CONST | primary '::' CONST | primary '::' IDENT | '::B' CONST ;
target: variable | primary INDEX ']' | primary INDEX args ']' | primary '.' IDENT | primary '.' CONST | primary '::' CONST | primary '::' IDENT | '::B' CONST ;
variable: IDENT | CONST | IVAR | GVAR ;
expr: command_call | NOT expr | expr AND expr | expr OR expr | arg | arg '=>' pattern | arg IN pattern ;
command_call: command | '!' command | lhs '=' command_call | lhs OPASGN command_call | lhs '=' command_call RESCUE_MOD arg ;
command: IDENT command_args %prec LOWEST | FID command_args %prec LOWEST | CONST command_args %prec LOWEST
  | primary '.' method command_args %prec LOWEST | primary '::' IDENT command_args %prec LOWEST | SUPER command_args | YIELD command_args
  | RETURN command_args | BREAK command_args | NEXT command_args | command DO_BLOCK block_body END_KW ;
method: IDENT | CONST | FID ;
command_args: args | command | args ',' command ;
args: argument | args ',' argument ;
argument: arg | STAR arg | STAR | DSTAR arg | DSTAR | AMPER arg | AMPER | LABEL arg | LABEL | arg '=>' arg | BDOT2 ;
arg: primary | lhs '=' arg | lhs OPASGN arg | lhs '=' arg RESCUE_MOD arg | lhs OPASGN arg RESCUE_MOD arg
  | arg '+' arg | arg '-' arg | arg '*' arg | arg '/' arg | arg '%' arg | arg '**' arg | UMINUS arg | '!' arg | '~' arg
  | arg '|' arg | arg '^' arg | arg '&' arg | arg SHIFT arg | arg CMP arg | arg REL arg | arg '&&' arg | arg '||' arg
  | arg DOT2 arg | arg DOT2 | BDOT2 arg %prec DOT2 | arg '?' arg ':' arg | arg '?' LABEL arg | DEFINED arg | DEF FNAME '=' endless | DEF FNAME CALLP params ')' '=' endless
  | DEF FNAME CALLP ')' '=' endless ;
endless: arg | command | arg RESCUE_MOD arg ;
paren_args: CALLP ')' | CALLP args ')' | CALLP args ',' ')' | CALLP command ')' | CALLP args ',' command ')' ;
primary: literal | variable | FID | call | call brace | IDENT brace | FID brace | CONST brace | SUPER brace
  | LBRACK ']' | LBRACK args ']' | LBRACK args ',' ']' | HASH '}' | HASH pairs '}' | HASH pairs ',' '}'
  | LPAREN compstmt ')' | primary '::' CONST | '::B' CONST | DEFINED CALLP expr ')' | NOT CALLP expr ')' | NOT CALLP ')'
  | SELF | REDO | RETURN | BREAK | NEXT | YIELD | YIELD paren_args | SUPER
  | BEGIN body END_KW | IF expr then compstmt if_tail END_KW | UNLESS expr then compstmt else END_KW
  | WHILE expr do compstmt END_KW | UNTIL expr do compstmt END_KW | FOR for_var IN expr do compstmt END_KW
  | CASE expr NL whens else END_KW | CASE expr whens else END_KW | CASE whens else END_KW | CASE NL whens else END_KW
  | CASE expr NL ins else END_KW | CASE expr ins else END_KW
  | DEF FNAME def_args body END_KW | CLASS cpath NL body END_KW | CLASS cpath REL expr NL body END_KW | CLASS SHIFT expr NL body END_KW
  | MODULE cpath body END_KW | LAMBDA lambda_params LBRACE_L compstmt '}' | LAMBDA lambda_params DO_L body END_KW ;
literal: NUMBER | strings | SYMBOL | REGEX | WORDS ;
strings: STRING | strings STRING ;
call: IDENT paren_args | FID paren_args | CONST paren_args | SUPER paren_args | primary '.' method | primary '.' method paren_args | primary '.' paren_args
  | primary '::' IDENT | primary '::' IDENT paren_args | primary '::' FID | primary '::' FID paren_args | primary '::' CONST paren_args
  | primary INDEX ']' | primary INDEX args ']' | primary INDEX args ',' ']' ;
brace: LBRACE_B block_brace '}' | DO_BLOCK block_body END_KW ;
block_brace: compstmt | block_params compstmt ;
block_body: body | block_params body ;
block_params: PIPE PIPE | PIPE bparams PIPE | PIPE bparams ',' PIPE | '||' ;
bparams: bparam | bparams ',' bparam | bparams NL bparam ;
bparam: IDENT | IDENT '=' primary | STAR IDENT | STAR | DSTAR IDENT | DSTAR | AMPER IDENT | AMPER | LABEL | LABEL primary | LPAREN bparams ')' | DSTAR NIL_KW ;
lambda_params: | CALLP ')' | CALLP params ')' | params ;
def_args: CALLP ')' | CALLP params ')' | CALLP params ',' ')' | params NL | NL ;
params: param | params ',' param ;
param: IDENT | IDENT '=' arg | STAR IDENT | STAR | DSTAR IDENT | DSTAR | AMPER IDENT | AMPER | LABEL | LABEL arg | LPAREN bparams ')' | BDOT2 | DSTAR NIL_KW ;
pairs: pair | pairs ',' pair ;
pair: LABEL arg | LABEL | arg '=>' arg | DSTAR arg ;
then: NL | THEN | NL THEN ;
do: NL | DO_COND ;
else: | ELSE compstmt ;
if_tail: else | ELSIF expr then compstmt if_tail ;
whens: when | whens when ;
when: WHEN args then compstmt ;
ins: in | ins in ;
in: IN top_pattern then compstmt | IN top_pattern IF_MOD expr then compstmt | IN top_pattern UNLESS_MOD expr then compstmt ;
top_pattern: pattern | pattern ',' | plist | pairs_pattern ;
plist: pattern ',' pattern | STAR IDENT | STAR | plist ',' pattern | plist ',' STAR IDENT | plist ',' STAR | pattern ',' STAR IDENT | pattern ',' STAR ;
pattern: pattern '=>' IDENT | palt ;
palt: pprim | palt '|' pprim ;
pprim: plit | plit DOT2 plit | plit DOT2 | BDOT2 plit | IDENT | '^' variable | '^' LPAREN expr ')' | ppath | ppath CALLP pargs ')' | ppath CALLP ')' | ppath INDEX pargs ']'
  | LBRACK pargs ']' | LBRACK ']' | HASH pairs_pattern '}' | HASH '}' | HASH pairs_pattern ',' '}' | LPAREN pattern ')' | SELF ;
plit: literal | UMINUS NUMBER ;
ppath: CONST | ppath '::' CONST | '::B' CONST ;
pargs: parg | pargs ',' parg ;
parg: pattern | STAR IDENT | STAR | LABEL | LABEL pattern | DSTAR IDENT | DSTAR NIL_KW ;
pairs_pattern: LABEL | LABEL pattern | DSTAR IDENT | DSTAR NIL_KW | pairs_pattern ',' LABEL | pairs_pattern ',' LABEL pattern | pairs_pattern ',' DSTAR IDENT | pairs_pattern ',' DSTAR NIL_KW ;
for_var: target | mlhs ;
cpath: CONST | cpath '::' CONST | '::B' CONST ;
body: compstmt rescues else ensure ;
rescues: | rescues RESCUE rescued then compstmt ;
rescued: | items | '=>' target | items '=>' target ;
ensure: | ENSURE compstmt ;
"""

#: Reserved words, with the token each begins an expression with.
KEYWORDS = {
    "alias": "ALIAS", "and": "AND", "begin": "BEGIN", "break": "BREAK", "case": "CASE", "class": "CLASS", "def": "DEF", "defined?": "DEFINED",
    "do": "DO", "else": "ELSE", "elsif": "ELSIF", "end": "END_KW", "ensure": "ENSURE", "false": "SELF", "for": "FOR", "if": "IF", "in": "IN",
    "module": "MODULE", "next": "NEXT", "nil": "SELF", "not": "NOT", "or": "OR", "redo": "REDO", "rescue": "RESCUE", "retry": "REDO",
    "return": "RETURN", "self": "SELF", "super": "SUPER", "then": "THEN", "true": "SELF", "undef": "UNDEF", "unless": "UNLESS", "until": "UNTIL",
    "when": "WHEN", "while": "WHILE", "yield": "YIELD", "__FILE__": "SELF", "__LINE__": "SELF", "__ENCODING__": "SELF", "BEGIN": "BEGIN_BLOCK", "END": "BEGIN_BLOCK",
}
_AFTER = dict.fromkeys(("alias", "undef"), "NAME") | dict.fromkeys(("end", "self", "true", "false", "nil", "redo", "retry", "__FILE__", "__LINE__", "__ENCODING__"), "END")
_AFTER |= dict.fromkeys(("return", "break", "next", "rescue"), "MID") | dict.fromkeys(("super", "yield", "defined?", "not"), "ARG")
_MODIFIERS = {"if", "unless", "while", "until", "rescue"}
_CLOSING = {")": "(", "]": "[", "}": "{"}
_INSTANCE = re.compile(r"@@?[^\W\d]\w*")
_GLOBAL = re.compile(r"\$(?:[^\W\d]\w*|\d+|-\w|[^\s\w])")
_PERCENT = re.compile(r"%([qQwWiIrsx]?)([^\w\s])")
_SYMBOL = re.compile(r":(?:[^\W\d]\w*(?:[?!](?!=)|=(?![=~>]))?|@@?\w+|\$\w+|\[\]=?|<=>|===?|=~|![=~]?|\*\*|[-+]@|<<|>>|<=|>=|[-+*/%<>&|^~!`])")
_NAMED_OPERATOR = re.compile(r"\[\]=?|<=>|===?|=~|![=~]?|\*\*|[-+!~]@|<<|>>|<=|>=|[-+*/%<>&|^~!]")
_BLANK = re.compile(r"[ \t\r\f\v]*")
_WORD = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO]?[0-7]+(?:_[0-7]+)*(?![.\d])|0[dD]\d+|(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)r?i?")
_OPERATOR = re.compile(r"\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|&\.|\*\*|==|=~|!=|!~|=>|->|<=|>=|<<|>>|&&|\|\||\.\.|::|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%=<>!&|^~?:.,;()\[\]{}]")
_TOKEN_OF = dict.fromkeys(("<=>", "==", "===", "!=", "=~", "!~"), "CMP") | dict.fromkeys(("<", ">", "<=", ">="), "REL") | {"<<": "SHIFT", ">>": "SHIFT", "..": "DOT2", "...": "DOT2", "&.": "'.'"}
_HEREDOC = re.compile(r"<<([~-]?)(?:([\"'`])([^\n]*?)\2|([^\W\d]\w*))")
_DEF_NAME = re.compile(r"[ \t]*(?:(?:self|[^\W\d]\w*|@@?\w+)[ \t]*(?:\.|::)[ \t]*)?((?:[^\W\d]\w*(?:[?!](?!=)|=(?=[ \t]*\()(?![=~>]))?)|\[\]=?|<=>|===?|=~|![=~]?|\*\*|[-+!~]@|<<|>>|<=|>=|[-+*/%<>&|^~`])")
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_CHAR = re.compile(r"\?(?:\\(?:u\{[^}]*\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{1,2}|[CM]-.|.)|[^\s\\])(?!\w)", re.S)
_LEADING_DOT = re.compile(r"(?:[ \t\r\n]|#[^\n]*\n)*(?:\.(?!\.)|&\.)")
_COMMENT_BLOCK = re.compile(r"=begin(?:[ \t\r][^\n]*)?(?:\n|\Z)")
_COMMENT_END = re.compile(r"^=end(?:[ \t\r][^\n]*)?$", re.M)
_DATA = re.compile(r"__END__\r?(?:\n|\Z)")


class Unlexable(ValueError):
    """Text that no token begins with; ``place`` is where."""

    def __init__(self, place: int):
        super().__init__(place)
        self.place = place


class Lexer:
    """Tokens of a Ruby text; ``parts`` collects those of the code inside its strings."""

    def __init__(self, text: str):
        self.text = text
        self.parts: list[tuple[list[str], list[int]]] = []
        #: For each part, where its tokens end.
        self.ends: list[list[int]] = []
        #: Parts inside the string that begins at a place, and the last place of a heredoc that begins there.
        self.inner: dict[int, list[int]] = {}
        self.bottom: dict[int, int] = {}
        self.locals: set[str] = set()
        self.heredocs: list[tuple[str, bool, bool, int]] = []

    def run(self, at: int = 0, inside: bool = False) -> int:
        """Lex from a place to the end, or, inside a string, to the brace that closes the code; the place after it. Tokens
        before text that no token begins with are kept."""
        kinds: list[str] = []
        places: list[int] = []
        ends: list[int] = []
        try:
            at = self._run(at, inside, kinds, places, ends)
        finally:
            self.parts.append((kinds, places))
            self.ends.append(ends)
        return at

    def _run(self, at: int, inside: bool, kinds: list[str], places: list[int], ends: list[int]) -> int:
        text, n, blank, named = self.text, len(self.text), _BLANK.match, _WORD.match
        state, opened, conditions, lambdas = "BEG", [], [], []
        piped = 0  # 1 after a block's opening, 2 within its parameters
        while True:
            space = False
            while at < n:
                c = text[at]
                if c in " \t\r\f\v":
                    at = blank(text, at).end()
                    space = True
                elif c == "\\" and text.startswith(("\n", "\r\n"), at + 1):
                    at = text.index("\n", at) + 1
                    space = True
                elif c == "#":
                    end = text.find("\n", at)
                    at = n if end < 0 else end
                else:
                    break
            if at >= n:
                if inside or self.heredocs or opened:
                    raise Unlexable(n)
                break
            begin = at
            if c == "\n":
                at += 1
                if self.heredocs:
                    at = self.bodies(at)
                while text.startswith("=begin", at) and (m := _COMMENT_BLOCK.match(text, at)) is not None:
                    end = _COMMENT_END.search(text, m.end())
                    if end is None:
                        raise Unlexable(at)
                    at = min(end.end() + 1, n)
                if text.startswith("__END__", at) and _DATA.match(text, at) and not inside:
                    n = at
                if state in ("BEG", "DOT", "NAME") or kinds and kinds[-1] == "NL":
                    continue
                if opened and opened[-1][0] == "[" or piped == 2:
                    continue
                at = blank(text, at).end()
                if at < n and text[at] in ".&#\n" and (m := _LEADING_DOT.match(text, at)) and m.end() <= n:
                    continue
                while conditions and conditions[-1] == len(opened):
                    conditions.pop()
                kinds.append("NL")
                places.append(begin)
                ends.append(begin)
                state = "BEG"
                continue
            if begin == 0 and text.startswith("=begin") and (m := _COMMENT_BLOCK.match(text)):
                end = _COMMENT_END.search(text, m.end())
                if end is None:
                    raise Unlexable(0)
                at = min(end.end(), n)
                continue
            if begin == 0 and text.startswith("__END__") and _DATA.match(text):
                break
            operand = state in ("BEG", "MID")
            # a name that may take arguments, a blank, and no blank after: an operand begins
            follows = text[at + 1] if at + 1 < n else "\n"
            starts = operand or state == "ARG" and space and not follows.isspace()
            kind, after = "", "END"
            if c.isalpha() or c == "_" or c > "\x7f":
                m = named(text, at)
                if m is None:
                    raise Unlexable(at)
                word = m.group()
                at = m.end()
                if at < n and text[at] in "?!" and text[at + 1 : at + 2] != "=" or text.startswith(("?==", "!==", "?=~", "!=~", "?=>"), at):
                    if not (text[at] == "?" and text.startswith("?:", at) and state != "DOT" and not text.startswith("?::", at)):
                        word += text[at]
                        at += 1
                elif word == "defined" and text.startswith("?", at):
                    word += "?"
                    at += 1
                if at < n and text[at] == ":" and text[at + 1 : at + 2] != ":" and state not in ("DOT", "NAME", "END") and not (kinds and kinds[-1] == "'?'" and text[at + 1 : at + 2] != " "):
                    at += 1
                    kind, after = "LABEL", "BEG"
                    self.locals.add(word)
                elif state == "DOT":
                    kind, after = "FID" if word[-1] in "?!" else "CONST" if word[0].isupper() else "IDENT", "ARG"
                elif state == "NAME":
                    if text.startswith("=", at) and text[at + 1 : at + 2] in (" ", "\n", "\t", ""):
                        at += 1
                    kind, after = "FNAME", "NAME" if kinds and kinds[-1] == "ALIAS" else "END"
                elif word in KEYWORDS:
                    kind, after = KEYWORDS[word], _AFTER.get(word, "BEG")
                    if word in _MODIFIERS and not (state == "BEG" or word == "rescue" and state == "MID"):
                        kind, after = kind + "_MOD", "BEG"
                    elif word in ("while", "until", "for"):
                        conditions.append(len(opened))
                    elif word == "do":
                        if lambdas and lambdas[-1] == len(opened):
                            lambdas.pop()
                            kind = "DO_L"
                        elif conditions and conditions[-1] == len(opened):
                            conditions.pop()
                            kind = "DO_COND"
                        else:
                            kind = "DO_BLOCK"
                            piped = 1
                    elif word == "nil" and kinds and kinds[-1] == "DSTAR":
                        kind = "NIL_KW"
                    elif word == "def":
                        kinds.append("DEF")
                        places.append(begin)
                        ends.append(at)
                        m = _DEF_NAME.match(text, at)
                        if m is None:
                            raise Unlexable(at)
                        begin, at = m.start(1), m.end()
                        kind, after = "FNAME", "ARG"
                elif word[-1] in "?!":
                    kind, after = "FID", "ARG"
                elif word[0].isupper():
                    kind, after = "CONST", "ARG"
                    if kinds and kinds[-1] in ("CLASS", "MODULE"):
                        after = "END"
                else:
                    kind = "IDENT"
                    rest = text[at : at + 40].lstrip(" \t")
                    known = word in self.locals
                    if piped == 2 or rest.startswith(("=", "||=", "&&=", "+=", "-=", "<<=", "*=")) and not rest.startswith(("==", "=~", "=>")) or kinds and kinds[-1] in ("FOR", "'=>'"):
                        self.locals.add(word)
                        known = True
                    after = "END" if known or piped == 2 else "ARG"
            elif c.isdigit():
                m = _NUMBER.match(text, at)
                at = m.end()
                if at < n and (text[at].isalnum() or text[at] == "_"):
                    raise Unlexable(at)
                kind = "NUMBER"
            elif c in "\"'`":
                if c == "`" and state in ("DOT", "NAME"):
                    raise Unlexable(at)
                at = self.string(at + 1, c, "", c != "'", begin)
                kind = "STRING"
                if c != "`" and text.startswith(":", at) and not text.startswith("::", at) and state in ("BEG", "ARG") and not (kinds and "'?'" in kinds[-3:]):
                    at += 1
                    kind, after = "LABEL", "BEG"
            elif c == "@":
                m = _INSTANCE.match(text, at)
                if m is None:
                    raise Unlexable(at)
                at, kind = m.end(), "IVAR"
            elif c == "$":
                m = _GLOBAL.match(text, at)
                if m is None:
                    raise Unlexable(at)
                at, kind = m.end(), "GVAR"
                after = "NAME" if state == "NAME" and kinds and kinds[-1] == "ALIAS" else "END"
            elif c == "/" and (operand or state == "ARG" and space and follows not in " \t\n="):
                at = self.string(at + 1, "/", "", True, begin)
                while at < n and text[at] in "imxounse":
                    at += 1
                kind = "REGEX"
            elif c == "%" and (operand or state == "ARG" and space and follows not in " \t\n=") and (m := _PERCENT.match(text, at)):
                close = _CLOSE.get(m[2], m[2])
                at = self.string(m.end(), close, m[2] if close != m[2] else "", m[1] not in ("q", "w", "i", "s") or not m[1], begin)
                if m[1] == "r":
                    while at < n and text[at] in "imxounse":
                        at += 1
                kind = "WORDS" if m[1] in ("w", "W", "i", "I") and m[1] else "STRING" if m[1] not in ("r", "s") else "REGEX"
            elif c == "?" and (operand or state == "ARG" and space and not follows.isspace()) and (m := _CHAR.match(text, at)):
                at, kind = m.end(), "STRING"
            elif c == ":" and text[at + 1 : at + 2] == '"':
                at = self.string(at + 2, '"', "", True, begin)
                kind, after = "SYMBOL", "NAME" if kinds and kinds[-1] == "ALIAS" else "END"
            elif c == ":" and text[at + 1 : at + 2] == "'":
                at = self.string(at + 2, "'", "", False, begin)
                kind = "SYMBOL"
            elif c == ":" and text[at + 1 : at + 2] != ":" and not follows.isspace() and (m := _SYMBOL.match(text, at)):
                at = m.end()
                kind, after = "SYMBOL", "NAME" if state == "NAME" and kinds and kinds[-1] == "ALIAS" else "END"
            elif c == "<" and (operand or state == "ARG" and space) and not (kinds and kinds[-1] == "CLASS") and (m := _HEREDOC.match(text, at)):
                self.heredocs.append((m[3] if m[2] else m[4], bool(m[1]), m[2] != "'", begin))
                at, kind = m.end(), "STRING"
            else:
                m = _OPERATOR.match(text, at)
                if m is None:
                    raise Unlexable(at)
                op = m.group()
                at = m.end()
                after = "BEG"
                if state == "NAME" and op not in ",;":
                    m = _NAMED_OPERATOR.match(text, begin)
                    if m is None:
                        raise Unlexable(begin)
                    at, kind, after = m.end(), "FNAME", "NAME" if kinds and kinds[-1] == "ALIAS" else "END"
                elif state == "DOT" and op != "(":
                    m = _NAMED_OPERATOR.match(text, begin)
                    if m is None:
                        raise Unlexable(begin)
                    at, kind, after = m.end(), "IDENT", "ARG"
                elif op == "(":
                    touching = begin > 0 and not space
                    kind = "CALLP" if state == "DOT" or state == "ARG" and touching or kinds and kinds[-1] in ("FNAME", "LAMBDA") else "LPAREN"
                    opened.append(("(", False))
                elif op == "[":
                    kind = "LBRACK" if operand or state == "ARG" and space and follows != " " and kinds[-1] in ("IDENT", "FID", "CONST", "YIELD", "SUPER") else "INDEX"
                    opened.append(("[", False))
                elif op == "{":
                    if lambdas and lambdas[-1] == len(opened):
                        lambdas.pop()
                        kind = "LBRACE_L"
                    elif kinds and kinds[-1] == "BEGIN_BLOCK":
                        kind = "'{'"
                    elif operand:
                        kind = "HASH"
                    else:
                        kind = "LBRACE_B"
                        piped = 1
                    opened.append(("{", kind == "HASH"))
                elif op in _CLOSING:
                    if not opened:
                        if inside and op == "}":
                            break
                        raise Unlexable(begin)
                    if opened.pop()[0] != _CLOSING[op]:
                        raise Unlexable(begin)
                    while conditions and conditions[-1] > len(opened):
                        conditions.pop()
                    while lambdas and lambdas[-1] > len(opened):
                        lambdas.pop()
                    if kinds and kinds[-1] == "NL":
                        kinds.pop()
                        places.pop()
                        ends.pop()
                    kind, after = f"'{op}'", "END"
                elif op == "|" and piped:
                    kind = "PIPE"
                    piped = 2 if piped == 1 else 0
                elif op == "||" and piped == 1:
                    kind = "'||'"
                elif op == ";":
                    if kinds and kinds[-1] == "NL" and state == "BEG":
                        continue
                    while conditions and conditions[-1] == len(opened):
                        conditions.pop()
                    kind = "NL"
                elif op == "->":
                    kind, after = "LAMBDA", "ARG"
                    lambdas.append(len(opened))
                elif op in ("*", "&", "**") and (operand or starts) and op != "=":
                    kind = {"*": "STAR", "&": "AMPER", "**": "DSTAR"}[op]
                elif op in ("-", "+") and (operand or starts):
                    kind = "UMINUS"
                elif op == "::":
                    kind = "'::B'" if operand or state == "ARG" and space else "'::'"
                    after = "BEG" if kind == "'::B'" else "DOT"
                elif op in (".", "&."):
                    kind, after = "'.'", "DOT"
                elif op in ("..", "..."):
                    kind = "BDOT2" if operand else "DOT2"
                elif op in ("!", "~"):
                    kind = f"'{op}'"
                elif op in _TOKEN_OF:
                    kind = _TOKEN_OF[op]
                elif op.endswith("=") and op not in ("=",):
                    kind = "OPASGN"
                else:
                    kind = f"'{op}'"
            if piped == 1 and kind not in ("DO_BLOCK", "LBRACE_B", "PIPE"):
                piped = 0
            kinds.append(kind)
            places.append(begin)
            ends.append(at)
            state = after
        if kinds and kinds[-1] == "NL":
            kinds.pop()
            places.pop()
            ends.pop()
        return at

    def string(self, at: int, close: str, again: str, codes: bool, owner: int) -> int:
        """The place after the closing mark of the string that begins at ``owner``; ``again`` is the mark that nests."""
        text, n, depth = self.text, len(self.text), 0
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == close:
                at += 1
                if not depth:
                    return at
                depth -= 1
            elif again and c == again:
                depth += 1
                at += 1
            elif codes and c == "#" and text.startswith("#{", at):
                at = self.run(at + 2, True)
                self.inner.setdefault(owner, []).append(len(self.parts) - 1)
            else:
                at += 1
        raise Unlexable(n)

    def bodies(self, at: int) -> int:
        """The place after the bodies of the heredocs that this line's end begins."""
        text, n = self.text, len(self.text)
        waiting, self.heredocs = self.heredocs, []
        for mark, indented, codes, owner in waiting:
            while True:
                if at >= n:
                    raise Unlexable(n)
                end = text.find("\n", at)
                end = n if end < 0 else end
                line = text[at:end].rstrip("\r")
                if (line.strip() if indented else line) == mark:
                    self.bottom[owner] = at
                    at = min(end + 1, n)
                    break
                if codes and "#{" in line:
                    k = at
                    while k < end:
                        if text[k] == "\\":
                            k += 2
                        elif text.startswith("#{", k):
                            k = self.run(k + 2, True)
                            self.inner.setdefault(owner, []).append(len(self.parts) - 1)
                            if k > end:
                                end = text.find("\n", k)
                                end = n if end < 0 else end
                        else:
                            k += 1
                at = end + 1
        return at
