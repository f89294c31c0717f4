import ast
import inspect
import io
import json
import random
import textwrap
import tokenize
import warnings

import pytest

from twinspan.grammars import lr
from twinspan.llm.grammars import python_text
from twinspan.llm.parsing import first_error, parse_errors

GOOD_RUBY = '''
a, b = 1, 2
x = foo 1, 2 do |y, (z, w), *r, k: 1, **o, &blk| y end
puts [1,2].map { |q| q + 1 }.select(&:even?)
foo.bar baz, qux: 1 unless x && !y
def m(a, b = 2, *c, d:, e: 5, **f, &g) = a + b
def self.n; end
def o a, b
  return a, b if a
  yield a
rescue Foo, Bar => e
  retry
else
  1
ensure
  puts "x #{a ? "q" : 'r'} y"
end
class A::B < C
  class << self
    attr_reader :x
  end
end
case x
when 1, 2 then y
when String
  z
else
  w
end
case [1, 2]
in [Integer => a, *rest] if a > 1
  a
in {name: String => n, age:}
  n
in 1.. | nil
  2
end
h = { a: 1, "b": 2, :c => 3, "d" => 4, **z, if: 5, end: 9 }
l = ->(x, y = 1) { x * y }
while x < 3 do x += 1 end
for i in 1..10 do puts i end
x ||= {}
a&.b&.c = 3
z = x ? :a : :b
puts(<<~A, <<-B)
  hello #{x + "}"}
<<<<<<< kept
A
  foo
  B
s = %w[a b c].freeze + %i(d e)
r = /a\\/b[(]/i =~ s
r = s / 2 / 3
A
  .foo # comment
  # another
  &.bar(1)
raise ArgumentError, "bad" unless defined?(X)
a, (b, c), *d = e
x = if y then 1 else 2 end
foo(
  a,
  b: 1,
)
def []=(k, v)
end
entry += 2 while entry < 39
=begin
class def (
=end
__END__
class (not code
'''


@pytest.mark.parametrize("text", [GOOD_RUBY, "", "\n\n", "# only a comment", "x", "{ \"a\": 1, \"b\": [null] }", "import sys\n", GOOD_RUBY.replace("\n", "\r\n")])
def test_ruby_reads(text):
    assert first_error(text, "ruby") is None


@pytest.mark.parametrize(
    "text",
    ["def f", "if x", "x = [1", "end", "foo(", "def f(x)\n\"a", "<<<<<<< HEAD\n a\n=======\n b\n>>>>>>> x", "x = {a: 1", "def f(a, b=1):\n  return 1", "case\n", "x = = 1", "a: 1\nb: 2", "1 2", "<div>\n</div>", "foo(1 2)", "when 1", "x.", "=begin\nfoo",
     "begin; rescue", "e = %w[a b", "x ? y", "scope :x, lambda { |y|", "puts 'it", "<<~A\nfoo\n", "def x\n  y = 1\n<<<<<<< HEAD\n  z\n=======\n  w\n>>>>>>> b\nend", "x = \"#{a b c\"", "x = \"#{)}\"", "foo)"],
)
def test_ruby_fails(text):
    assert first_error(text, "ruby") is not None


@pytest.mark.parametrize(
    "text",
    ["", "plain text", "<div><br><p>a &gt; b</p></div>", "<% if a %><b>x</b><% elsif b %>y<% else %><i></i><% end %>", "<%= form_with do |f| %><%= f.x %><% end %>", "<%# if x do %>", "<!-- <div> <<<<<<< x\n=======\n -->", "<input type=\"text\" name=\"a[b]\">", "a < b",
     "<% case x %>\n<% when 1 %>a<% else %>b<% end %>", "<a href=\"<%= x %>\">y</a>", "<% xs.each { |x| %><p><%= x %></p><% } %>", "<script>if (a < b) { '</div>' }</script>", "<!DOCTYPE html><html></html>", "<%% raw %>", "<%- x -%>"],
)
def test_erb_reads(text):
    assert first_error(text, "erb") is None


@pytest.mark.parametrize(
    "text",
    ["<div>", "</div>", "<div></p>", "<% if a %>", "<% end %>", "<% if a %><div><% end %></div>", "<%= x", "<div class=\"a", "<!-- x", "<p>\n<<<<<<< HEAD\n<br>\n=======\n>>>>>>> b\n</p>", "<% if a %><% else %><% else %><% end %>", "<%= foo( %>", "<% x.each do |y| %><b></b>"],
)
def test_erb_fails(text):
    assert first_error(text, "erb") is not None


PYTHON = ["", "x = 1\n", "def f(a, /, b: int = 1, *c, d, **e) -> int:\n    return a if b else [x async for x in y]\n", "match x:\n    case {'a': 1, **r} if r:\n        pass\n    case [a, *_] | (1 as b):\n        pass\n", "match = 1\nmatch.x = match[1]\n",
          "with (open(a) as b, c as d):\n    pass\n", "f'{x!r:>{w}} {f\"{y}\"}'\n", "async def g():\n    await x\n    async with a as b: pass\n", "type X[T] = list[T]\n", "class A[T](B, m=C): x: int = 1\n", "try:\n    pass\nexcept* (A, B) as e:\n    pass\nelse:\n    pass\nfinally:\n    pass\n",
          "lambda *a, k=1, **b: (yield)\n", "x[1:2, ::3, *a] = {**b, 'c': d}\n", "print(*a, **b, c=1, d=(y := 2))\n", "from . import a as b, c\nfrom ...x import (y, z,)\n", "{\"a\": null}", "@a.b(c)\ndef f(): ...\n", "x = yield\n", "a = b = c, *d\n", "del a, b[0]\nglobal q\n", "if (n := f()) and not x is not y: pass\n",
          "def f(:\n", "x = (1\n", "if x\n    y\n", "return = 1\n", "<<<<<<< HEAD\n", "x = 'a\n", "  x = 1\n y = 2\n", "class A\n", "a b\n", "def f(row)\n  x\nend\n", "<%= x %>\n", "print 'a'\n", "x = [1,,2]\n", "else: pass\n", "\"\"\"abc\n"]


MORE_PYTHON = [
    '1 = x', 'f(a=1, 2)', 'def f(a=1, b): pass', '(a, b): int = 1', "f'{a b}'", "f'{x!z}'", "f'{x!r:>{w}} {y=}'", "f'{}'", 'except A, B: pass', 'try:\n pass\nexcept A, B:\n pass', 'x = y := 3', 'y := 3', '(y := 3)',
    '[*a for a in b]', 'f(x for x in y)', 'f(x for x in y, 1)', 'f(1, x for x in y)', 'class A(x for x in y): pass', 'def f(*): pass', 'def f(*, **k): pass', 'def f(*, a): pass', 'def f(a, /, b, *, c=1, d, **k,): pass',
    'def f(/, a): pass', 'def f(a, /, b, /): pass', 'def f(**k, a): pass', 'def f(a=1, /, b): pass', 'def f(a=1, /, b=2, *c, d): pass', 'lambda a=1, b: 0', 'lambda *, a: 0', 'lambda *: 0', '(a as b)', 'with (a as b): pass',
    'with (a as b, c): pass', 'with (a as b), c: pass', 'with (a, b) as c: pass', 'with a as b.c, d as e[0]: pass', 'with a as f(): pass', 'for f() in x: pass', 'for x.y, *z in w: pass', 'for (a, b), [c] in w: pass',
    'del a, b[0], (c, d), [e]', 'del f()', 'del *a', 'del a + b', 'a + b.c = 1', 'a.b = c[0] = (d, *e) = f', 'x = lambda a=1: a', 'a = b = lambda c=1: c', 'x = yield = 1', 'x = yield', 'x += yield', 'a, b += 1', '(a) += 1',
    '(a): int = 1', 'a.b: int', '[a]: int', '*a, b = c', '*a = c', '(*a) = c', '(*a, b) = c', '() = x', '[] = x', 'None = 1', 'a = None = b', 'f() = 1', 'f().x = 1', "'a'.b = 1", 'await x.y = 1', "b'a' 'b'", "b'a' b'b'", "b'é'",
    "'\\x1'", "b'\\u1'", "'\\u12'", "r'\\u12'", "'\\N{bogus name}'", "'\\N{DASH}'", "'\\N{EN DASH}'", 'f(**a, *b)', 'f(**a, b=1)', 'f(a=1, *b)', 'f(*a, b)', 'f(b=1, c)', 'f(a:=1)', 'f(a:=1, b=2)', 'x[a:=1]', 'x[1:2, ::3, *a]',
    'x[*a]', 'x[**a]', "match x:\n case 1 | -2 | 1+2j | 'a' 'b' | None: pass", 'match x:\n case f(): pass\n case A(1, x=2): pass\n case A(x=1, 2): pass',
    "match x:\n case {'a': b, **r}: pass\n case [a, *_] | (1 as b): pass\n case (): pass\n case a.b: pass\n case *a, b: pass\n case _ if x: pass", 'match x:\n case *a: pass', 'match x:\n case a + b: pass',
    'match *a, b:\n case _: pass', 'match x := y:\n case _: pass', 'match = 1', 'match(x)', 'match (x):\n case 1: pass', 'type X = int', 'type = 1', 'type X[T: int = str, *U, **V] = list[T]', 'class A[T](B, m=C): x: int = 1',
    'try:\n pass\nexcept* A as e:\n pass\nexcept B:\n pass', '[x for x in y if z if w]', '[x for x in y if lambda: 1]', '[x for x in y if (z := 1)]', '[x for x in lambda: y, z]', "{**a, 'b': 1}", '{*a, b}', '{a: b for c in d}',
    '{**a for b in c}', '{a: *b}', "print 'a'", 'x = *a, *b', 'return *a, b', 'x: int = *a, b', 'x = (*a)', '(*a)', '(*a,)', '*a', '*a, b', 'if *a: pass', 'while (n := f()): pass', '@a.b(c)\n@d[0]\ndef f(): ...',
    '@x := y\ndef f(): ...', 'async def f():\n async with a as b, c: pass\n async for x in y: pass\n return [await z async for z in w]', 'from . import a', 'from .. import *', 'from ...a.b import (c as d, e,)',
    'from a import b,', 'import a.b as c, d', 'import a.b.c as d.e', 'global a, b', 'nonlocal a', 'raise A from B', 'raise A, B', 'assert a, b', 'assert (a, b)', 'a if b else c', 'a if b', 'lambda: (yield)', 'lambda x: yield',
    'not not a', 'a not in b is not c', '-a ** -b', 'a @ b', 'a <> b', 'a ? b', '`a`', 'x = 1 if y else 2 if z else 3', 'x = [\n1,\n2]', 'if x: pass; y = 1\nelse: z', "f'{x:{y}}'", "f'{x:{y}{z!r}}' 'abc' f'{{}}'",
    "f'{lambda x: 1}'", "f'{(lambda x: 1)}'", "f'{*a, b}'", "f'{yield}'", "f'{x = }'", "f'{x!r = }'", 'f"{\'a\' if b else \'c\'}"', 'f\'{a["b"]}\'', "f'{x:%Y-%m-%d}'", "f'{'", "f'}'", "rf'{x}\\d'", "f'\\x1'", "f'{x}' b'a'",
    'def f[T](x: T) -> T: return x', 'def f(x: *a): pass', 'def f(*x: *a): pass', 'class A: pass; x', 'with open(a) as (b, c): pass', 'with (yield): pass', 'with (a): pass', 'with (a, b): pass', 'with (a,): pass',
    'with (a as b,): pass', 'with (a as b) as c: pass', 'with ((a as b)): pass', 'print((a as b))', 'for x in *a, b: pass', 'for x, in y: pass', 'for *x in y: pass', 'for x in y: pass\nelse: pass', 'def f(): return',
    'x = (yield)', 'x = a, = b', 'x, y = y, x = z', 'i = j += 1', 'i += j = 1', 'a: int: str', 'a: b, c', 'a: lambda: b', 'a[lambda x=1: x] = 2', 'lambda x=1: x = 2', '1 + 1 = 2', 'a and b = c', 'not a = b', 'a < b = c',
    '(a if b else c) = d', '(a, b + c) = d', '[a, f()] = d', '{a} = b', "'a' = b", '... = a', 'a.b.c() [0].d = e', 'del (a)', 'del (a), (b,)', 'del ()', 'del x,', 'del', 'x = {1: 2, **a, 3: 4,}', 'x = {1: 2, 3}', 'x = {1, 2: 3}',
    'x = {,}', 'x = (,)', 'x = [,]', 'f(,)', 'f(a,)', 'f(a,,b)', 'f(*)', 'f(**)', 'f(a b)', 'if True:\nx', 'if x:\n  y\n z', '  x', '\tx\n        y', 'x\\\n = 1', 'x \\ y', '0777', '0o8', '1__0', '1_000', '0x_f', '1e', '1.e5',
    '1j', '1if x else 2', 'é = 1', 'x = \xa0 1', 'a\u200b = 1', '$x', 'x!', '!x', 'a = b # c', '"""a\nb"""', "'a\nb'", "'a\\\nb'",
]


def reads_as_python(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError):
            return False


@pytest.mark.parametrize("text", PYTHON + MORE_PYTHON)
def test_python_agrees_with_its_own_parser(text):
    assert (first_error(text, "python") is None) == reads_as_python(text)


def test_changed_python_agrees_with_its_own_parser():
    """Statements of the standard library with tokens dropped, added or replaced; the grammar alone decides."""
    rng = random.Random(2)
    words = "= , ( ) [ ] * ** : lambda if else for in x 1 'a' yield as and not . += := == import from { } await match case type / None del return".split()
    seen = set()
    for module in (ast, json, random, textwrap):
        text = inspect.getsource(module)
        assert first_error(text, "python") is None
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.stmt) and (part := ast.get_source_segment(text, node)) and "\n" not in part and len(part) < 120:
                seen.add(part)
    for part in sorted(seen):
        tokens = [t.string for t in tokenize.generate_tokens(io.StringIO(part).readline) if t.string.strip()]
        for _ in range(3):
            changed = list(tokens)
            at = rng.randrange(len(changed))
            changed[at : at + rng.randint(0, 1)] = rng.sample(words, rng.randint(0, 1))
            text = " ".join(changed)
            assert (first_error(text, "python") is None) == reads_as_python(text), text


def test_the_python_grammar_has_no_conflict():
    assert not lr.build(python_text.GRAMMAR).conflicts


@pytest.mark.parametrize("text", ['{"a":[1,2,{"b":null}]}', "", "[1,]", '{"a":1}}', "[01]", '"\\u12"', "nul", "[1 2]", "-1.5e3 ", '"\t"', "\n[]\n", '{"a" 1}', "{a: 1}", "1", "[1}", '"\\x"', "--1", "1.", '{"a":1,}', "<<<<<<< HEAD"])
def test_json_agrees_with_the_standard(text):
    try:
        json.loads(text)
        reads = True
    except ValueError:
        reads = False
    assert (first_error(text, "json") is None) == reads


def test_tables_of_an_ambiguous_grammar_follow_precedence():
    tables = lr.build("%left '+'\n%left '*'\n%nonassoc '<'\ne: e '+' e | e '*' e | e '<' e | N ;")
    assert not tables.conflicts
    assert lr.parse(tables, ["N", "'+'", "N", "'*'", "N"]) is None
    assert lr.parse(tables, ["N", "'<'", "N", "'<'", "N"]) == 3
    assert lr.parse(tables, ["N", "'+'"]) == 2


def test_table_of_files(spark):
    rows = [(1, "a.rb", "x = 1\n", "z"), (2, "b.rb", "def x\n  (\nend", "z"), (3, "c.json", "", "z"), (4, "d.py", None, "z"), (5, "e.txt", "(((", "z"), (6, None, "(", "z"), (None, "f.JSON", "[", "z"), (2, "b.rb", "def x\n  (\nend", "z"), (7, "x.html.erb", "<b>" * 5000, "z")]
    files = spark.createDataFrame(rows, "id bigint, p string, c string, language string")
    got = sorted(((r["id"] or 0), r["language"], r["line_no"]) for r in parse_errors(files, "id", "p", "c").collect())
    assert got == [(0, "json", 1), (2, "ruby", 3), (2, "ruby", 3), (3, "json", 1), (7, "erb", 1)]
    assert parse_errors(files.limit(0), "id", "p", "c").count() == 0
