import io
import json
import os
import subprocess

import pytest

from twinspan.plans import cli
from twinspan.sources import erb, ruby

BODY = """    total = lines.sum { |line| line.price * line.count }
    total -= discount if discount
    note = Note.where(kind: :total).order(:made_at).first
    note.update(text: "Total #{total}", seen: false)
    deliver(total, note, copies: 2)
"""


def klass(name, method, body=BODY, extra=""):
    return f"class {name}\n  def {method}\n{body}  end\n{extra}end\n"


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def call(spark, root, *args):
    out = io.StringIO()
    code = cli.main([*args, "--root", root, "--format", "json"], spark, out)
    return code, json.loads(out.getvalue()) if out.getvalue() else None


def git(root, *args):
    env = os.environ | {"GIT_COMMITTER_DATE": "1700000000 +0000", "GIT_AUTHOR_DATE": "1700000000 +0000"}
    subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True, env=env)


def test_identical_methods_in_a_plain_folder(spark, tmp_path):
    root = str(tmp_path)
    put(root, "app/models/invoice.rb", klass("Invoice", "settle"))
    put(root, "app/models/receipt.rb", klass("Receipt", "close", BODY.replace("total", "sum").replace("note", "memo")))
    put(root, "app/models/other.rb", klass("Other", "go", "    puts 1\n"))
    code, said = call(spark, root)
    assert code == 1 and said["counts"]["found"] == 1
    (found,) = said["findings"]
    assert found["score"] == 1.0 and found["kind"] == "method" and {found["copy"]["identity"], found["existing"][0]["identity"]} == {"Invoice#settle", "Receipt#close"}
    assert found["hint"].startswith("call or extend ") and said["notes"] == ["without a merge base findings have no labels"] and said["normalizer"] == 1 and said["version"]
    assert call(spark, root, "--min-nodes", "500")[1]["findings"] == []
    assert call(spark, root, "--threshold", "2")[0] == 2 and call(spark, root, "nowhere")[0] == 2
    out = io.StringIO()
    assert cli.main(["explain", "Invoice#settle", "Receipt#close", "--root", root], spark, out) == 0
    assert "score 1.0:" in out.getvalue() and cli.main(["explain", "A", "B", "--root", root], spark, out) == 2


def test_copied_block_in_different_methods(spark, tmp_path):
    root = str(tmp_path)
    loop = "    items.each do |item|\n" + "".join(f"      {line.strip()}\n" for line in BODY.splitlines()) + "    end\n"
    put(root, "lib/a.rb", klass("A", "x", "    alpha = one(1)\n    beta = two(alpha)\n    gamma.three(beta, alpha)\n" + loop + "    finish(gamma) { |g| g.four }\n    five.six.seven\n    @eight = nine[ten]\n"))
    put(root, "lib/b.rb", klass("B", "y", "    return if eleven?\n    raise Twelve, 'no' unless thirteen\n" + loop + "    fourteen << fifteen << sixteen\n    while seventeen do eighteen.nineteen end\n"))
    code, said = call(spark, root)
    assert code == 1 and [f["kind"] for f in said["findings"]] == ["fragment"]
    assert "make a concern" in said["findings"][0]["hint"]


def test_parse_errors_outrank_findings(spark, tmp_path):
    root = str(tmp_path)
    put(root, "lib/a.rb", "def x(\n")
    put(root, "app/views/a.html.erb", "<div>\n<% if x %>\n</div>\n")
    code, said = call(spark, root)
    assert code == 2 and [e["path"] for e in said["parse_errors"]] == ["app/views/a.html.erb", "lib/a.rb"]


def test_base_contract_and_cache(spark, tmp_path):
    root, store = str(tmp_path / "r"), str(tmp_path / "cache")
    put(root, "app/models/invoice.rb", klass("Invoice", "settle"))
    put(root, "app/models/receipt.rb", klass("Receipt", "close"))
    put(root, "lib/gone.rb", klass("Gone", "away"))
    git(root, "init", "-q", "-b", "main")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    git(root, "checkout", "-qb", "work")
    assert call(spark, root)[1]["findings"][0]["class"] == "already_there"
    put(root, "app/models/ticket.rb", klass("Ticket", "end_it"))
    os.remove(os.path.join(root, "lib/gone.rb"))
    for _ in range(2):  # from a sweep, then from the cache
        code, said = call(spark, root, "--cache", store)
        (found,) = said["findings"]
        assert code == 1 and found["class"] == "introduced" and found["copy"]["identity"] == "Ticket#end_it" and len(found["existing"]) == 2
    put(root, "contract/billing/README.md", "```covers\nInvoice\n```\n")
    put(root, "contract/billing/duplication.md", "# Apart on purpose\n```parallel\nInvoice#settle\nReceipt#close\nTicket#end_it\n```\n# Stale\n```parallel\nNope#x\nInvoice\n```\n")
    code, said = call(spark, root, "--introduced-only")
    assert said["findings"] == [] and len(said["kept"]) == 2 and said["kept"][0]["new_clause"] and code == 1
    assert {e["message"] for e in said["contract_errors"]} == {"no unit is called Nope#x", "the clause keeps no match and can go"}
    put(root, "lib/fourth.rb", klass("Fourth", "hidden"))
    code, said = call(spark, root)
    places = {p["identity"] for f in said["findings"] for p in (f["copy"], *f["existing"])}
    assert code == 1 and places == {"Invoice#settle", "Receipt#close", "Ticket#end_it", "Fourth#hidden"}


def test_eight_hundred_copies(spark, tmp_path):
    root = str(tmp_path)
    for k in range(800):
        put(root, f"lib/c{k:03}.rb", klass(f"C{k}", "same"))
    code, said = call(spark, root)
    assert code == 1 and len(said["findings"]) == 1 and len(said["findings"][0]["existing"]) == 799


def test_units_and_names():
    source = "module A\n  class B < C\n    scope :x, -> { where(a: 1) }\n    before_save { a }\n    before_save { b }\n    def m; end\n    def self.n; end\n    def A.o; end\n    def obj.p; end\n    class << self\n      def q; end\n    end\n    P = Struct.new(:x) do\n      def r; <<~X\n        text\n      X\n      end\n    end\n    define_method(:s) { 1 }\n    def m; end\n  end\n  T.class_eval do\n    def u; end\n  end\nend\ndef v; end\n"
    got = [(u.kind, u.identity, u.start_line, u.end_line) for u in ruby.units(source)]
    assert [x[1] for x in got] == ["A::B.scope(:x)", "A::B.before_save[1]", "A::B.before_save[2]", "A::B#m", "A::B.n", "A.o", "A::B.q", "A::B::P#r", "A::B#s", "A::B#m[2]", "T#u", "Object#v"]
    assert got[7][2:] == (14, 17)
    with pytest.raises(ruby.Unreadable) as e:
        ruby.units("def a\n  (\nend\n")
    assert e.value.line == 3


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("x = foo(1); x.bar(y: 2)", "z = foo(9); z.bar(y: 'q')", True), ("(a + b)", "a + b", True), ("a + b", "a - b", False), ("x.foo", "x.bar", False), ("edit_order_path(@a)", "invoice_path(@b)", True), ("r.original_url", "r.service_url", False),
        ("x += 1", "x -= 1", False), ("x += 1", "y += 2", True), ("f(data: { controller: 'a' })", "f(data: { controller: 'b' })", False), ("f(data: { x: 'a' })", "f(data: { x: 'b' })", True), ("A::B.c", "D.c", True), ("@a", "$a", False), ("x = 1; x", "x", False),
        ("if a then b end", "b if a", True), ("a.b do |x| x end", "a.b { |x| x }", True), ("a.t += 1", "a.u += 1", False),
    ],
)
def test_normalizing(a, b, same):
    shape = lambda s: [r[5:7] for r in __import__("twinspan.sources.frontends", fromlist=["x"]).flattened(ruby.normalized(ruby.Reader(s).program()))]
    assert (shape(a) == shape(b)) is same


def test_templates():
    same = erb.template_tree("<p class='a'><%= order.total %></p>\n"), erb.template_tree('<p class="b"><%= bill.total %></p>\n')
    assert same[0] == same[1]
    assert erb.template_tree("<p data-action='a'></p>") != erb.template_tree("<p data-action='b'></p>")
    for bad in ("<p>", "<% if a %>", "</p>", "<%= foo( %>"):
        with pytest.raises(ruby.Unreadable):
            erb.template_tree(bad)


def test_run_of_many_copies_with_one_on_one_line(spark, tmp_path):
    """51 copies of a run, the one in the longest body on one line: the other 50 are still found."""
    root = str(tmp_path)
    run = [line.strip() for line in BODY.splitlines()][:4]
    filler = [f"step_{k}(:a{k}, {k} => [{k}, :b{k}], with: other_{k}.call({k}))" for k in range(12)]
    put(root, "m0.rb", klass("M0", "m0", "    " + "; ".join(run) + "\n" + "".join(f"    {x}\n" for x in filler)))
    for k in range(1, 51):
        own = [f"case v{k}", *(f"when {j + 20} then go(:w{j}, x: {j}, y: [{k}])" for j in range(k % 5 + 3)), "end", f"@w{k} = {{ a: {k}, b: [{k}, :c], d: f({k}) }}", f"@v{k} = g({k}) {{ |z| z + {k} }} if h({k}, :q{k})"]
        put(root, f"m{k}.rb", klass(f"M{k}", f"m{k}", "".join(f"    {x}\n" for x in run + own)))
    _, said = call(spark, root, "--threshold", "0.9")
    held = {x["path"] for found in said["findings"] for x in [found["copy"], *found["existing"]] if found["kind"] == "fragment"}
    assert held >= {f"m{k}.rb" for k in range(1, 51)}
