"""The lexer of JavaScript and the parser of HCL, and what engines make of them."""

import json

import pytest

from lodestrata.operators import config
from lodestrata.operators.calls import java_js_findings
from lodestrata.sources import code, hcl, jslex


def called(text, markup=True):
    return [(c[2], c[3]) for c in code.calls(code.Source(text, "javascript", markup))]


@pytest.mark.parametrize(("text", "want"), [
    ("`a ${f('1')} g('2') ${`${h('3')}`}`; k(`4`)", [("f", "1"), ("h", "3"), ("k", "4")]),
    ("<div a={f('1')} b=\"g('2')\">it's h('3') {k('4')} <b/>{x && <i>m('5')</i>}</div>; n('6')", [("f", "1"), ("k", "4"), ("n", "6")]),
    ("return <>a f('1') {/* g('2') */}<A.B {...h('3')}/></>\nk('4')", [("h", "3"), ("k", "4")]),
    ("if (x) /f('1')/.test(y); z = a / g('2') / b; w = {} / h('3'); return /[/]k('4')\\//", [("test", None), ("g", "2"), ("h", "3")]),
    ("function f() {}\n/g('1')/.exec(h('2'))", [("exec", None), ("h", "2")]),
    ("f<string>('1'); a < b; c > g('2'); h.k<A<B[]>>('3'); x<y>(z)", [("f", "1"), ("g", "2"), ("k", "3"), ("x", None)]),
    ("// f('1')\n/* g('2') */ '\\' h(' + k('3'); \"m('4')\"; #!n", [("k", "3")]),
    ("const a = <T,>(x: T) => f('1'), b = <T extends U>(x) => g('2')", [("f", "1"), ("g", "2")]),
    ("f('unclosed\ng('2'); `never ${h('3')", [("g", "2"), ("h", "3")]),
])
def test_lexer(text, want):
    assert called(text) == want


def test_casts_in_typescript():
    assert called("const c = <any>f('1'); g('2')", markup=False) == [("f", "1"), ("g", "2")]


def test_every_character_is_in_one_token_or_space():
    text = "a = b ? `x${c}y` : /d/g; <p q='r'>s{t}</p>; u<v>(w)\n" * 20
    found = jslex.Lexer(text, True).run()
    assert all(x.end <= y.start for x, y in zip(found, found[1:]))
    left = "".join(text[x.end : y.start] for x, y in zip(found, found[1:]))
    assert not left.strip()


def test_imports_of_any_length():
    names = ", ".join(f"n{k} as m{k}" for k in range(500))
    found = code.js_imports(code.Source(f"import d, {{ {names} }} from 'node:crypto'; import * as e from \"x\"; import 'side'; import(f)\nconst {{ createHash: h, ...rest }} = require('crypto')", "javascript"))
    assert len(found) == 503 and ("m499", "crypto", "n499") in found and ("d", "crypto", None) in found and ("e", "x", None) in found and ("h", "crypto", "createHash") in found


def test_calls_in_templates_and_elements_are_findings(spark):
    text = "import { " + ", ".join(f"x{k}" for k in range(300)) + ", createHash as h } from 'crypto';\nconst a = `v${h('md5')}` + `h('sha1')`;\nexport const P = () => <p title={h('sha512')}>h('sha1') {h(`sha256`)}</p>;\n/h('sha384')/.test(a);"
    rows = [("a.jsx", ".jsx", bytearray(text.encode())), ("b.ts", ".ts", bytearray(b"import c from 'crypto'\nconst d = <any>c.createHash<Buffer>('md5')")), ("T.java", ".java", bytearray(b'import java.security.MessageDigest; class T { String s = """\nMessageDigest.getInstance("MD5") "quoted" """; Object o = MessageDigest.getInstance("SHA-1"); }'))]
    got = {(r.file, r.line, r.algorithm) for r in java_js_findings(spark.createDataFrame(rows, "rel_path string, ext string, content binary")).collect()}
    assert got == {("a.jsx", 2, "MD5"), ("a.jsx", 3, "SHA-512"), ("a.jsx", 3, "SHA-256"), ("b.ts", 2, "MD5"), ("T.java", 2, "SHA-1")}


HCL = r"""
locals {
  a = [for s in var.l : upper(s) if s != ""]
  b = { for k, v in var.m : k => v... }
  c = var.x > 1 && !var.y ? "one ${f("}")}" : 2 + 3 * -4
  d = [1, -2.5, true, null, "x", var.z[0].name, var.w[*].id, var.q.*.id]
  e = {
    "key" = 1, two : "2"
    (var.k) = [
      { insecure = true },
    ]
  }
  f = merge(local.a, { x = 1 }...)
  g = (
    1 + 2
  )
  doc = <<-EOT
    tls_version = "TLSv1.0"
    EOT
}
module "outer" "own" { source = "./m" /* note */
  nested { rsa_bits = 1024 # why
  }
  nested { rsa_bits = var.bits }
}
"""


def test_hcl():
    got = hcl.parse(HCL)
    own = got["locals"][0]
    assert own["a"] == '${[for s in var.l : upper(s) if s != ""]}' and own["b"] == "${{for k, v in var.m : k => v...}}"
    assert own["c"] == '${var.x > 1 && !var.y ? "one ${f("}")}" : 2 + 3 * -4}'
    assert own["d"] == [1, -2.5, True, None, "x", "${var.z[0].name}", "${var.w[*].id}", "${var.q.*.id}"]
    assert own["e"] == {"key": 1, "two": "2", "(var.k)": [{"insecure": True}]}
    assert own["f"] == "${merge(local.a, {x = 1}...)}" and own["g"] == "${(1 + 2)}" and own["doc"].strip() == 'tls_version = "TLSv1.0"'
    assert got["module"] == [{"outer": {"own": {"source": "./m", "nested": [{"rsa_bits": 1024}, {"rsa_bits": "${var.bits}"}]}}}]
    for broken in ('a = "x', "a = [1", "a {", "a = ", "= 1", "}", "a = 1 ? 2", "a = {b}"):
        with pytest.raises(ValueError):
            hcl.parse(broken)
    assert hcl.parse("") == {} and hcl.parse('a = "$${b}"') == {"a": "$${b}"}


def test_problems_of_settings(spark):
    files = [("a.tf", "a.tf", ".tf", b"a = ["), ("b.json", "b.json", ".json", json.dumps({"rsa_bits": 1024}).encode()), ("c.yaml", "c.yaml", ".yaml", b"a: ["), ("d.conf", "d.conf", ".conf", b"\xff"), ("e.yaml", "e.yaml", ".yaml", b"\xff"), ("f.tf", "f.tf", ".tf", HCL.encode())]
    df = spark.createDataFrame([(*f[:3], bytearray(f[3])) for f in files], "path string, name string, ext string, content binary")
    assert {r.path for r in config.config_problems(df).collect()} == {"a.tf", "c.yaml", "d.conf", "e.yaml"}
    assert {(r.file, r.algorithm, r.key_size) for r in config.config_findings(df).collect()} == {("b.json", "RSA", 1024), ("f.tf", "TLS", None), ("f.tf", "RSA", 1024)}


def test_requirements_of_many_lines(spark):
    """Continued lines keep the number of their first one; the time grows with the lines."""
    import time

    from lodestrata.operators import manifests

    text = "a==1 \\\n  --hash=sha256:0 \\ \n --hash=sha256:1\r\n# c\r\nb \\\n==2\rc>=3\\"
    got = manifests.requirements(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert [(r.line, r.name, r.version, r.declared) for r in got] == [(1, "a", "1", "a==1"), (5, "b", "2", "b==2"), (7, "c", None, "c>=3\\")]
    long = "\n".join(f"p{k}==1" + (" \\\n --hash=x" if k % 3 == 0 else "") for k in range(200_000))
    began = time.perf_counter()
    assert manifests.requirements(spark.createDataFrame([("p", long)], "path string, text string")).agg({"line": "max"}).first()[0] == 266_667
    assert time.perf_counter() - began < 60


def test_plain_tokens_are_read_in_one_pass(monkeypatch):
    """A list of names takes no step of the modes for each token, and gives the tokens that such steps give."""
    text = "#!x\nimport { " + ", ".join(f"n{k} as #m{k}" for k in range(500)) + " } from \"a\"; // b\nx = 1.5e-3 + .5 / 2 ?. y => `${z}`;\n"
    steps = []
    step = jslex.Lexer.code
    monkeypatch.setattr(jslex.Lexer, "code", lambda self: (steps.append(self.at), step(self)))
    got = jslex.Lexer(text, True).run()
    assert len(steps) < 20
    monkeypatch.setattr(jslex.Lexer, "plain", lambda self: None)
    assert got == jslex.Lexer(text, True).run() and len(got) > 2000 and type(got[0]) is jslex.Token


@pytest.mark.parametrize("markup", [True, False])
def test_brackets_are_plain_outside_of_templates_and_elements(monkeypatch, markup):
    """They take no step each, and what follows them is read as after such steps."""
    text = "if (a) { f({ b: [c(1)] }); } else { g(); }\n" * 300 + "if (x) /f('1')/.test(y); z = a / g('2') / b; w = {} / h('3'); function f() {}\n/g('1')/.exec(`${{ a: f(1) }} }`);\n"
    steps = []
    step = jslex.Lexer.code
    monkeypatch.setattr(jslex.Lexer, "code", lambda self: (steps.append(self.at), step(self)))
    got = jslex.Lexer(text, markup).run()
    assert len(steps) < 50
    monkeypatch.setattr(jslex.Lexer, "plain", lambda self: None)
    assert got == jslex.Lexer(text, markup).run() and len(got) > 8000


def test_calls_of_other_names_are_not_looked_into(monkeypatch):
    source = code.Source("import { createHash as h } from 'crypto'\nf(g(1), h('md5'));\nx.y.h(2); h\n", "javascript")
    whole, looked = code.calls(source), []
    size = code.Source.size
    monkeypatch.setattr(code.Source, "size", lambda self, k: looked.append(k) or size(self, k))
    assert code.calls(source, {"h"}) == [c for c in whole if c[2] == "h"] and len(whole) == 4 and len(looked) == 2
