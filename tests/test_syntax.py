import json

from hypothesis import given
from hypothesis import strategies as st

from tessera.operators import syntax

PY = '''import os

# says hello

@cache
def hello(name):
    return "hello " + name


class Greeter:
    """Greets."""

    def greet(self):
        return 1


def x(): pass
'''


def chunks(path, text):
    return syntax.chunk_file(path, text, syntax.PARSERS)


def test_python():
    got = [(r[4], r[5], r[2], r[3]) for r in chunks("a.py", PY)]
    assert got == [("decorated_definition", "hello", 5, 7), ("class_definition", "Greeter", 10, 14)]
    assert "[role: orchestration]" in chunks("a.py", PY)[0][7] and "[doc: # says hello]" in chunks("a.py", PY)[0][7]


def test_oversize_gives_way_to_what_is_inside():
    big = "class A:\n" + "".join(f"    def f{k}(self):\n        return '{'x' * 200}'\n\n" for k in range(200))
    got = chunks("a.py", big)
    assert len(got) == 200 and {r[4] for r in got} == {"function_definition"} and "[scope: class A]" in got[0][7]


def test_windows_where_nothing_is_found():
    got = chunks("notes.md", "\n".join(map(str, range(60))))
    assert [(r[2], r[3]) for r in got] == [(1, 50), (26, 60), (51, 60)]
    assert [r[4] for r in chunks("broken.py", "def (:\n" * 3)] == ["block"]


def test_other_languages():
    js = "export function a(x) {\n  return { y: '}' };\n}\n\nclass B extends C {\n  m() {}\n}\n"
    assert [(r[4], r[5]) for r in chunks("a.js", js)] == [("export_statement", "a"), ("class_declaration", "B")]
    rs = "// adds\nfn add(a: i32) -> i32 {\n    a + 1\n}\n\nimpl Foo for Bar {\n    fn z() {}\n}\n"
    assert [(r[4], r[5]) for r in chunks("a.rs", rs)] == [("function_item", "add"), ("impl_item", "Bar")]
    assert [r[5] for r in chunks("a.json", '{\n "name": {"a": 1,\n "b": 2},\n "other": [1,\n 2]}')] == ["name", "other"]
    assert [r[5] for r in chunks("a.yaml", "one:\n  a: 1\n  b: 2\ntwo:\n  - x\n  - y\n")] == ["one", "two"]
    assert [r[5] for r in chunks("a.toml", "[tool]\na = 1\nb = 2\n\n[tool.x]\nc = 3\n")] == ["tool", "tool.x"]
    assert [r[4] for r in chunks("a.html", "<html>\n<body><p>x</p></body>\n</html>")] == ["element"]


def spans(language, text):
    return {(s.kind, s.name): text[s.start : s.end] for s in syntax.PARSERS[language](text)}


def test_members():
    java = "public class A {\n  public A(int y) {\n    x = y;\n  }\n  static <T> List<T> go(T t) throws E {\n    if (t == null) { return null; }\n  }\n}\n"
    assert set(spans("java", java)) == {("class_declaration", "A"), ("constructor_declaration", "A"), ("method_declaration", "go")}
    js = "class A {\n  async go(x) {\n    if (x) { y() }\n  }\n}\nconst f = async (a) => {\n  return a\n};\n"
    assert spans("javascript", js)["method_definition", "go"].endswith("}\n  }") and ("arrow_function", "") in spans("javascript", js)
    go = "const (\n  A = 1\n  B\n)\n\nvar x = map[string]int{\n  \"a\": 1,\n}\n\nfunc f() int {\n  return 1\n}\n"
    assert [v for k, v in spans("go", go).items() if k[0] != "function_declaration"] == ["const (\n  A = 1\n  B\n)", "var x = map[string]int{\n  \"a\": 1,\n}"]


def test_languages_that_end():
    ruby = "module M\n  class A < B\n    def go(x)\n      if x\n        1\n      end\n    end\n    def self.k; 1; end\n  end\nend\n"
    assert set(spans("ruby", ruby)) == {("module", "M"), ("class", "A"), ("method", "go"), ("singleton_method", "k")}
    assert spans("ruby", ruby)["method", "go"].count("end") == 2 and spans("ruby", ruby)["module", "M"] == ruby.strip()
    lua = "local function a(x)\n  return x\nend\nM.f = function(y)\n  if y then\n    z()\n  end\nend\n"
    assert spans("lua", lua)["function_definition", "M.f"].endswith("  end\nend")
    zig = "const std = @import(\"std\");\npub const P = struct {\n  pub fn go(self: P) i32 {\n    return 1;\n  }\n};\ntest \"a\" {\n  x();\n}\n"
    assert {k for k, _ in spans("zig", zig)} == {"VarDecl", "ContainerDecl", "FnProto", "TestDecl"}


def test_nested_pairs_split_above_the_limit():
    inner = {f"k{k}": "x" * 300 for k in range(200)}
    got = chunks("a.json", json.dumps({"top": inner, "b:": "a \"c\": d"}, indent=1))
    assert len(got) == 200 and "[scope: " not in got[0][7] and {r[4] for r in got} == {"pair"}
    got = chunks("a.yaml", "top:\n" + "".join(f"  k{k}: {'x' * 300}\n" for k in range(200)))
    assert len(got) == 200 and got[7][5] == "k7"
    assert [r[5] for r in chunks("b.yaml", "a: &x\n  b: [*x]\n  c: some more words of it\n")] == ["a"]


def test_every_failure_gives_windows():
    for path, text in (("a.yaml", "a: {{ b }}\n c: *x\n"), ("a.yaml", "x: *nope\n"), ("a.html", "<![foo"), ("a.json", "{"), ("a.toml", "= ="), ("a.py", "def a(:\r")):
        assert [r[4] for r in chunks(path, text)] == ["block"]
    mac = "def a(x):\r  return 1\rclass B:\r  def c(self):\r    return '" + "x" * 60 + "'\r"
    assert [(r[4], r[5]) for r in chunks("a.py", mac)] == [("class_definition", "B")]


@given(st.text(alphabet="ab \n", max_size=400))
def test_windows_cover_every_line_with_text(text):
    covered = {k for r in syntax.windows("x", text) for k in range(r[2], r[3] + 1)}
    assert {k for k, line in enumerate(text.split("\n"), 1) if line.strip()} <= covered
