import pytest

from tessera.sources.ignore import DEFAULT_IGNORE, Matcher, Nested, extensions


@pytest.mark.parametrize(
    "lines, path, ignored",
    [
        (["*.log"], "a/b.log", True),
        (["*.log", "!keep.log"], "a/keep.log", False),
        (["/top.txt"], "top.txt", True),
        (["/top.txt"], "a/top.txt", False),
        (["out/"], "out/x.py", True),
        (["out/"], "out", False),
        (["a/**/z.py"], "a/z.py", True),
        (["a/**/z.py"], "a/b/c/z.py", True),
        (["docs/*.md"], "docs/x.md", True),
        (["docs/*.md"], "docs/a/x.md", False),
        (["**/tmp"], "q/tmp/f", True),
        (["build", "!build/keep.py"], "build/keep.py", True),
        (["a[0-9].py"], "a7.py", True),
        (["a[!0-9].py"], "a7.py", False),
        (["# note", "", "\\#x"], "#x", True),
        (DEFAULT_IGNORE, "p/node_modules/x.js", True),
        (DEFAULT_IGNORE, "src/main.py", False),
    ],
)
def test_rules(lines, path, ignored):
    assert Matcher(lines)(path) is ignored


def test_nested_rules_hold_below_their_folder():
    rules = Nested(["*.tmp"], {"sub": ["/x.py", "*.gen.py"]})
    assert rules("sub/x.py") and rules("sub/a/y.gen.py") and rules("q.tmp")
    assert not rules("x.py") and not rules("sub/a/x.py")


def test_extensions():
    assert ".xyz" in extensions(include=[".xyz"]) and ".py" not in extensions(exclude=[".py"])
