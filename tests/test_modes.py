import pytest

from tessera import create_index
from tessera.config import Config
from tessera.types import BuildOptions, SearchOptions


@pytest.fixture
def idx(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TESSERA_STATE", str(tmp_path / "state"))
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    for k, word in enumerate(("walrus", "heron", "walrus heron", "otter")):
        (root / ("sub" if k == 2 else ".") / f"f{k}.py").write_text(f"def f{k}():\n    value = '{word}'\n    return value, 'padding so that the chunk is kept'\n")
    index = create_index(spark, str(root), Config("hash:32"))
    index.build()
    yield index
    index.close()


def paths(found):
    return [r.filePath for r in found.collect()]


def test_text_search_and_its_filters(idx):
    text = lambda query, **more: paths(idx.search(query, SearchOptions(mode="text", **more)))
    assert set(text("Walrus")) == {"f0.py", "sub/f2.py"} and text("heron walrus")[0] == "sub/f2.py"
    assert text("walrus", file_prefix="sub/") == ["sub/f2.py"] and text("walrus", language=["ts"]) == [] and text("unheard") == []
    assert len(text("def value", limit=2)) == 2
    best = idx.search("heron walrus", SearchOptions(mode="text")).collect()
    assert [r.score for r in best] == sorted((r.score for r in best), reverse=True) and best[0].content


def test_text_index_follows_commits(idx):
    assert idx.text_index().size()[0] == 4 and idx.text_index().meta["versions"] == [1]
    root = idx.project.root
    with open(f"{root}/f0.py", "w") as f:
        f.write("def f0():\n    value = 'puffin'\n    return value, 'padding so that the chunk is kept'\n")
    idx.build()
    text = lambda query: paths(idx.search(query, SearchOptions(mode="text")))
    assert text("puffin") == ["f0.py"] and text("walrus") == ["sub/f2.py"]  # what is gone isn't found
    assert idx.text_index().meta["versions"] == [1, 2]
    idx.build(BuildOptions(reset=True))
    assert text("puffin") == ["f0.py"]


def test_hybrid_search(idx):
    vector = paths(idx.search("walrus heron value", SearchOptions(limit=4)))
    both = idx.search("walrus heron value", SearchOptions(limit=4, mode="hybrid")).collect()
    assert both[0].filePath == "sub/f2.py" and {r.filePath for r in both} == set(vector)
    assert 1 / 61 < both[0].score < 2 / 61 + 1e-9
    assert paths(idx.search("walrus", SearchOptions(limit=4, mode="hybrid", min_score=1.0))) == []


def test_modes_that_cannot_be(idx):
    for options in (SearchOptions(mode="odd"), SearchOptions(mode="text", negative="x"), SearchOptions(mode="hybrid", across=["/a"])):
        with pytest.raises(ValueError):
            idx.search("x", options)
