"""Build, search, repair, watch and exchange on a small tree."""

import json
import random
import socket
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera import create_index
from tessera.cli import answered, completions
from tessera.config import Config, parse
from tessera.exchange import IncompatibleError, export, import_
from tessera.functions import secrets
from tessera.index import DimensionError, Index, within
from tessera.operators.embedding import HashEmbedder, Resilient, embedded, embedder_for
from tessera.sources import snapshots
from tessera.sources.snapshots import LockedError, Store
from tessera.streaming.watch import Watcher
from tessera.tools import ToolCore
from tessera.types import BuildOptions, Extensions, SearchOptions

CODE = "def {0}(value):\n    # {0} of values\n    total = value + 1\n    return total\n"


@pytest.fixture(autouse=True)
def patient(monkeypatch):
    monkeypatch.setattr(Index, "STATUS_SECONDS", 60.0)


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.setenv("TESSERA_STATE", str(tmp_path / "state"))
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name in ("alpha", "beta", "gamma"):
        (root / f"{name}.py").write_text(CODE.format(name))
    (root / "sub" / "notes.md").write_text("zebra crossing\nand more text here\n")
    (root / "sub" / "skip.py").write_text(CODE.format("skip"))
    (root / "sub" / ".gitignore").write_text("skip.py\n")
    (root / "node_modules" / "x.js").write_text("function x() {\n return 1\n}\n")
    (root / "pkg").mkdir()
    (root / "pkg" / "__init__.py").write_text(CODE.format("start"))
    (root / "data.bin").write_bytes(b"\0\1")
    return root


def index(spark, root, **options):
    return create_index(spark, str(root), Config("hash:32", **options), HashEmbedder(32), log=lambda m: None)


def paths(idx):
    return sorted(r[0] for r in idx.store.chunks().select("filePath").distinct().collect())


def contents(idx):
    return sorted(tuple(r) for r in idx.store.chunks().select("id", "context", "content", "fileHash").collect())


def test_build_search_repair(spark, tree):
    idx = index(spark, tree)
    assert idx.build(BuildOptions(dry=True)).planned == ["alpha.py", "beta.py", "gamma.py", "pkg/__init__.py", "sub/notes.md"]
    assert not idx.store.exists()
    assert idx.build().succeeded == 5
    assert paths(idx) == ["alpha.py", "beta.py", "gamma.py", "pkg/__init__.py", "sub/notes.md"]
    again = idx.build()
    assert (again.succeeded, again.already_indexed) == (0, 0)
    assert idx.search("zebra crossing").first()["filePath"] == "sub/notes.md"
    assert [r.filePath for r in idx.search("zebra", SearchOptions(language=["md"])).collect()] == ["sub/notes.md"]
    assert idx.search("beta", SearchOptions(file_prefix="sub/")).count() == 1
    assert idx.search("beta", SearchOptions(type=["function_definition"], limit=2)).count() == 2
    three, four = (idx.search("beta value", SearchOptions(limit=k)).collect() for k in (3, 4))
    assert four[:3] == three
    assert idx.search("beta", SearchOptions(min_score=5.0)).count() == 0
    report = idx.repair(dry=True)
    assert (report.orphaned, report.stale, report.chunk_mismatch) == ([], [], [])

    (tree / "beta.py").write_text(CODE.format("delta"))
    (tree / "gamma.py").unlink()
    (tree / "copy.py").write_text(CODE.format("alpha"))
    assert {(r.filePath, r.kind) for r in idx.changes().collect()} == {("beta.py", "modified"), ("gamma.py", "deleted"), ("copy.py", "added")}
    report = idx.repair(dry=True)
    assert (report.orphaned, report.stale) == (["gamma.py"], ["beta.py"])
    done = idx.build()
    assert (done.already_indexed, done.deleted) == (1, 1)
    assert paths(idx) == ["alpha.py", "beta.py", "copy.py", "pkg/__init__.py", "sub/notes.md"]
    status = idx.status()
    assert (status["files"], status["chunks"], status["search_ok"]) == (5, 5, True)
    incremental = contents(idx)
    idx.build(BuildOptions(reset=True))
    assert contents(idx) == incremental


def test_repair_removes(spark, tree):
    idx = index(spark, tree)
    idx.build()
    (tree / "gamma.py").unlink()
    assert idx.repair().chunks_removed == 1
    assert "gamma.py" not in paths(idx)


def test_edit_sequences_equal_a_rebuild(spark, tree):
    rng, idx = random.Random(5), index(spark, tree)
    for _ in range(3):
        for name in rng.sample(["alpha", "beta", "gamma", "new"], 2):
            file = tree / f"{name}.py"
            if file.exists() and rng.random() < 0.4:
                file.unlink()
            else:
                file.write_text(CODE.format(rng.choice(["one", "two", "three"])))
        idx.build()
    incremental = contents(idx)
    idx.build(BuildOptions(reset=True))
    assert contents(idx) == incremental


def test_watch_equals_build(spark, tree):
    idx = index(spark, tree)
    running = idx.watch(once=True)
    running.awaitTermination()
    assert paths(idx) == ["alpha.py", "beta.py", "gamma.py", "pkg/__init__.py", "sub/notes.md"]
    idx.close()


def test_watch_keeps_to_extensions(spark, tree):
    """New files of included extensions are indexed, those of excluded ones never."""
    (tree / "field.dat").write_text("first words of a field\n" * 3)
    idx = index(spark, tree, extensions=Extensions((".dat",), (".md",)))
    idx.watch(once=True).awaitTermination()
    assert paths(idx) == ["alpha.py", "beta.py", "field.dat", "gamma.py", "pkg/__init__.py"]
    idx.close()
    (tree / "later.dat").write_text("words of a later field\n" * 3)
    (tree / "sub" / "later.md").write_text("later\nnotes\n")
    build = idx.build
    idx.build = lambda options=None: build(options) if options is not None else None  # the stream alone has to find them
    idx.watch(once=True).awaitTermination()
    assert paths(idx) == ["alpha.py", "beta.py", "field.dat", "gamma.py", "later.dat", "pkg/__init__.py"]
    idx.close()


def wait_for(what, seconds=300):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "waited in vain"
        time.sleep(0.5)


def test_watch_sees_edits_deletions_and_new_names(spark, tree):
    idx = index(spark, tree)
    running = idx.watch()
    try:
        assert paths(idx) == ["alpha.py", "beta.py", "gamma.py", "pkg/__init__.py", "sub/notes.md"]
        (tree / "alpha.py").write_text(CODE.format("edited"))
        (tree / "beta.py").unlink()
        (tree / "gamma.py").rename(tree / "moved.py")
        (tree / "fresh.py").write_text(CODE.format("fresh"))
        (tree / "sub" / "skip.py").write_text(CODE.format("ignored"))
        wait_for(lambda: running.exception() is not None or paths(idx) == ["alpha.py", "fresh.py", "moved.py", "pkg/__init__.py", "sub/notes.md"])
        assert running.exception() is None
        wait_for(lambda: idx.store.chunks().where("filePath = 'alpha.py' AND content LIKE '%edited%'").count() == 1)
    finally:
        running.stop()
        idx.close()
    incremental = contents(idx)
    idx.build(BuildOptions(reset=True))
    assert contents(idx) == incremental


def test_a_burst_is_built_once(spark, tree):
    """While polls differ nothing is built; when two agree, all of it is."""
    idx = index(spark, tree)
    watcher = Watcher(idx, f"{idx.store.folder.path}/watch")
    assert not watcher.poll() and watcher.poll() and not watcher.poll()
    for k in range(2):
        (tree / f"burst{k}.py").write_text(CODE.format(f"burst{k}"))
        assert not watcher.poll()
    assert watcher.poll() and {"burst0.py", "burst1.py"} <= set(paths(idx)) and not watcher.poll()
    assert Watcher(idx, watcher.files.path).settled == watcher.settled


def test_broken_files_are_read(spark, tree):
    (tree / "latin.py").write_bytes("# caf\xe9\ndef latin(value):\n    total = value + 1\n    return total\n".encode("latin-1"))
    (tree / "two.yaml").write_text("first: one value of many words\n---\nsecond: another value of many words\n")
    (tree / "template.yaml").write_text("{{ if x }}\nname: *missing\n{{ end }}\n")
    (tree / "old.py").write_bytes(b"def old_mac(value):\r    total = value + 1\r    return total + value + value\r")
    (tree / "cut.json").write_text('{"a": [1, 2')
    idx = index(spark, tree)
    assert idx.build().failed == 0
    assert {"latin.py", "two.yaml", "template.yaml", "old.py", "cut.json"} <= set(paths(idx))
    assert "caf\ufffd" in idx.store.chunks().where("filePath = 'latin.py'").first()["context"]
    report = idx.repair(dry=True)
    assert (report.orphaned, report.stale, report.chunk_mismatch) == ([], [], [])


def test_deltas_equal_whole_tables(spark, tree, monkeypatch):
    """Builds add versions; reads, compaction and old pointers agree."""
    monkeypatch.setattr(snapshots, "MOST_DELTAS", 3)
    idx = index(spark, tree)
    for k in range(6):
        (tree / "alpha.py").write_text(CODE.format(f"turn{k}"))
        idx.build()
        assert idx.store.chunks().where("filePath = 'alpha.py'").select("content").collect()[0][0].startswith(f"def turn{k}")
        assert idx.store.chunks().count() == 5 and idx.store.files().count() == 5
    assert len(idx.store._pointer()["chunks"]["deltas"]) < 4
    before = contents(idx)
    assert sorted(r.id for k in range(0, 5, 2) for r in idx.store.page(2, k).collect()) == sorted(r[0] for r in before)
    idx.store.compact()
    assert contents(idx) == before and idx.store._pointer()["chunks"]["deltas"] == []
    pointer = idx.store._pointer()
    idx.store.folder.write("CURRENT", json.dumps({name: state["base"] for name, state in pointer.items()}))
    assert contents(idx) == before


def test_manifests_of_before_branches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "old"))
    store.commit(files=spark.createDataFrame([("a", "h", None), ("b", "h", "main")], "filePath string, fileHash string, branch string"))
    store.migrate("work")
    assert sorted(map(tuple, store.files().select("filePath", "branch").collect())) == [("a", "work"), ("b", "main")]


def test_locks(spark, tree, tmp_path):
    idx = index(spark, tree)
    store = Store(spark, str(tmp_path / "locked"))
    assert store.lock() and store.lock() and store.is_locked()
    store.unlock()
    assert not store.is_locked()
    idx.store.folder.write("writer.lock", json.dumps({"host": "elsewhere", "pid": 1}))
    with pytest.raises(LockedError):
        idx.build()
    assert idx.build(BuildOptions(dry=True)).planned
    idx.store.folder.write("writer.lock", json.dumps({"host": socket.gethostname(), "pid": 2**22 + 5}))
    assert idx.build().succeeded == 5 and not idx.store.is_locked()
    taken = [Store(spark, str(tmp_path / "race")).folder.create("writer.lock", str(k)) for k in range(4)]
    assert taken == [True, False, False, False]


def test_timeouts():
    assert within(5, lambda: 3) == 3
    with pytest.raises(TimeoutError):
        within(0.05, lambda: time.sleep(1))
    with pytest.raises(KeyError):
        within(5, lambda: {}["x"])


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        data = [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(asked["input"])]
        body = json.dumps({"data": data[::-1], "model": asked["model"]}).encode()
        self.send_response(200 if self.path == "/v1/embeddings" else 404)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_embedding_service(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = embedder_for("http:any", base_url=f"http://127.0.0.1:{server.server_port}/v1", document_prefix="d:")
        assert model.embed_query("abc") == [3.0, 1.0] and model.embed(["a", "bcd"]) == [[3.0, 1.0], [5.0, 1.0]]
        rows = embedded(spark.createDataFrame([(k, "x" * k) for k in range(1, 8)], "k int, embedText string"), model).collect()
        assert all(r.vector == [r.k + 2.0, 1.0] for r in rows)
        wrong = embedder_for("http:any", base_url=f"http://127.0.0.1:{server.server_port}/v2")
        assert Resilient(wrong).batch(["a"])[0][0] is None
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        embedder_for("http:any")


def test_tool_server(spark, tree, capsys):
    idx = index(spark, tree)
    idx.build()
    core, specs = ToolCore(idx), [{"name": "search"}]
    ask = lambda method, **more: answered(core, specs, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method} | more))
    assert ask("nonsense")["error"]["code"] == -32601 and ask("ping")["result"] == {}
    assert ask("tools/call", params={"name": "other"})["error"]["code"] == -32602
    assert answered(core, specs, "{")["error"]["code"] == -32700
    assert answered(core, specs, json.dumps({"method": "notifications/initialized"})) is None
    said = ask("tools/call", params={"name": "search", "arguments": {"query": "zebra", "limit": 1}})["result"]
    assert not said["isError"] and "sub/notes.md" in said["content"][0]["text"]
    core.start()
    core.dispose()
    assert not core._thread.is_alive()
    assert "search) compadd" in completions()


def test_exchange(spark, tree, tmp_path):
    idx = index(spark, tree)
    idx.build()
    code = secrets.share_code()
    assert export(idx.store, str(tmp_path / "out"), code)["chunks"] == 5
    other = Store(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        import_(spark, str(tmp_path / "out"), other)
    assert import_(spark, str(tmp_path / "out"), other, code)["chunks"] == 5
    assert import_(spark, str(tmp_path / "out"), other, code)["chunks"] == 0
    assert other.chunks().count() == 5
    wrong = Store(spark, str(tmp_path / "wrong"))
    wrong.write_metadata("/", "b", "hash:8", 8)
    with pytest.raises(IncompatibleError):
        import_(spark, str(tmp_path / "out"), wrong, code)
    other.compact()
    assert other.chunks().count() == 5
    said = []
    foreign = Store(spark, str(tmp_path / "foreign"))
    foreign.write_metadata("/", "b", "other:model", 32)
    import_(spark, str(tmp_path / "out"), foreign, code, log=said.append)
    assert len(said) == 1 and "other:model" in said[0]


def test_tools_and_dimensions(spark, tree):
    idx = index(spark, tree)
    idx.build()
    core = ToolCore(idx)
    assert core.check() == "ok"
    text, bad = core.search("zebra", limit=1)
    assert not bad and text.startswith("sub/notes.md:1-3 [block] lines_1_3 (score: ")
    idx.embedder = HashEmbedder(8)
    with pytest.raises(DimensionError):
        idx.search("x")
    assert core.search("x")[1]
    core.dispose()


class Failing:
    def __init__(self, bad):
        self.bad, self.reloaded = bad, 0

    def embed(self, texts):
        if any(self.bad(t) for t in texts):
            raise RuntimeError("no")
        return [[1.0, 2.0]] * len(texts)

    def reload(self):
        self.reloaded += 1
        return self.reloaded < 2


def test_failures_cost_rows_not_batches():
    assert [v for v, _ in Resilient(Failing(lambda t: t == "x")).batch(["a", "x", "b"])] == [[1.0, 2.0], None, [1.0, 2.0]]
    driver = Resilient(Failing(lambda t: True))
    for _ in range(6):
        driver.batch(["a"])
    assert driver.aborted and driver.reloads == 1 and driver.batch(["a"]) == [(None, "aborted")]
    assert Resilient(Failing(lambda t: False), dimensions=3).batch(["a"])[0][0] is None


def test_embedded_keeps_every_row(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(250)], "k int, embedText string")
    got = embedded(df, HashEmbedder(16))
    assert got.count() == 250 and got.where(F.size("vector") == 16).count() == 250


def test_config():
    got = parse("model: a:b\nbatchSize: 7\nextensions: {include: [.x]}\n")
    assert (got.batch_size, got.extensions.include) == (7, [".x"])
    for bad in ("model: ab", "model: a:b\nbatchSize: 0", "batchSize: 1"):
        with pytest.raises(ValueError):
            parse(bad)
