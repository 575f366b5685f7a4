"""python -m tessera.cli COMMAND: index, search, status, repair, serve, mcp, export, import, migrate, compact, prune, config, init."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import exchange, project
from .config import TEMPLATE, load, places
from .functions import secrets
from .index import create_index
from .operators import changes, stats
from .sources.snapshots import Folder, Store, Writing, indexes, running
from .tools import ToolCore, as_json, rendered
from .types import BuildOptions, SearchOptions


def words(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name: sub.add_parser(name)
    p = add("index")
    for flag in ("--reset", "--force", "--dry", "--verbose"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--since")
    p.add_argument("files", nargs="*")
    p = add("search")
    p.add_argument("--mode", choices=("vector", "text", "hybrid"), default="vector")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=25)
    p.add_argument("--min-score", type=float)
    for name in ("--file-prefix", "--not", "--type", "--language", "--project", "--across"):
        p.add_argument(name)
    for flag in ("--json", "--compact", "--scores"):
        p.add_argument(flag, action="store_true")
    p = add("status")
    p.add_argument("--changes", action="store_true")
    p.add_argument("--processes", action="store_true")
    p.add_argument("--json", action="store_true")
    add("repair").add_argument("--dry", action="store_true")
    for name in ("serve", "mcp", "compact", "config", "init"):
        add(name)
    add("completions").add_argument("shell", choices=["zsh"])
    add("migrate").add_argument("--dry", action="store_true")
    add("prune").add_argument("--force", action="store_true")
    p = add("export")
    p.add_argument("to")
    p.add_argument("--sealed", action="store_true")
    p = add("import")
    p.add_argument("source")
    p.add_argument("--code")
    p.add_argument("--reset", action="store_true")
    return top


def completions() -> str:
    """A zsh function that completes commands and their options, from the parser itself."""
    commands = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    options = {name: [x for a in p._actions for x in a.option_strings if x.startswith("--")] for name, p in commands.items()}
    cases = "\n".join(f"    {name}) compadd -- {' '.join(flags)} ;;" for name, flags in options.items())
    return f"#compdef tessera\n_tessera() {{\n  if (( CURRENT == 2 )); then compadd -- {' '.join(commands)}; return; fi\n  case $words[2] in\n{cases}\n  esac\n}}\n_tessera \"$@\""


def moves(spark: SparkSession) -> "object":
    """(source, target, outcome) of index folders whose name isn't that of their project."""
    rows = [(path.rsplit("/", 1)[-1], project.index_path(meta["root"]).rsplit("/", 1)[-1]) for path, meta in indexes(spark, project.state_folder())]
    wanted = spark.createDataFrame(rows, "source string, target string")
    return changes.move_targets(wanted.where("source <> target"), wanted.select(F.col("source").alias("target")))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o, cwd = parser().parse_args(args), os.getcwd()
    if o.command == "completions":
        print(completions())
        return 0
    if o.command == "init":
        target = places(cwd)[0]
        if target.exists():
            print(f"{target} exists")
            return 1
        target.write_text(TEMPLATE)
        print(f"wrote {target}")
        return 0
    if o.command == "config":
        print(json.dumps(load(cwd).__dict__, default=lambda x: x.__dict__, indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "migrate":
        state = Folder(spark, project.state_folder())
        for source, target, outcome in moves(spark).orderBy("source").collect():  # one row an index
            print(f"{source} -> {target}: {outcome}")
            if outcome == "move" and not o.dry:
                state.move(source, target)
        return 0
    index = create_index(spark, cwd)
    if o.command == "index":
        done = index.build(BuildOptions(o.reset, o.since, o.force, o.dry, o.files or None))
        print("\n".join(done.planned) if o.dry else f"{done.succeeded} chunks indexed, {done.failed} failed, {done.already_indexed} files known, {done.oversize} chunks too large, {done.deleted} files deleted")
    elif o.command == "search":
        found = index.search(o.query, SearchOptions(o.limit, o.file_prefix, getattr(o, "not"), o.min_score, words(o.type), words(o.language), o.project, words(o.across), mode=o.mode))
        if o.json:
            print("[" + ",\n".join(as_json(found)) + "]")
        elif o.compact:
            ranked = found.withColumn("rank", F.monotonically_increasing_id())  # one partition after the sort of at most the limit of rows
            print("\n".join(r[0] for r in stats.first_seen_files(ranked).orderBy("rank").collect()))
        else:
            rule = "\n" + "─" * 60 + "\n"
            print(rule.join(r[0] for r in rendered(found).collect()) or "No results found.")
    elif o.command == "status":
        status = index.status()
        if o.changes:
            status["changes"] = [r.asDict() for r in stats.change_summary(index.changes()).collect()]
        if o.processes:
            status["processes"] = [r.asDict() for r in running(spark, project.state_folder()).orderBy("pid").collect()]  # one row a live writer
        print(json.dumps(status, indent=2) if o.json else "\n".join(f"{k}: {v}" for k, v in status.items()))
    elif o.command == "repair":
        print(json.dumps(index.repair(o.dry).__dict__, indent=2))
    elif o.command == "compact":
        with Writing(index.store):
            index.store.compact()
    elif o.command == "prune":
        if not o.force and input(f"delete {index.store.folder.path}? [y/N] ").strip().lower() != "y":
            return 1
        index.store.folder.delete()
    elif o.command == "export":
        code = secrets.share_code() if o.sealed else None
        print(json.dumps(exchange.export(index.store, o.to, code) | ({"code": code} if code else {})))
    elif o.command == "import":
        print(json.dumps(exchange.import_(spark, o.source, Store(spark, project.index_path(cwd)), o.code, o.reset, index.project.branch)))
    elif o.command == "serve":
        index.watch().awaitTermination()
    elif o.command == "mcp":
        serve_tools(ToolCore(index))
    index.close()
    return 0


def serve_tools(core: ToolCore) -> None:
    """JSON-RPC lines on standard input and output: tools/list and tools/call."""
    text = {"type": "string"}
    specs = [
        {"name": "search", "description": core.description(), "inputSchema": {"type": "object", "properties": {"query": text, "limit": {"type": "integer"}, "filePrefix": text, "type": {"type": "array", "items": text}, "language": {"type": "array", "items": text}, "project": text}, "required": ["query"]}},
        {"name": "list_other_indexed_projects", "description": "Lists the other projects that have an index.", "inputSchema": {"type": "object", "properties": {}}},
    ]
    core.start()
    try:
        for line in sys.stdin:
            if line.strip() and (answer := answered(core, specs, line)) is not None:
                print(json.dumps(answer), flush=True)
    finally:
        core.dispose()


def answered(core: ToolCore, specs: list[dict], line: str) -> dict | None:
    """The answer to one request; None to a notification."""
    try:
        ask = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    method, params, result, error = ask.get("method"), ask.get("params") or {}, {}, None
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": [s | ({"description": core.description()} if s["name"] == "search" else {}) for s in specs]}
    elif method == "tools/call" and params.get("name") == "search":
        a = params.get("arguments") or {}
        if "query" not in a:
            error = {"code": -32602, "message": "search needs a query"}
        else:
            said, bad = core.search(a["query"], a.get("limit", 10), a.get("filePrefix"), a.get("type"), a.get("language"), a.get("project"))
            result = {"content": [{"type": "text", "text": said}], "isError": bad}
    elif method == "tools/call" and params.get("name") == "list_other_indexed_projects":
        result = {"content": [{"type": "text", "text": core.projects()}]}
    elif method == "tools/call":
        error = {"code": -32602, "message": f"unknown tool {params.get('name')}"}
    elif method != "ping":
        error = {"code": -32601, "message": f"unknown method {method}"}
    if "id" not in ask:
        return None
    return {"jsonrpc": "2.0", "id": ask["id"]} | ({"error": error} if error else {"result": result})


if __name__ == "__main__":
    sys.exit(main())
