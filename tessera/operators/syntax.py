"""Parsers that find definitions, and the choice of chunks among them.

A parser returns spans: what kind of node, its name, where it starts and ends,
whether it makes a chunk, and whether it is a scope for what lies in it. The
outermost chunk wins. One above the size limit gives way to the chunks inside it, if any.
Coverage: Python (``ast``), HTML and Vue, JSON, YAML, TOML, CSS, brace languages by
their declarations, Ruby and Lua by declarations that end at an ``end`` of the same
indent; all else, files without a definition and files that a parser fails on get windows.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

from ..functions.text import DEFINITIONS, LANGUAGES, MAX_TOKENS, ORCHESTRATION, SCOPE_KINDS

SMALLEST_CHARS, COMMENT_LINES = 50, 10
#: How a line that belongs to a leading comment starts: fixed values.
COMMENT_STARTS = ("//", "#", "*", "/*", "*/", "///", "--", "@", '"""', "'''")


@dataclass(frozen=True)
class Span:
    kind: str
    name: str | None
    start: int
    end: int
    chunk: bool = True
    scope: bool = False


Parser = Callable[[str], list[Span]]


def utf16(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


class Lines:
    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def line(self, row: int) -> str:
        end = self.starts[row + 1] - 1 if row + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[row] : end]

    def comment_above(self, row: int) -> str:
        """Comment and decorator lines just above; blank lines count only below them."""
        found: list[str] = []
        for k in range(row - 1, max(-1, row - 1 - COMMENT_LINES), -1):
            line = self.line(k)
            if line.strip().startswith(COMMENT_STARTS):
                found.append(line)
            elif line.strip() or found:
                break
        return "\n".join(reversed(found)).strip()


def chosen(spans: list[Span], text: str) -> list[tuple[Span, list[Span]]]:
    """(chunk, its scopes, outermost first)."""
    spans = sorted(spans, key=lambda s: (s.start, -s.end))
    out, open_, blocked = [], [], -1
    for k, span in enumerate(spans):
        while open_ and open_[-1].end <= span.start:
            open_.pop()
        if span.chunk and span.start >= blocked:
            body = text[span.start : span.end]
            splits = -(-utf16(body) // 4) > MAX_TOKENS and any(s.chunk and s.end <= span.end for s in spans[k + 1 :] if s.start < span.end)
            if not splits:
                blocked = span.end
                if "\n" in body or utf16(body) >= SMALLEST_CHARS:
                    out.append((span, [s for s in open_ if s.scope and s.name]))
        open_.append(span)
    return out


def row_of(path: str, row: int, end_row: int, kind: str, name: str, content: str, context: str) -> tuple:
    hash_ = hashlib.sha256(content.encode("utf-8", "replace")).hexdigest()[:16]
    return f"{path}:{row}:{hash_}", path, row + 1, end_row + 1, kind, name, content, context, hash_


def windows(path: str, text: str, size: int = 50, stride: int = 25) -> list[tuple]:
    lines = text.split("\n")
    cuts = ((k, lines[k : k + size]) for k in range(0, len(lines), stride))
    return [row_of(path, k, k + len(part) - 1, "block", f"lines_{k + 1}_{k + len(part)}", "\n".join(part), f"[file: {path}]") for k, part in cuts if "".join(part).strip()]


def chunk_file(path: str, text: str, parsers: dict[str, Parser]) -> list[tuple]:
    dot = re.search(r"\.[^./]*$", path)
    parser = next((parsers[name] for name in parsers if dot and dot[0] in extensions_of(name)), None)
    try:
        spans = parser(text) if parser else []
    except Exception:  # noqa: BLE001  parsers of foreign files fail in many ways; the file still gets windows
        spans = []
    lines, rows = Lines(text), []
    for span, scopes in chosen(spans, text):
        row = lines.row(span.start)
        role = "definition" if span.kind in DEFINITIONS else "orchestration" if span.kind in ORCHESTRATION else "implementation"
        scope, doc = " > ".join(f"{SCOPE_KINDS.get(s.kind, s.kind)} {s.name}" for s in scopes), lines.comment_above(row)
        context = "\n".join([f"[file: {path}]", f"[role: {role}]", *([f"[scope: {scope}]"] if scope else []), *([f"[doc: {doc}]"] if doc else [])])
        rows.append(row_of(path, row, lines.row(max(span.start, span.end - 1)), span.kind, span.name or f"anonymous_{row}", text[span.start : span.end], context))
    return rows or windows(path, text)


def python(text: str) -> list[Span]:
    tree, out = ast.parse(text), []
    breaks = [m.span() for m in re.finditer("\r\n|\r|\n", text)]  # as the parser counts lines
    starts = [0, *(b for _, b in breaks)]
    lines = [text[a:b] for a, b in zip(starts, [*(a for a, _ in breaks), len(text)], strict=True)]

    def place(line: int, byte: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:byte].decode("utf-8", "replace"))

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            start, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            if node.decorator_list:
                first = node.decorator_list[0]
                at = text.rindex("@", 0, place(first.lineno, first.col_offset) + 1)
                out.append(Span("decorated_definition", node.name, at, end))
            out.append(Span(kind, node.name, start, end, True, kind == "class_definition"))
    return out


class _Tags(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.starts, self.stack, self.out = text, Lines(text).starts, [], []
        self.feed(text)
        self.close()

    def at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def add(self, tag: str, start: int, end: int) -> None:
        kind = {"script": "script_element", "style": "style_element"}.get(tag, "element")
        self.out.append(Span(kind, None, start, end, True, kind == "element"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            self.add(tag, self.at(), self.at() + len(self.get_starttag_text()))
        else:
            self.stack.append((tag, self.at()))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.add(tag, self.at(), self.at() + len(self.get_starttag_text()))

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _ in self.stack):
            while self.stack:
                name, start = self.stack.pop()
                if name == tag:
                    self.add(tag, start, self.text.index(">", self.at()) + 1)
                    break


def html(text: str) -> list[Span]:
    return _Tags(text).out


def vue(text: str) -> list[Span]:
    names = {"template": "template_element", "script": "script_element", "style": "style_element"}
    return [Span(names[m[1]], m[1], m.start(), m.end()) for m in re.finditer(r"(?ms)^<(template|script|style)\b.*?^</\1>", text)]


def json_pairs(text: str) -> list[Span]:
    """Pairs at every depth; a pair is the scope of those in it."""
    json.loads(text)
    out, open_, closing = [], [], {}
    tokens = list(_JSON_TOKENS.finditer(text))
    for m in tokens:
        if m[0] in "{[":
            open_.append(m.start())
        elif m[0] in "}]":
            closing[open_.pop()] = m.end()
    for key, value in zip(tokens, tokens[1:], strict=False):
        if key["colon"]:
            out.append(Span("pair", json.loads(key["string"]), key.start(), closing.get(value.start(), value.end("string") if value["string"] else value.end())))
    return out


def yaml_pairs(text: str) -> list[Span]:
    import yaml

    out, todo, seen = [], [node for node in yaml.compose_all(text) if node], set()
    while todo:
        node = todo.pop()
        if id(node) in seen:  # an alias
            continue
        seen.add(id(node))
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                end = max(k.end_mark.index, v.end_mark.index)
                out.append(Span("block_mapping_pair", str(k.value), k.start_mark.index, len(text[:end].rstrip()) or end))
                todo.append(v)
        elif isinstance(node, yaml.SequenceNode):
            todo += node.value
    return out


def toml_tables(text: str) -> list[Span]:
    import tomllib

    tomllib.loads(text)
    heads = [(m.start(), m[1].strip()) for m in re.finditer(r"(?m)^\[+([^\]\n]+)\]+", text)]
    first = heads[0][0] if heads else len(text)
    pairs = [Span("pair", m[1], m.start(), m.end()) for m in re.finditer(r"(?m)^([A-Za-z0-9_.\"'-]+)\s*=.*$", text[:first])]
    return pairs + [Span("table", name, at, len(text[: [*heads, (len(text), "")][k + 1][0]].rstrip())) for k, (at, name) in enumerate(heads)]


_JSON_TOKENS = re.compile(r"""(?P<string>"(?:[^"\\]|\\.)*")(?P<colon>\s*:)?|[{}\[\]]|[^\s,:{}\[\]"]+""")

_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""", re.S)


#: Words that stand before a bracket and a brace without naming anything: fixed values.
_NO_NAMES = frozenset(("if", "for", "while", "switch", "catch", "return", "else", "do", "try", "using", "lock", "function", "synchronized", "new", "throw", "when", "foreach"))


def ends(rules: list[tuple[str, str, bool]]) -> Parser:
    """For languages whose blocks close with ``end`` at the indent of their head. rules: (pattern of a head with its indent in group 1 and its name in group 2, kind, is it a scope)."""
    compiled = [(re.compile(p, re.M), kind, scope) for p, kind, scope in rules]

    def parse(text: str) -> list[Span]:
        closing: dict[str, list[tuple[int, int]]] = {}
        for m in re.finditer(r"(?m)^([ \t]*)end\b[^\n]*", text):
            closing.setdefault(m[1], []).append((m.start(), m.start() + len(m[1]) + 3))
        out = []
        for pattern, kind, scope in compiled:
            for m in pattern.finditer(text):
                line = text.find("\n", m.end())
                line = len(text) if line < 0 else line
                own = closing.get(m[1], [])
                k = bisect_right(own, (m.end(), 0))
                end = line if re.search(r"\bend\s*$", text[m.end() : line]) else own[k][1] if k < len(own) else len(text.rstrip())
                out.append(Span(kind, m[2], m.end(1), end, True, scope))
        return out

    return parse


def go(text: str) -> list[Span]:
    """Declarations of braces, and constants and variables, alone or in brackets."""
    plain, out = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text), list(_GO(text))
    for m in re.finditer(r"(?m)^(const|var)\b[ \t]*(\()?[ \t]*([A-Za-z_]\w*)?", plain):
        stop = re.compile(r"^\)", re.M).search(plain, m.end()) if m[2] else re.compile(r"\n(?![ \t}])|\Z").search(plain, m.end())
        out.append(Span(f"{m[1]}_declaration", m[3], m.start(), len(text.rstrip()) if stop is None else stop.end() if m[2] else stop.start()))
    return out


def braces(rules: list[tuple[str, str, bool]]) -> Parser:
    """rules: (pattern of a declaration's head with its name in group 1, kind, is it a scope). A declaration ends with its closing brace, or else its semicolon or line."""
    compiled = [(re.compile(p, re.M), kind, scope) for p, kind, scope in rules]

    def parse(text: str) -> list[Span]:
        plain = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        closing, stack = {}, []
        for m in re.finditer(r"[{}]", plain):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                closing[stack.pop()] = m.end()
        out = []
        for pattern, kind, scope in compiled:
            for m in pattern.finditer(plain):
                if m.lastindex and m[1] in _NO_NAMES:
                    continue
                start = m.start("at") if "at" in pattern.groupindex else m.start() + len(m[0]) - len(m[0].lstrip())
                stop = re.compile(r"[{;]|\n\s*\n").search(plain, m.end())
                end = closing.get(stop.start(), len(text)) if stop and stop[0] == "{" else stop.start() + (stop[0] == ";") if stop else len(text.rstrip())
                out.append(Span(kind, m[1] if m.lastindex else None, start, end, True, scope))
        return out

    return parse


_ID = r"([A-Za-z_$][\w$]*)"
_MODIFIERS = r"^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|partial|virtual|readonly|data|inline|export|default)[ \t]+)*"
_JS = [(r"^[ \t]*export\b[^\n{;]*?(?:function\*?|class|const|let|var|interface|type|enum)[ \t]+" + _ID, "export_statement", False), (r"^[ \t]*(?:async[ \t]+)?function\*?[ \t]+" + _ID, "function_declaration", False), (r"^[ \t]*(?:abstract[ \t]+)?class[ \t]+" + _ID, "class_declaration", True)]
_METHOD = r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)[ \t]+)*[*#]?" + _ID + r"[ \t]*(?:<[^>\n]*>)?\([^;{}]*\)[^;{}()\n=]*(?=\{)"
_JS += [(_METHOD, "method_definition", False), (r"^[ \t]*(?:const|let|var)[ \t]+(?P<at>" + _ID[1:] + r"[^\n=;]*=[^\n;{]*", "variable_declarator", False), (r"=[ \t]*(?P<at>)(?:async[ \t]*)?(?:\([^()\n]*\)|[A-Za-z_$][\w$]*)[^\n=;{]*=>", "arrow_function", False)]
_TS = [*_JS, (r"^[ \t]*interface[ \t]+" + _ID, "interface_declaration", True), (r"^[ \t]*type[ \t]+" + _ID + r"[^\n=]*=", "type_alias_declaration", False), (r"^[ \t]*(?:const[ \t]+)?enum[ \t]+" + _ID, "enum_declaration", False)]


def _methods(kind: str = "method_declaration") -> list[tuple[str, str, bool]]:
    """Methods with a type before their name, and constructors."""
    return [
        (r"^[ \t]+(?:@\w+[ \t]+)?(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|async|virtual|synchronized|native|default)[ \t]+)*(?:<[^>\n]*>[ \t]*)?(?!(?:return|new|else|throw|public|private|protected|internal|static)\b)[A-Za-z_][\w.<>\[\],?]*[ \t]+" + _ID + r"[ \t]*(?:<[^>\n]*>)?\([^;{}]*\)[^;{}()=]*(?=\{)", kind, False),
        (r"^[ \t]+(?:(?:public|private|protected|internal|static)[ \t]+)+" + _ID + r"[ \t]*\([^;{}]*\)[^;{}=]*(?=\{)", "constructor_declaration", False),
    ]


def _typed(kinds: dict[str, str], scopes: tuple[str, ...]) -> list[tuple[str, str, bool]]:
    return [(_MODIFIERS + word + r"[ \t]+" + _ID, kind, kind in scopes) for word, kind in kinds.items()]


_GO = braces([(r"^func[ \t]+" + _ID, "function_declaration", False), (r"^func[ \t]*\([^)\n]*\)[ \t]*" + _ID, "method_declaration", False), (r"^type[ \t]+" + _ID, "type_declaration", True)])

PARSERS: dict[str, Parser] = {
    "python": python,
    "html": html,
    "vue": vue,
    "json": json_pairs,
    "yaml": yaml_pairs,
    "toml": toml_tables,
    "javascript": braces(_JS),
    "typescript": braces(_TS),
    "tsx": braces(_TS),
    "rust": braces([(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*" + word + r"[ \t]+" + _ID, kind, kind in ("impl_item", "trait_item")) for word, kind in {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "type": "type_item", "static": "static_item"}.items()] + [(r"^[ \t]*impl(?:<[^>{]*>)?[ \t]+(?:[\w:<>, ]+[ \t]+for[ \t]+)?" + _ID, "impl_item", True), (r"^[ \t]*macro_rules![ \t]*" + _ID, "macro_definition", False)]),
    "ruby": ends([(r"^([ \t]*)class[ \t]+([A-Z][\w:]*)", "class", True), (r"^([ \t]*)module[ \t]+([A-Z][\w:]*)", "module", True), (r"^([ \t]*)def[ \t]+(?!self\.)([^\s(;]+)", "method", False), (r"^([ \t]*)def[ \t]+self\.([^\s(;]+)", "singleton_method", False)]),
    "lua": ends([(r"^([ \t]*)function[ \t]+([\w.:]+)", "function_declaration", False), (r"^([ \t]*)local[ \t]+function[ \t]+(\w+)", "local_function", False), (r"^([ \t]*)(?:local[ \t]+)?([\w.]+)[ \t]*=[ \t]*function\b", "function_definition", False)]),
    "zig": braces([(r"^[ \t]*(?:pub[ \t]+)?(?:export[ \t]+|inline[ \t]+|extern[ \t]+)?fn[ \t]+" + _ID, "FnProto", False), (r"^[ \t]*(?:pub[ \t]+)?const[ \t]+" + _ID + r"[^\n=;]*=[ \t]*(?:packed[ \t]+|extern[ \t]+)?(?:struct|enum|union|opaque)\b", "ContainerDecl", True), (r"^(?:pub[ \t]+)?(?:const|var)[ \t]+" + _ID + r"(?![^\n;]*\b(?:struct|enum|union|opaque)\b)", "VarDecl", False), (r"^test\b", "TestDecl", False)]),
    "go": go,
    "java": braces(_typed({"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}, ("class_declaration", "interface_declaration")) + _methods()),
    "c_sharp": braces(_typed({"class": "class_declaration", "interface": "interface_declaration", "struct": "struct_declaration", "enum": "enum_declaration", "record": "record_declaration"}, ("class_declaration", "interface_declaration", "struct_declaration")) + _methods()),
    "kotlin": braces(_typed({"class": "class_declaration", "object": "object_declaration", "fun": "function_declaration"}, ("class_declaration", "object_declaration"))),
    "swift": braces(_typed({"class": "class_declaration", "struct": "struct_declaration", "enum": "enum_declaration", "protocol": "protocol_declaration", "func": "function_declaration", "extension": "extension_declaration"}, ("class_declaration", "struct_declaration", "extension_declaration"))),
    "scala": braces(_typed({"class": "class_definition", "object": "object_definition", "trait": "trait_definition", "def": "function_definition"}, ("class_definition", "object_definition", "trait_definition"))),
    "php": braces(_typed({"class": "class_declaration", "interface": "interface_declaration", "trait": "trait_declaration", "enum": "enum_declaration", "function": "function_definition"}, ("class_declaration", "interface_declaration", "trait_declaration"))),
    "c": braces([(r"^[A-Za-z_][\w \t*]*?[ \t*]" + _ID + r"\([^;{}]*\)(?=\s*\{)", "function_definition", False), (r"^(?:typedef[ \t]+)?struct[ \t]+" + _ID + r"(?=\s*\{)", "struct_specifier", True), (r"^enum[ \t]+" + _ID + r"(?=\s*\{)", "enum_specifier", False)]),
    "cpp": braces([(r"^[A-Za-z_][\w \t*&:<>,]*?[ \t*&]([\w:~]+)\([^;{}]*\)[ \t\w]*(?=\s*\{)", "function_definition", False), (r"^[ \t]*class[ \t]+" + _ID + r"[^;{]*(?=\{)", "class_specifier", True), (r"^[ \t]*struct[ \t]+" + _ID + r"[^;{]*(?=\{)", "struct_specifier", True), (r"^[ \t]*namespace[ \t]+" + _ID + r"(?=\s*\{)", "namespace_definition", True)]),
    "css": braces([(r"^[ \t]*(@media[^{;\n]*)(?=\{)", "media_statement", False), (r"^[ \t]*(@keyframes[^{;\n]*)(?=\{)", "keyframes_statement", False), (r"^([^@\s{}][^{};]*?)\s*(?=\{)", "rule_set", False)]),
    "bash": braces([(r"^[ \t]*(?:function[ \t]+)?([A-Za-z_]\w*)[ \t]*\(\)", "function_definition", False)]),
}


def extensions_of(language: str) -> list[str]:
    return LANGUAGES.get(language, [])
