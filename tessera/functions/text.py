"""Scalar functions as columns: they stay inside the JVM and, but for the higher-order ones, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and classes of syntax nodes, as their grammars and the result format have them.
SCOPE_KINDS = {
    "class_declaration": "class",
    "class_body": "class",
    "interface_declaration": "interface",
    "module": "module",
    "namespace_declaration": "namespace",
    "class_definition": "class",
    "impl_item": "impl",
    "trait_item": "trait",
    "mod_item": "mod",
    "type_declaration": "type",
    "class": "class",
    "struct_specifier": "struct",
    "class_specifier": "class",
    "namespace_definition": "namespace",
    "struct_declaration": "struct",
    "extension_declaration": "extension",
    "object_definition": "object",
    "trait_definition": "trait",
    "ContainerDecl": "container",
}
DEFINITIONS = [
    "class_declaration",
    "class_definition",
    "interface_declaration",
    "type_alias_declaration",
    "enum_declaration",
    "struct_item",
    "enum_item",
    "trait_item",
    "type_item",
    "type_declaration",
    "struct_specifier",
    "class_specifier",
    "enum_specifier",
    "type_definition",
    "struct_declaration",
    "protocol_declaration",
    "trait_definition",
    "ContainerDecl",
]
ORCHESTRATION = ["export_statement", "decorated_definition"]
#: Extensions of each language that has a grammar.
LANGUAGES = {
    "javascript": [".js", ".jsx"],
    "typescript": [".ts"],
    "tsx": [".tsx"],
    "python": [".py"],
    "rust": [".rs"],
    "go": [".go"],
    "ruby": [".rb"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc"],
    "swift": [".swift"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "toml": [".toml"],
    "lua": [".lua"],
    "scala": [".scala"],
    "zig": [".zig"],
    "bash": [".sh", ".bash"],
    "html": [".html"],
    "css": [".css", ".scss"],
    "java": [".java"],
    "kotlin": [".kt"],
    "php": [".php"],
    "c_sharp": [".cs"],
    "vue": [".vue"],
}
MAX_TOKENS = 8192


def utf8(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def short_hash(content: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def token_estimate(text: Column, exact: bool = False) -> Column:
    """A quarter of the length, rounded up; exact: of the length in UTF-16 units."""
    return F.ceil((utf16_length(text) if exact else F.length(text)) / F.lit(4)).cast("long")


def extension(path: Column) -> Column:
    """From the last dot of the file name on, in names that don't start with it; else empty."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def after_last_dot(path: Column) -> Column:
    """From the last dot of the path on; without a dot, the last character."""
    return F.when(path.contains("."), F.regexp_extract(path, r"(\.[^.]*)$", 1)).otherwise(F.right(path, F.lit(1)))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, exts in LANGUAGES.items() for e in exts for x in (e, name)))
    return F.try_element_at(known, after_last_dot(path))


def role(node_type: Column) -> Column:
    return F.when(node_type.isin(DEFINITIONS), "definition").when(node_type.isin(ORCHESTRATION), "orchestration").otherwise("implementation")


def scope_kind(node_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in SCOPE_KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, node_type), node_type)


def context_header(path: Column, role_: Column, scope: Column, doc: Column) -> Column:
    """The header lines of a chunk; scope (``a > b``) and doc are left out where null or empty."""
    line = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"[{name}: "), c, F.lit("]")))
    return F.concat_ws("\n", line("file", path), line("role", role_), line("scope", scope), line("doc", doc))


def node_name(name: Column, row: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("anonymous_"), row.cast("string")))


def chunk_id(path: Column, row: Column, hash_: Column) -> Column:
    """path:row:hash with the row counted from 0."""
    return F.concat_ws(":", path, row.cast("string"), hash_)


def embed_text(context: Column, content: Column, prefix: str | None = None) -> Column:
    return F.concat(F.lit(prefix or ""), context, F.lit("\n"), content)


def slug_base(project: Column) -> Column:
    """A readable name from the last two parts of a remote URL or path."""
    bare = F.regexp_replace(project, r"\.git$", "")
    scp = F.regexp_extract(bare, r"^[^@]+@[^:]+:(.+)$", 1)
    path = F.when(scp != "", scp).otherwise(F.regexp_replace(bare, r"^[a-z]+://[^/]+/", ""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.regexp_replace(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "-"), r"[^A-Za-z0-9_-]", "_")


def slug(project: Column, digits: int = 8) -> Column:
    return F.concat(slug_base(project), F.lit("-"), F.substring(F.sha2(project, 256), 1, digits))


def model_family(model: Column) -> Column:
    """Without the provider, and without a last tag that names a quantisation."""
    bare = F.when(model.contains(":"), F.regexp_replace(model, r"^[^:]*:", "")).otherwise(model)
    return F.when(model.contains(":"), F.regexp_replace(bare, r"(?i):(Q\d|fp\d|f\d|latest|gguf|ggml)[^:]*$", "")).otherwise(bare)


def duration_ms(text: Column) -> Column:
    """Milliseconds of ``10m``-like durations; an error for others."""
    number = F.regexp_extract(text, r"^(\d+)\s*(s|m|h|d)$", 1)
    unit = F.regexp_extract(text, r"^(\d+)\s*(s|m|h|d)$", 2)
    scale = F.when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return F.when(number == "", F.raise_error(F.concat(F.lit("Invalid duration: "), text))).otherwise(number.cast("long") * scale.cast("long"))


def below(root: str, prefix: str | None) -> str:
    """A prefix inside a project, moved below the folder that a search starts from."""
    return "/".join(x for x in (root, prefix) if x)


def is_local_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin("localhost", "127.0.0.1", "0.0.0.0", "[::1]"), F.lit(False))


def process_kind(name: Column, command: Column, tool_name: str = "tessera-mcp") -> Column:
    return F.when((name == tool_name) | command.contains("mcp"), "mcp").when(command.contains("serve"), "serve").otherwise("cli")


def comma_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def location(path: Column, start: Column, end: Column, kind: Column, name: Column) -> Column:
    return F.format_string("%s:%d-%d [%s] %s", path, start, end, kind, name)


def fixed_score(score: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", score)


def negated(query: Column, negative: Column) -> Column:
    """The query moved half of the negative vector away from it; not normalised again."""
    return F.zip_with(query, negative, lambda q, n: q.cast("double") - n.cast("double") * 0.5)


def distance(x: Column, y: Column, metric: str = "l2") -> Column:
    """Squared Euclidean, cosine or negative dot distance, in double precision; the cosine of a zero vector is null."""
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "l2":
        gap = F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
        return F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v)
    if metric == "dot":
        return -product(x, y)
    if metric == "cosine":
        return F.lit(1.0) - F.try_divide(product(x, y), F.sqrt(product(x, x) * product(y, y)))
    raise ValueError(f"unknown metric {metric!r}")


def score(distance_: Column) -> Column:
    return F.coalesce(F.lit(1.0) - distance_, F.lit(0.0))
