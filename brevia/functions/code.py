"""Metadata of source files as columns (SRC3, E14, E15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevia.functions.patterns import Pattern

#: File endings and their languages, as the parser and as the extractor know them.
PARSER_LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".yaml": "yaml", ".yml": "yaml",
    ".json": "json", ".md": "markdown", ".txt": "text", ".toml": "toml", ".ini": "ini", ".cfg": "config",
}
EXTRACTOR_LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".md": "markdown",
    ".txt": "text", ".sh": "shell", ".sql": "sql",
}


def language_of(path: Column, known: dict[str, str] = PARSER_LANGUAGES, default: str = "text") -> Column:
    """SRC3: a path's language by its ending."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ending = F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))
    return F.coalesce(F.element_at(table, ending), F.lit(default))


#: Declarations by language.
DECLARATIONS = {
    "functions": {
        "python": (Pattern(r"(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", ""),),
        "typescript": (
            Pattern(r"(?:async\s+)?function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", ""),
            Pattern(r"(?:const|let|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:\([^)]*\)\s*?=>|[a-zA-Z_][a-zA-Z0-9_]*\s*?=>)", ""),
        ),
        "go": (Pattern(r"func\s+(?:\([^)]*\)\s*)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", ""),),
    },
    "classes": {
        "python": (Pattern(r"class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:\(|:)", ""),),
        "typescript": (Pattern(r"class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:\{|extends)", ""),),
        "go": (Pattern(r"type\s+([A-Z][a-zA-Z0-9_]*)\s+struct", ""),),
    },
    "imports": {
        "typescript": (Pattern(r"^import\s+(?:\{[^}]*\}|\*\s+as\s+[a-zA-Z_][a-zA-Z0-9_]*|[a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+['\"]([^'\"]+)['\"]", "m"),),
        "go": (Pattern(r"^(?:import|\s+)\s*[\"']([a-zA-Z_][a-zA-Z0-9_/]*)[\"']", "m"),),
    },
}
PYTHON_IMPORT = Pattern(r"^(?:from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import|import\s+([a-zA-Z_][a-zA-Z0-9_., \t]*))", "m")
NONE = "array<string>"


def python_imports(text: Column) -> Column:
    """The modules of import statements: what stands after from, or each of a list without its alias."""
    said = PYTHON_IMPORT.every(text, 0)
    named = lambda x: F.transform(F.split(F.regexp_extract(x, PYTHON_IMPORT.java, 2), ","), lambda m: F.substring_index(F.trim(m), " as ", 1))
    one = lambda x: F.when(x.startswith("from"), F.array(F.regexp_extract(x, PYTHON_IMPORT.java, 1))).otherwise(named(x))
    return F.filter(F.transform(F.flatten(F.transform(said, one)), lambda m: F.trim(m)), lambda m: m != "")


def declared(kind: str, text: Column, language: Column) -> Column:
    """Names of functions, classes or imports; functions and imports once each, in order."""
    out = F.array().cast(NONE)
    for name, patterns in DECLARATIONS[kind].items():
        out = F.when(language == name, F.concat(*[p.every(text) for p in patterns])).otherwise(out)
    if kind == "imports":
        out = F.when(language == "python", python_imports(text)).otherwise(out)
    return out if kind == "classes" else F.array_distinct(out)


#: Layers of a code base, by the folder in the path (the first that fits).
LAYERS = {
    "core": r"src[/\\]core[/\\]", "storage": r"src[/\\]storage[/\\]", "rag": r"src[/\\]rag[/\\]", "middleware": r"src[/\\]middleware[/\\]", "utils": r"src[/\\]utils[/\\]",
    "models": r"src[/\\]models[/\\]", "config": r"src[/\\]config[/\\]", "services": r"src[/\\]services[/\\]", "tools": r"src[/\\]tools[/\\]",
    "tests": r"tests?[/\\]", "scripts": r"scripts?[/\\]", "docs": r"docs?[/\\]", "migrations": r"migrations?[/\\]",
}


def layer(path: Column) -> Column:
    """E15."""
    out = F.lit("unknown")
    for name, pattern in reversed(list(LAYERS.items())):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]+$", ""))


def module(path: Column) -> Column:
    """The file's name without its ending; of an __init__ its folder's."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    out = F.when((_stem(path) == "__init__") & (F.coalesce(folder, F.lit("")) != ""), folder).otherwise(_stem(path))
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").otherwise(out)


def is_test(path: Column) -> Column:
    """E15."""
    return F.coalesce(F.lower(path).rlike(r"tests?[/\\]") | F.contains(F.lower(_stem(path)), F.lit("test")), F.lit(False))


#: Where a chunk of code may begin.
BOUNDARIES = (Pattern(r"^(?:async\s+def|def|class)\s+\w+", ""), Pattern(r"^(?:export\s+)?(?:async\s+)?(?:function|class)\s+\w+|^\w+\s*=\s*(?:async\s*)?\(", ""))


def is_boundary(line: Column, language: Column) -> Column:
    """C6."""
    python, other = (p.found(F.trim(line)) for p in BOUNDARIES)
    return F.when(language == "python", python).otherwise(other)
