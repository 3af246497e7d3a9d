"""Paths, symbols and globs as column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analysable suffixes by language, and the suffixes of plain text.
PYTHON_SUFFIXES = ("py",)
TYPESCRIPT_SUFFIXES = ("ts", "mts", "cts")
JAVASCRIPT_SUFFIXES = ("js", "jsx", "mjs", "cjs")
TEXT_SUFFIXES = ("md", "markdown", "txt", "rst", "toml", "yaml", "yml", "json", "json5", "ini", "cfg", "conf", "env", "lock", "csv", "tsv", "xml", "html", "htm", "css", "scss", "less", "svg", "sql", "proto", "graphql", "gql", "sh", "bash", "zsh", "ps1", "bat", "cmd")


def path_suffix(path: Column) -> Column:
    """Text after the last dot, lower-cased; empty without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def language_of(path: Column) -> Column:
    s = path_suffix(path)
    bare = ~F.contains(path, F.lit("/")) & ~F.contains(path, F.lit("."))
    return (
        F.when(s.isin(*PYTHON_SUFFIXES), "python")
        .when(s == "tsx", "tsx")
        .when(s.isin(*TYPESCRIPT_SUFFIXES), "typescript")
        .when(s.isin(*JAVASCRIPT_SUFFIXES), "javascript")
        .when(s.isin(*TEXT_SUFFIXES) | bare, "text")
        .otherwise("unsupported")
    )


def is_safe_path(path: Column) -> Column:
    """Relative, without drive letters, NUL, or parts that are empty, dots, a tilde, or end in a dot or blank."""
    bad_part = lambda p: p.isin("", ".", "..", "~") | F.endswith(p, F.lit(".")) | F.endswith(p, F.lit(" "))
    return ~path.rlike(r"^[A-Za-z]:") & ~F.contains(path, F.lit("\0")) & F.forall(F.split(path, "/"), lambda p: ~bad_part(p))


def normalize_path(path: Column) -> Column:
    """Forward slashes, once each; no blanks around; no leading ./"""
    slashed = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.regexp_replace(F.regexp_replace(slashed, "/+", "/"), r"^(\./)+", "")


def simple_name(symbol: Column) -> Column:
    return F.substring_index(F.substring_index(symbol, ":", -1), ".", -1)


def qualify(module: Column, qualname: Column) -> Column:
    return F.when((module != "") & (qualname != ""), F.concat_ws(":", module, qualname))


def validate_glob(pattern: str) -> bool:
    """Whether a glob is well formed: no classes, negation, escapes, or odd slashes."""
    return bool(pattern) and not re.search(r"[!\[\]\\\0]|^/|/$|//", pattern) and not any(p in (".", "..") for p in pattern.split("/"))


@functools.lru_cache(2048)
def glob_regex(pattern: str, kind: str = "path") -> str:
    """An anchored regular expression: ** crosses separators, * and ? don't."""
    one = "[^/\n]" if kind == "path" else "[^/:.\n]"
    out = []
    for m in re.finditer(r"\*\*|\*|\?|[^*?]+", pattern):
        out.append({"**": ".*", "*": one + "*", "?": one}.get(m[0]) or re.sub(r"([^A-Za-z0-9_/:\-])", r"\\\1", m[0]))
    return "^" + "".join(out) + "$"


def matches_any(value: Column, patterns: list[str], kind: str = "path") -> Column:
    """Whether any glob fits the whole value."""
    return functools.reduce(lambda a, b: a | b, (value.rlike(glob_regex(p, kind)) for p in patterns), F.lit(False))




def globs_are_universal(patterns: list[str]) -> bool:
    """Whether every path of non-empty parts joined by slashes fits some glob.

    Characters fall into classes: the slash, each literal of the patterns, and any
    other. States are sets of (pattern, place) pairs together with whether a part
    may end here; all reachable ones are tried.
    """
    tokens = [re.findall(r"\*\*|\*|\?|.", p, re.S) for p in patterns]
    letters = {c for t in tokens for c in t if c not in ("*", "**", "?")} - {"/"}
    fresh = next(chr(c) for c in range(0x100, 0x10000) if chr(c) not in letters)

    def close(states):
        todo, seen = list(states), set(states)
        while todo:
            p, i = todo.pop()
            if i < len(tokens[p]) and tokens[p][i] in ("*", "**") and (p, i + 1) not in seen:
                seen.add((p, i + 1))
                todo.append((p, i + 1))
        return frozenset(seen)

    def step(states, c):
        out = set()
        for p, i in states:
            if i == len(tokens[p]):
                continue
            t = tokens[p][i]
            if t == "**" or t == "*" and c != "/":
                out.add((p, i))
            elif t == c or t == "?" and c != "/":
                out.add((p, i + 1))
        return close(out)

    start = (close({(p, 0) for p in range(len(tokens))}), False)
    todo, seen = [start], {start}
    while todo:
        states, in_part = todo.pop()
        if in_part and not any(i == len(tokens[p]) for p, i in states):
            return False
        for c in [*letters, fresh, *(["/"] if in_part else [])]:
            new = (step(states, c), c != "/")
            if new not in seen:
                seen.add(new)
                todo.append(new)
    return True
