"""Module names of files and of imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_ENDINGS = (".py", ".tsx", ".mts", ".cts", ".ts", ".jsx", ".mjs", ".cjs", ".js")


def module_of(path: Column) -> Column:
    """Dotted name of a file: no ending, and a package's own name for its __init__ or index."""
    bare = F.regexp_replace(path, r"\.(py|tsx|mts|cts|ts|jsx|mjs|cjs|js)$", "")
    return F.replace(F.regexp_replace(bare, r"(^|/)(__init__|index)$", ""), F.lit("/"), F.lit("."))


def imported_module(module: Column, importer: Column, level: Column) -> Column:
    """Dotted name that an import means; null if it climbs out of the tree.

    Level 0 is absolute. Each further level drops a part of the importer's package.
    Paths that start with a dot (of scripts) are taken from the importer's folder.
    """
    folder = F.regexp_replace(importer, r"/?[^/]*$", "")
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    up = level - 1
    package = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), ".")
    joined = F.concat_ws(".", F.when(package != "", package), F.when(module != "", module))
    script = F.regexp_replace(F.concat_ws("/", F.when(folder != "", folder), module), r"(^|/)\./", "$1")
    climbed = F.regexp_replace(F.regexp_replace(script, r"[^/]+/\.\./", ""), r"[^/]+/\.\./", "")
    return (
        F.when(F.startswith(module, F.lit("./")) | F.startswith(module, F.lit("../")), F.when(F.contains(climbed, F.lit("..")), None).otherwise(module_of(climbed)))
        .when(level <= 0, module)
        .when(up > F.size(parts), None)
        .otherwise(joined)
    )
