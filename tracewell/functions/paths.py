"""Expressions over paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.config import IMAGE_TYPES, MULTIMODAL_TYPES, PRIMARY_TYPES, STRUCTURED_TYPES, TEXT_TYPES


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix without its dot, or ``unknown``; a leading dot makes no suffix."""
    found = F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)
    return F.when(found == "", "unknown").otherwise(found)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(F.regexp_like(name, F.lit(r"^.+\.[^.]+$")), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def anonymised(path: Column, keep_full: bool = False) -> Column:
    """The path below the sandbox folder (``.`` for the folder itself); elsewhere the file name, or the path if ``keep_full``."""
    inside = F.regexp_like(path, F.lit("/sandbox/[^/]+/"))
    rest = F.regexp_extract(path, "/sandbox/[^/]+/(.*)", 1)
    other = path if keep_full else basename(path)
    return F.when(path.isin("", "?"), path).when(inside, F.when(rest == "", ".").otherwise(rest)).otherwise(other)


def depth_below(path: Column, base: Column) -> Column:
    """Folders between ``base`` and the file; of a path outside it, those from the root, which counts as one."""
    parts = lambda p: F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    clean = F.regexp_replace(base, "/+$", "")
    under = F.startswith(path, F.concat(clean, F.lit("/")))
    root = F.when(F.startswith(path, F.lit("/")), 1).otherwise(0)
    return F.when(under, parts(F.substring(path, F.length(clean) + 1, F.length(path))) - 1).otherwise(parts(path) + root - 1)


def type_class(file_type: Column) -> dict[str, Column]:
    return {
        "is_structured": file_type.isin(*STRUCTURED_TYPES),
        "is_primary": file_type.isin(*PRIMARY_TYPES),
        "is_image": file_type.isin(*IMAGE_TYPES),
        "is_text": file_type.isin(*TEXT_TYPES),
        "is_multimodal": file_type.isin(*MULTIMODAL_TYPES),
    }


def has_cjk(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[\\u4e00-\\u9fff]"))


def rename_class(old: Column, new: Column, rich: bool = True) -> Column:
    """What a rename changed: seven outcomes over stems if ``rich``, else five over whole names."""
    a, b = basename(old), basename(new)
    has = lambda x, c: F.contains(x, F.lit(c))
    if not rich:
        bare = lambda x: F.replace(x, F.lit("_"), F.lit(""))
        same = (bare(a) == F.lower(bare(b))) | (F.lower(a) == F.lower(b))
        out = F.when(has(a, "_") & has(b, "-"), "snake_to_kebab").when(has(a, "-") & has(b, "_"), "kebab_to_snake")
        return out.when(has(a, "_") & (F.lower(a) != a), "mixed_to_other").when(same, "case_change").otherwise("other")
    dated = lambda x: F.regexp_like(x, F.lit(r"^\d{4}[-_]\d{2}"))
    x, y = stem(old), stem(new)
    out = F.when(extension(old) != extension(new), "extension_change").when(~dated(x) & dated(y), "added_date_prefix").when(dated(x) & ~dated(y), "removed_date_prefix")
    out = out.when((F.lower(x) == F.lower(y)) & (x != y), "case_change")
    return out.when(has(x, "_") & has(y, "-"), "snake_to_kebab").when(has(x, "-") & has(y, "_"), "kebab_to_snake").otherwise("other")


def looks_temporary(path: Column) -> Column:
    """As seen by the watcher: by name."""
    return F.regexp_like(F.lower(basename(path)), F.lit(r"^~|\.(tmp|swp|bak)$|untitled"))


def temporary_extension(path: Column) -> Column:
    """As seen by the shell recorder: by extension."""
    return F.lower(extension(path)).isin("tmp", "temp", "bak", "swp", "swo", "pyc", "o", "log")


def backup_extension(path: Column) -> Column:
    return F.lower(extension(path)).isin("bak", "backup", "orig", "old", "save")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a whole-string regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else f"\\{c}") for c in pattern) + "$"


def ignored(path: Column, patterns: tuple[str, ...] = ("*.pyc", "*/node_modules/*", "*/.git/*")) -> Column:
    """Hidden files, atomic-save leftovers, editors' swap files and shell patterns over the path."""
    name = basename(path)
    out = F.startswith(name, F.lit(".")) | F.contains(name, F.lit(".sb-")) | F.startswith(name, F.lit("~")) | F.endswith(name, F.lit("~"))
    for p in patterns:
        out = out | F.regexp_like(path, F.lit(glob_regex(p)))
    return out
