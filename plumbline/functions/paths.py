"""Path predicates and keys as Column functions; all are JVM expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import tables as t

NOT_AUTHORED, BINARY, GENERATED, BOILERPLATE, SOURCE, UNKNOWN = "not_authored", "binary", "generated", "boilerplate", "source", "unknown"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the name, as written; null for names without one, with one in front only, or ``..``."""
    name = file_name(path)
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$") & (name != ".."), found)


def classify_key(path: Column) -> Column:
    """Lower-case extension, else the lower-case name without one leading dot."""
    return F.coalesce(F.lower(extension(path)), F.lower(F.regexp_replace(file_name(path), r"^\.", "")))


def extension_key(path: Column) -> Column:
    """Reporting bucket: the key if the file has an extension or a known name, else ``no_ext``."""
    key = classify_key(path)
    return F.when(extension(path).isNotNull() | key.isin(*t.SYNTAX), key).otherwise(t.NO_EXTENSION)


def shebang_key(content: Column) -> Column:
    """Key that a text's ``#!`` line implies, else null."""
    line = F.regexp_extract(content, r"^#!([^\n]*)", 1)
    words = F.filter(F.split(line, r"\s+"), lambda w: (w != "") & ~w.startswith("-") & ~w.endswith("env"))
    program = F.regexp_replace(F.element_at(F.split(F.get(words, F.lit(0)), "/"), -1), r"[0-9.]+$", "")
    keys = F.create_map(*(F.lit(x) for pair in t.SHEBANGS.items() for x in pair))
    return F.when(content.startswith("#!"), F.element_at(keys, program))


def has_extension(path: Column, wanted: list[str]) -> Column:
    """Extension filter, whatever the case; an empty list lets all pass, a name without extension passes none."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.lower(extension(path)).isin(*(w.lower().lstrip(".") for w in wanted)), F.lit(False))


def within_depth(path: Column, depth: int) -> Column:
    """Relative paths at most ``depth`` names below the root."""
    return F.size(F.split(path, "/")) <= depth


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def glob_pattern(glob: str) -> str:
    """Regular expression for an ignore glob: the place itself and all below it, at any depth unless it holds a slash."""
    glob = glob.rstrip("/")
    anchored = "/" in glob
    out, k = "", 0
    body = glob.lstrip("/")
    while k < len(body):
        c = body[k]
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if body.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = body.find("]", k + 2)
            if end < 0:
                raise ValueError(f"unclosed class in {glob!r}")
            inner = body[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]"
            k = end
        elif c == "{":
            end = body.find("}", k)
            if end < 0:
                raise ValueError(f"unclosed group in {glob!r}")
            out += "(?:" + "|".join(re.escape(x) for x in body[k + 1 : end].split(",")) + ")"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return ("^" if anchored else "(?:^|.*/)") + out + "(?:/.*)?$"


def is_ignored(path: Column, globs: list[str]) -> Column:
    """Any of the ignore globs covers the path."""
    return reduce(lambda a, g: a | path.rlike(glob_pattern(g)), globs, F.lit(False))


def is_noise(path: Column) -> Column:
    """Files of the system, editors, version control, and temporary ones."""
    return path.rlike("|".join([*t.OS_NOISE, *t.EDITOR_NOISE, *t.TEMPORARY_NOISE, *t.REPOSITORY_NOISE]))


BUILD_PATTERN = "(?:^|/)(?:" + "|".join(p for places in t.BUILD_PLACES.values() for p in places) + ")"


def in_build_place(path: Column) -> Column:
    """Below a folder that only build tools make."""
    return path.rlike(BUILD_PATTERN)


def pruned_names() -> list[str]:
    """Folder names that discovery never enters: the build places of one plain name, and the listed ones."""
    plain = [p[:-1].replace(r"\.", ".") for places in t.BUILD_PLACES.values() for p in places if re.fullmatch(r"(?:\\\.|[\w-])+/", p)]
    return sorted({*plain, *t.PRUNED_NAMES})


def is_binary(path: Column) -> Column:
    return F.coalesce(F.lower(extension(path)).isin(*t.BINARY_EXTENSIONS), F.lit(False))


def is_generated(path: Column) -> Column:
    name = F.lower(file_name(path))
    suffix = "(?:" + "|".join(map(re.escape, t.GENERATED_SUFFIXES)) + ")$"
    return name.isin(*t.GENERATED_NAMES) | name.rlike(suffix) | name.rlike(r"(?s)^.*\.generated\.[^.]*$")


def is_boilerplate(path: Column) -> Column:
    stems, endings = "|".join(t.BOILERPLATE_STEMS), "|".join(t.BOILERPLATE_EXTENSIONS)
    return F.lower(file_name(path)).rlike(rf"^(?:{stems})(?:\.(?:{endings}))?$")


def disposition(path: Column, content: Column | None = None, build_output: Column | None = None) -> Column:
    """What becomes of a file, first rule first: not authored here, binary, generated, boilerplate, source, unknown.

    ``build_output`` says whether the path lies in a corroborated build folder; ``content`` lets
    names without extension count as source by their ``#!`` line.
    """
    known = classify_key(path).isin(*t.SYNTAX)
    if content is not None:
        known = known | (extension(path).isNull() & shebang_key(content).isNotNull())
    elsewhere = is_noise(path) | in_build_place(path)
    if build_output is not None:
        elsewhere = elsewhere | build_output
    return (
        F.when(elsewhere, NOT_AUTHORED)
        .when(is_binary(path), BINARY)
        .when(is_generated(path), GENERATED)
        .when(is_boilerplate(path), BOILERPLATE)
        .when(known, SOURCE)
        .otherwise(UNKNOWN)
    )


def should_include(path: Column, build_output: Column | None = None) -> Column:
    """The older test of a path alone: no noise, no build place, not binary, not generated; boilerplate passes."""
    out = is_noise(path) | in_build_place(path) | is_binary(path) | is_generated(path)
    return ~(out if build_output is None else out | build_output)


def shorten(path: Column, most: int = 50) -> Column:
    """Longer paths keep their first and last name, or only the last where that is still too long; of one or two names the end is kept."""
    names = F.split(path, "/")
    first, last = F.element_at(names, 1), F.element_at(names, -1)
    tail = F.concat(F.lit("..."), F.right(path, F.lit(most - 3)))
    middle = F.when(most - 3 - F.char_length(last) - F.char_length(first) > 0, F.concat(first, F.lit("/.../"), last)).otherwise(F.concat(F.lit(".../"), last))
    return F.when(F.char_length(path) <= most, path).when(F.size(names) <= 2, tail).otherwise(middle)


def to_uri(path: Column) -> Column:
    """Forward slashes; absolute paths get ``file://``; what is a URI already stays."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith("/"), F.concat(F.lit("file://"), p)).otherwise(p)


def sort_key(path: Column) -> Column:
    """Orders paths by their components."""
    return F.split(path, "/")
