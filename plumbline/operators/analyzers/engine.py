"""Function and structure extraction from source lines.

Five ways of finding a function's end cover all languages: braces that must close on a line
of their own accord (``strict``), braces or nothing (``loose``), indentation, closing words,
and a search ahead from each declaration.  A language is a record of small predicates; the
loops here know no language.  Matching is by substring, on purpose: that is the metric.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from plumbline.operators.analyzers import rules
from plumbline.operators.analyzers.rules import Memo, has

CLASS, INTERFACE, STRUCT, ENUM, TRAIT, MODULE = "Class", "Interface", "Struct", "Enum", "Trait", "Module"
PUBLIC, PRIVATE, PROTECTED, INTERNAL = "Public", "Private", "Protected", "Internal"


@dataclass
class Function:
    name: str
    start_line: int
    end_line: int
    line_count: int = 0
    cyclomatic: int = 1
    cognitive: int = 1
    nesting_depth: int = 0
    parameter_count: int = 0
    return_path_count: int = 0
    is_method: bool = False
    parent_class: str | None = None
    local_variable_count: int = 0
    has_recursion: bool = False
    has_exception_handling: bool = False
    visibility: str = PUBLIC


@dataclass
class Structure:
    name: str
    kind: str
    start_line: int
    end_line: int
    line_count: int = 0
    method_count: int = 0
    properties: int = 0
    visibility: str = PUBLIC
    inheritance_depth: int = 0
    interface_count: int = 0


@dataclass
class Declared:
    """What a declaration's line tells."""

    name: str
    parameters: int = 0
    is_method: bool = False
    parent: str | None = None


def word(text: str, extra: str = "_") -> bool:
    """Letters, digits and the extra characters alone, at least one."""
    return text.isalnum() or bool(text) and all(c.isalnum() or c in extra for c in text)


def first_word(text: str) -> str:
    return next(iter(text.split()), "")


def after(text: str, mark: str) -> str | None:
    """What follows the first ``mark``."""
    at = text.find(mark)
    return None if at < 0 else text[at + len(mark) :]


def up_to(text: str, *marks: str) -> str:
    """Text before the first of the marks that occurs, tried in order; all of it if none does."""
    for mark in marks:
        at = text.find(mark)
        if at >= 0:
            return text[:at]
    return text


def before_all(text: str, marks: str) -> str:
    """Text before whichever of the marks comes first."""
    for mark in marks:
        text = text.split(mark, 1)[0]
    return text


def inside(line: str, last: bool, open_: str = "(", close: str = ")") -> str | None:
    """Text from the first opening bracket to the first (or last) closing one; None without both in order."""
    a = line.find(open_)
    b = line.rfind(close) if last else line.find(close)
    return line[a + 1 : b] if 0 <= a < b else None


def arguments(text: str | None, brackets: str = "()<>", quotes: bool = False) -> int:
    """Commas outside of brackets, plus one; 0 for blank text."""
    if text is None or not text.strip():
        return 0
    depth, count, held = dict.fromkeys(brackets[::2], 0), 1, ""
    for c in text:
        if quotes and not held and c in "\"'":
            held = c
        elif quotes and held and c == held:
            held = ""
        elif held:
            continue
        elif c in brackets:
            k = brackets.index(c)
            depth[brackets[k & ~1]] += -1 if k & 1 else 1
        elif c == "," and not any(depth.values()):
            count += 1
    return count


def plain_arguments(text: str | None) -> int:
    return len(text.split(",")) if text is not None and text.strip() else 0


# ---- which lines count ------------------------------------------------------------------


@dataclass
class Skipper:
    """Leaves out blank lines, comment lines, and comment blocks that lines open and close."""

    starts: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    tags: bool = False  # code stands between <? and ?> alone

    def lines(self, lines: list[str]) -> Iterator[tuple[int, str, str]]:
        """(index, raw line, trimmed line) of the lines that count."""
        inside_block = inside_tags = False
        for i, raw in enumerate(lines):
            line = raw.strip()
            if self.tags:
                inside_tags |= "<?" in line
                if "?>" in line:
                    inside_tags = False
                    continue
                if not inside_tags:
                    continue
            if self.block:
                inside_block |= line.startswith(self.block[0])
                if line.endswith(self.block[1]):
                    inside_block = False
                    continue
                if inside_block:
                    continue
            if line and not line.startswith(self.starts):
                yield i, raw, line


# ---- languages --------------------------------------------------------------------------


@dataclass(slots=True)
class Line:
    """All that a trimmed line tells by itself."""

    declared: Declared | None
    opening: int
    closing: int
    cyclomatic: int
    flat: int
    deep: int
    returns: bool
    handles: bool
    local: bool
    ends: bool


@dataclass
class Language:
    name: str
    declares: Callable[[str], Declared | None]
    structure: Callable[[str], tuple[str, str, str, int] | None]  # kind, name, visibility, inheritance
    skip: Skipper = field(default_factory=Skipper)
    handles: tuple[str, ...] = ("try", "catch", "throw")
    local: Callable[[str], bool] = lambda line: False
    returns: str = "return"
    also_ends: Callable[[str], bool] = lambda line: False
    property: Callable[[str, Structure], int] = lambda line, s: 0
    interface: Callable[[str, Structure], int] = lambda line, s: 0
    inherits: Callable[[str, Structure], int] = lambda line, s: 0
    owner: str = "none"  # whose structure gets a method: none, open, last, named
    method: Callable[[str], bool] = lambda line: True

    def __post_init__(self):
        self.told, self.structures, self.parents = Memo(self.tell), Memo(self.structure), Memo(lambda line: self.structure(line, any_name=True))

    def tell(self, line: str) -> Line:
        flat, deep = rules.cognitive_parts(self.name, line)
        return Line(
            self.declares(line), line.count("{"), line.count("}"), rules.cyclomatic(self.name, line), flat, deep, self.returns in line, has(line, *self.handles), self.local(line), self.also_ends(line),
        )

    def measure(self, f: Function, x: Line, nesting: int) -> None:
        f.cyclomatic += x.cyclomatic
        f.cognitive += x.flat + x.deep * max(nesting, 1)
        f.return_path_count += x.returns
        f.has_exception_handling |= x.handles
        f.local_variable_count += x.local


def loose_functions(lang: Language, lines: list[str]) -> list[Function]:
    """A declaration opens a function, whatever is open; it ends where no brace is open."""
    found, f, depth, nesting, parent = [], None, 0, 0, None
    for i, _, line in lang.skip.lines(lines):
        if lang.owner == "open" and (told := lang.parents[line]) is not False:
            parent = told
        x = lang.told[line]
        declared = x.declared
        if declared:
            held = (parent is not None, parent) if lang.owner == "open" else (declared.is_method, declared.parent)
            f = Function(declared.name, i + 1, i + 1, parameter_count=declared.parameters, is_method=held[0], parent_class=held[1])
            depth = nesting = 0
        if f is None:
            continue
        depth += x.opening - x.closing
        nesting += x.opening > 0
        nesting = max(0, nesting - (x.closing > 0))
        f.line_count, f.end_line = f.line_count + 1, i + 1
        f.nesting_depth = max(f.nesting_depth, nesting)
        lang.measure(f, x, nesting)
        f.has_recursion |= f.name in line and "(" in line
        if depth <= 0 or x.ends:
            found.append(f)
            f, nesting = None, 0
    return found


def loose_structures(lang: Language, lines: list[str]) -> list[Structure]:
    found, s, depth = [], None, 0
    for i, raw, line in lang.skip.lines(lines):
        told = lang.structures[line]
        if told:
            s, depth = Structure(told[1], told[0], i + 1, i + 1, visibility=told[2], inheritance_depth=told[3]), 0
        if s is None:
            continue
        depth += raw.count("{") - raw.count("}")
        s.line_count, s.end_line = s.line_count + 1, i + 1
        s.properties += lang.property(line, s)
        if lang.owner == "open" and lang.told[line].declared:
            s.method_count += 1
        s.interface_count += lang.interface(line, s)
        s.inheritance_depth = lang.inherits(line, s) or s.inheritance_depth
        if depth <= 0:
            found.append(s)
            s = None
    if lang.owner in ("last", "named") and found:
        for line in map(str.strip, lines):
            declared = lang.told[line].declared if lang.method(line) else None
            if not declared:
                continue
            if lang.owner == "last":
                found[-1].method_count += 1
            else:
                own = next((s for s in found if s.name == declared.parent), None)
                if own:
                    own.method_count += 1
    return found


def strict_functions(lang: Language, lines: list[str], own: str, opener: str) -> list[Function]:
    """As loose, but a function ends on a line with a closing brace; parameters come from the first bracketed list of any line."""
    found, f, depth = [], None, 0
    for i, _, line in lang.skip.lines(lines):
        x = lang.told[line]
        if x.declared:
            f, depth = Function(x.declared.name, i + 1, i + 1), 0
        if f is None:
            continue
        depth += x.opening - x.closing
        f.line_count, f.end_line = f.line_count + 1, i + 1
        f.nesting_depth = max(f.nesting_depth, depth)
        lang.measure(f, x, depth)
        if not f.parameter_count:
            f.parameter_count = receiver_arguments(line, own)
        f.has_recursion |= f.name in line and not line.startswith(opener)
        if depth <= 0 and x.closing:
            found.append(f)
            f = None
    return found


def receiver_arguments(line: str, own: str) -> int:
    """Arguments between the outermost brackets, less one if the receiver's word is among them."""
    text = inside(line, last=True)
    return max(0, plain_arguments(text) - (own in text)) if text and text.strip() else 0


def strict_structures(lang: Language, lines: list[str]) -> list[Structure]:
    found, s, depth = [], None, 0
    for i, _, line in lang.skip.lines(lines):
        told = lang.structures[line]
        if told:
            s, depth = Structure(told[1], told[0], i + 1, i + 1, visibility=told[2]), 0
        if s is None:
            continue
        closing = line.count("}")
        depth += line.count("{") - closing
        s.line_count, s.end_line = s.line_count + 1, i + 1
        s.properties += lang.property(line, s)
        if depth <= 0 and closing:
            found.append(s)
            s = None
    return found


def indented(lang: Language, lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(index, indentation in bytes, trimmed line)."""
    for i, raw, line in lang.skip.lines(lines):
        yield i, len(raw.encode()) - len(raw.lstrip().encode()), line


def indented_functions(lang: Language, lines: list[str]) -> list[Function]:
    found, f, base = [], None, 0
    for i, indent, line in indented(lang, lines):
        x = lang.told[line]
        if x.declared:
            found += [f] if f else []
            f, base = Function(x.declared.name, i + 1, i + 1, is_method=x.declared.is_method), indent
        if f is None:
            continue
        if indent <= base:
            if i > f.start_line - 1:
                found.append(f)
                f = None
            continue
        depth = (indent - base) // 4
        f.line_count, f.end_line = f.line_count + 1, i + 1
        f.nesting_depth = max(f.nesting_depth, depth)
        lang.measure(f, x, depth)
        if not f.parameter_count:
            f.parameter_count = receiver_arguments(line, "self")
        f.has_recursion |= f.name in line and not line.startswith("def ")
    return found + ([f] if f else [])


def indented_structures(lang: Language, lines: list[str]) -> list[Structure]:
    found, s, base = [], None, 0
    for i, indent, line in indented(lang, lines):
        told = lang.structures[line]
        if told:
            found += [s] if s else []
            s, base = Structure(told[1], told[0], i + 1, i + 1, visibility=told[2]), indent
        if s is None:
            continue
        if indent <= base:
            if i > s.start_line - 1:
                found.append(s)
                s = None
            continue
        s.line_count, s.end_line = s.line_count + 1, i + 1
        s.properties += lang.property(line, s)
    return found + ([s] if s else [])


# ---- search ahead -----------------------------------------------------------------------


@dataclass
class Ahead:
    """A language whose spans are looked for from each declaration on."""

    name: str
    function: Callable[[str], str | None]
    function_end: Callable[[list[str], int], int]
    parameters: Callable[[str], int]
    structure: Callable[[str], str | None]
    structure_end: Callable[[list[str], int], int]
    kind: Callable[[str], str]
    fields: Callable[[list[str]], int]
    visibility: Callable[[str], str] = lambda line: PUBLIC
    owns_methods: bool = False

    def __post_init__(self):
        self.named, self.branches = Memo(self.function), Memo(lambda line: rules.cyclomatic(self.name, line))

    def functions(self, lines: list[str]) -> list[Function]:
        found = []
        sums = [0]  # running counts, so that nested spans cost nothing
        for line in lines:
            sums.append(sums[-1] + self.branches[line])
        for i, line in enumerate(lines):
            name = self.named[line]
            if name:
                end = self.function_end(lines, i)
                c = 1 + sums[min(end + 1, len(lines))] - sums[i]
                found.append(Function(name, i + 1, end + 1, max(end - i, 1), c, c, parameter_count=self.parameters(line), return_path_count=1))
        return found

    def structures(self, lines: list[str]) -> list[Structure]:
        found = []
        for i, line in enumerate(lines):
            name = self.structure(line)
            if name:
                end = self.structure_end(lines, i)
                span = lines[i : end + 1]
                methods = sum(self.named[x] is not None for x in span) if self.owns_methods else 0
                found.append(Structure(name, self.kind(line.strip()), i + 1, end + 1, max(end - i, 1), methods, self.fields(span), self.visibility(line)))
        return found


def word_end(starts: tuple[str, ...], once: int, opens: tuple[str, ...], early: Callable[[str, int], bool] | None = None, until: tuple[str, ...] = ()):
    """End by the closing word: ``starts`` begin the span (and deepen it by ``once``), ``opens`` deepen it by one a line."""

    def end(lines: list[str], at: int) -> int:
        depth, started = 0, False
        for i in range(at, len(lines)):
            line = lines[i].strip()
            if has(line, *starts):
                started = True
                depth += once
            if not started:
                continue
            depth += has(line, *opens)
            if line == "end" or line.startswith("end "):
                depth -= 1
                if depth == 0:
                    return i
            if until and has(line, *until):
                depth -= 1
                if depth == 0:
                    return i
            if early and early(line, depth):
                return i
        return max(0, len(lines) - 1)

    return end


def bracket_end(starts: tuple[str, ...], open_: str, close: str, needs_close: bool):
    """End where the brackets are level again, never counted below zero."""

    def end(lines: list[str], at: int) -> int:
        depth, started = 0, False
        for i in range(at, len(lines)):
            line = lines[i].strip()
            started = started or has(line, *starts)
            if started:
                depth = max(0, depth + line.count(open_) - line.count(close))
                if depth == 0 and (not needs_close or close in line):
                    return i
        return max(0, len(lines) - 1)

    return end


def table_end(lines: list[str], at: int) -> int:
    """End of a table in braces, whose opening line counts twice."""
    depth, started = 0, False
    for i in range(at, len(lines)):
        line = lines[i].strip()
        if "= {" in line:
            started = True
            depth += 1
        if started:
            depth += line.count("{")
            if "}" in line:
                depth = max(0, depth - line.count("}"))
                if depth == 0:
                    return i
    return max(0, len(lines) - 1)


def indent_end(words: tuple[str, ...]):
    """End before the next line that is no deeper and holds one of the words."""

    def end(lines: list[str], at: int) -> int:
        base = None
        for i in range(at, len(lines)):
            line = lines[i].strip()
            if not line:
                continue
            indent = len(lines[i].encode()) - len(lines[i].lstrip().encode())
            if base is None:
                base = indent
            elif indent <= base and has(line, *words) and not line.startswith("--"):
                return max(0, i - 1)
        return max(0, len(lines) - 1)

    return end


def split_lines(text: str) -> list[str]:
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [line.removesuffix("\r") for line in lines]


WORDS = re.compile(r"\S+")
