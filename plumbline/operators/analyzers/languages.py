"""The languages: what declares a function or a structure, and what counts inside.

Substrings, word lists and the order in which they are tried are fixed values of the metric.
"""

from __future__ import annotations

from functools import partial

from plumbline.operators.analyzers.engine import (
    CLASS, ENUM, INTERFACE, INTERNAL, MODULE, PRIVATE, PROTECTED, PUBLIC, STRUCT, TRAIT, Ahead, Declared, Function, Language, Skipper, Structure, after, arguments, before_all, bracket_end,
    first_word, indent_end, indented_functions, indented_structures, inside, loose_functions, loose_structures, plain_arguments, split_lines, strict_functions, strict_structures, table_end,
    up_to, word, word_end,
)
from plumbline.operators.analyzers.rules import EXTENSIONS, Memo, has, measures


def _named(line: str, pairs: list[tuple[str, str]], cut: str, visibility: str) -> tuple[str, str, str, int] | None:
    """First of (text, kind) whose next word, cut at the given characters, isn't empty."""
    for text, kind in pairs:
        rest = after(line, text)
        name = before_all(first_word(rest), cut).strip() if rest else ""
        if name:
            return kind, name, visibility, 0
    return None


def _kind(line: str, pairs: list[tuple[str, str]], default: str) -> str:
    return next((kind for text, kind in pairs if text in line), default)


def _visibility(line: str, default: str) -> str:
    for text, told in (("public", PUBLIC), ("private", PRIVATE), ("protected", PROTECTED), ("internal", INTERNAL)):
        if text in line:
            return told
    return default


def _declared_word(line: str, words: list[str], cuts: list[str]) -> str | None:
    """Name after the first word, tried in order, that one follows; cut at the first of the cuts that occurs."""
    for w in words:
        rest = after(line, w)
        name = up_to(first_word(rest), *cuts) if rest else ""
        if word(name):
            return name
    return None


# ---- strict braces ----------------------------------------------------------------------


def _rust(line):
    if line.startswith("fn ") or " fn " in line:
        rest = after(line, "fn ")
        if "(" in rest:
            return Declared(rest.split("(", 1)[0].strip())
    return None


RUST = Language(
    "rust", _rust,
    lambda x: _named(x, [("struct ", STRUCT), ("enum ", ENUM), ("trait ", TRAIT), ("impl ", CLASS), ("mod ", MODULE)], "<{", PUBLIC if x.startswith("pub ") else PRIVATE),
    Skipper(("//",), None), ("try", "catch", "?"), property=lambda x, s: ":" in x and not has(x, "fn ", "//"),
)


def _javascript(line):
    if not (has(line, "function ", "=> ") or ("(" in line and ")" in line and "{" in line)):
        return None
    rest = after(line, "function ")
    if rest is not None and "(" in rest:
        return Declared(rest.split("(", 1)[0].strip())
    if "=>" in line:
        head = line[: line.find("=>")]
        if "=" in head:
            names = head[: head.rfind("=")].split()
            if names:
                return Declared(names[-1])
    return Declared("anonymous")


def _javascript_structure(line):
    told = PUBLIC if "export " in line else PRIVATE
    return _named(line, [("class ", CLASS)], "{(", told) or _named(line, [("interface ", INTERFACE), ("enum ", ENUM)], "<{", told)


JAVASCRIPT = Language(
    "javascript", _javascript, _javascript_structure, Skipper(("//", "/*"), None),
    property=lambda x, s: ("this." in x and "=" in x) or (":" in x and not has(x, "function", "=>")),
)


# ---- indentation ------------------------------------------------------------------------


def _python(line):
    if line.startswith("def ") and "(" in line:
        return Declared(line[4:].split("(", 1)[0].strip(), is_method="self" in line)
    return None


def _python_structure(line):
    name = line[6:].split("(", 1)[0].split(":", 1)[0].strip() if line.startswith("class ") else ""
    return (CLASS, name, PUBLIC, 0) if name else None


PYTHON = Language(
    "python", _python, _python_structure, Skipper(("#",), None), ("try:", "except", "finally"), property=lambda x, s: x.startswith("self.") and "=" in x
)


# ---- loose braces -----------------------------------------------------------------------

_JAVA_MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "synchronized")
_JAVA_TYPES = ("void", "int", "String", "boolean", "double", "float", "long", "char", "byte", "short")


def _java(line):
    if "(" not in line or not (has(line, *_JAVA_MODIFIERS, *_JAVA_TYPES, "<") or len(line.split()) >= 2):
        return None
    words = line.split("(", 1)[0].split()
    if len(words) < 2 or words[-1][0].isupper() or "<" in words[-1]:
        return None
    return Declared(words[-1], arguments(inside(line, last=False)))


def _java_name(line):
    for w in ("class ", "interface ", "enum "):
        rest = after(line, w)
        if rest is not None:
            name = first_word(rest)
            return up_to(name, "<") if name else None
    return None


def _java_structure(line, any_name=False):
    declared = has(line, "class ", "interface ", "enum ")
    if any_name:  # False: not a declaration at all
        return _java_name(line) if declared else False
    name = _java_name(line) if declared else None
    return name and (_kind(line, [("class ", CLASS), ("interface ", INTERFACE)], ENUM), name, _visibility(line.replace("internal", ""), INTERNAL), 0)


JAVA = Language(
    "java", _java, _java_structure, Skipper(("//", "/*"), None), local=lambda x: has(x, "int ", "String ", "boolean ", "double ", "float ", "long "),
    property=lambda x, s: has(x, "private ", "public ", "protected ") and "(" not in x and ";" in x,
    interface=lambda x, s: len(x.split("implements ")[1].split(",")) if "implements " in x else 0, inherits=lambda x, s: int("extends " in x), owner="open",
)

_CPP_TYPES = ("int ", "char ", "float ", "double ", "bool ", "string ")


def _cpp(line):
    if line.startswith(("#", "//", "/*")) or line.endswith(";") or "(" not in line or ")" not in line:
        return None
    if "=" in line and not has(line, "==", "!="):
        return None
    words = line.split("(", 1)[0].split()
    name = words[-1].lstrip("*").lstrip("&") if words else ""
    if not word(name) or name.startswith("operator"):
        return None
    text = inside(line, last=True)
    return Declared(name, 0 if text is None or text.strip() == "void" else arguments(text))


def _cpp_name(line):
    for w in ("class ", "struct ", "union ", "enum "):
        rest = after(line, w)
        name = before_all(first_word(rest), "<:{") if rest else ""
        if name:
            return name
    return None


def _cpp_structure(line, any_name=False):
    declared = has(line, "class ", "struct ", "union ", "enum ")
    if any_name:
        return _cpp_name(line) if declared else False
    name = _cpp_name(line) if declared else None
    told = next((v for a, b, v in (("public:", "public ", PUBLIC), ("private:", "private ", PRIVATE), ("protected:", "protected ", PROTECTED)) if has(line, a, b)), PUBLIC)
    return name and (_kind(line, [("class ", CLASS), ("struct ", STRUCT), ("union ", STRUCT)], ENUM), name, told, 0)


CPP = Language(
    "cpp", _cpp, _cpp_structure, Skipper(("//", "#")), ("try", "catch", "throw", "except"), local=lambda x: has(x, *_CPP_TYPES, "auto ") and "(" not in x,
    property=lambda x, s: has(x, *_CPP_TYPES) and "(" not in x and ";" in x, interface=lambda x, s: int("virtual " in x),
    inherits=lambda x, s: int(has(x, ": public", ": private", ": protected")), owner="open",
)


def _go(line):
    if not line.startswith("func ") or "(" not in line:
        return None
    rest, parent = line[5:], None
    method = rest.startswith("(") and ")" in rest
    if rest.startswith("("):
        if not method:
            return None
        receiver, rest = rest[1:].split(")", 1)
        names = receiver.split()
        parent = names[1].lstrip("*") if len(names) >= 2 else None
        rest = rest.strip()
    name = rest.split("(", 1)[0].strip() if "(" in rest else ""
    return Declared(name, plain_arguments(inside(line, last=False)), method, parent) if name else None


def _go_structure(line):
    words = line.split()
    if line.startswith("type ") and len(words) >= 3 and words[2] in ("struct", "interface"):
        return STRUCT if " struct" in line else INTERFACE, words[1], PUBLIC if words[1][0].isupper() else PRIVATE, 0
    return None


GO = Language(
    "go", _go, _go_structure, Skipper(), ("panic(", "recover(", "if err != nil"), local=lambda x: ":=" in x or ("var " in x and "func" not in x),
    property=lambda x, s: s.kind == STRUCT and " " in x and not x.startswith(("type ", "func ", "}", "{", "/*")), interface=lambda x, s: s.kind == INTERFACE and "(" in x and ")" in x,
    inherits=lambda x, s: s.inheritance_depth + 1 if s.kind == INTERFACE and "(" not in x and ")" not in x else 0, owner="named", method=lambda x: x.startswith("func (") and ")" in x,
)

_CS_MODIFIERS = ("public", "private", "protected", "internal", "static", "virtual", "override", "abstract", "async")


def _csharp(line):
    if line.startswith(("//", "/*")) or "(" not in line or not has(line, *_CS_MODIFIERS):
        return None
    words = line.split("(", 1)[0].split()
    name = up_to(words[-1], "<") if words else ""
    return Declared(name, arguments(inside(line, last=True)), "static" not in line) if word(name) else None


def _csharp_structure(line):
    name = None if line.startswith(("//", "/*")) else _declared_word(line, ["class", "struct", "interface", "enum", "record"], ["<", ":"])
    kind = _kind(line, [("class", CLASS), ("interface", INTERFACE), ("struct", STRUCT), ("enum", ENUM)], CLASS)
    return name and (kind, name, _visibility(line, PRIVATE), len(after(line, ":").split(",")) if ":" in line else 0)


CSHARP = Language(
    "csharp", _csharp, _csharp_structure, Skipper(), ("try", "catch", "finally", "throw"),
    local=lambda x: has(x, "var ", "int ", "string ", "bool ", "double ", "float ", "decimal ", "object ") and not has(x, "public", "private", "protected", "internal"),
    property=lambda x, s: has(x, "public", "private", "protected", "internal") and not has(x, "class", "struct", "interface", "enum") and not ("(" in x and has(x, *_CS_MODIFIERS)) and has(x, ";", "{ get", "{ set", "=>"),
    interface=lambda x, s: s.kind == INTERFACE and "(" in x and ")" in x, owner="last",
)


def _php(line):
    if line.startswith(("//", "/*", "#")) or "function " not in line or "(" not in line:
        return None
    rest = after(line, "function ").removeprefix("&")
    name = rest.split("(", 1)[0].strip() if "(" in rest else ""
    return Declared(name, arguments(inside(line, last=True), "()", quotes=True), _php_method(line)) if word(name) else None


def _php_method(line):
    return has(line, "public", "private", "protected", "static", "abstract", "final")


def _php_structure(line):
    name = None if line.startswith(("//", "/*", "#")) else _declared_word(line, ["class", "interface", "trait"], ["extends", "implements"])
    depth = ("extends" in line) + (len(after(line, "implements").split(",")) if "implements" in line else 0)
    return name and (_kind(line, [("class", CLASS), ("interface", INTERFACE), ("trait", TRAIT)], CLASS), name, _visibility(line.replace("internal", ""), PUBLIC), depth)


def _php_function(line):
    return "function " in line and "(" in line and not line.startswith(("//", "/*", "#"))


PHP = Language(
    "php", _php, _php_structure, Skipper(("//", "#"), tags=True), ("try", "catch", "finally", "throw"), local=lambda x: x.startswith("$") or " $" in x,
    property=lambda x, s: has(x, "public", "private", "protected") and not _php_function(x) and (x.startswith("$") or has(x, " $", "const ")),
    interface=lambda x, s: s.kind == INTERFACE and _php_function(x), owner="last", method=_php_method,
)

_NESTED = "()<>{}"


def _heir_parts(line):
    """Comma-separated names after the colon, up to the constraint or the body."""
    rest = after(line, ":")
    return 0 if rest is None else len(up_to(rest, " where ", "{").split(","))


def _keyword_function(line, keyword, method):
    if line.startswith(("//", "/*")) or keyword not in line or "(" not in line:
        return None
    rest = after(line, keyword)
    name = up_to(rest, "(", "<").strip()
    return Declared(name, arguments(inside(line, last=True), _NESTED), method(line)) if word(name) else None


_swift = partial(_keyword_function, keyword="func ", method=lambda x: not has(x, "static", "class func"))


def _swift_structure(line):
    name = None if line.startswith(("//", "/*")) else _declared_word(line, ["class", "struct", "protocol", "enum", "extension"], ["<", ":"])
    told = PUBLIC if has(line, "public", "open") else PRIVATE if "private" in line else INTERNAL
    return name and (_kind(line, [("class", CLASS), ("struct", STRUCT), ("protocol", INTERFACE), ("enum", ENUM)], CLASS), name, told, _heir_parts(line))


SWIFT = Language(
    "swift", _swift, _swift_structure, Skipper(), local=lambda x: has(x, "let ", "var ") and not has(x, "func ", "class ", "struct ", "protocol "),
    property=lambda x, s: has(x, "let ", "var ") and not ("func " in x and "(" in x) and (has(x, "public", "private", "internal", "fileprivate") or not has(x, "func ", "init ")),
    interface=lambda x, s: s.kind == INTERFACE and (("func " in x and "(" in x) or ("var " in x and "=" not in x)), owner="last",
)


def _extension(line):
    rest = after(line, "fun ")
    return rest is not None and "." in rest and rest.find(".") < (rest.find("(") if "(" in rest else len(rest))


_kotlin = partial(_keyword_function, keyword="fun ", method=lambda x: not _extension(x))


def _kotlin_structure(line):
    name = None if line.startswith(("//", "/*")) else _declared_word(line, ["class", "interface", "object", "enum", "sealed", "data"], ["<", ":", "("])
    return name and (_kind(line, [("class", CLASS), ("interface", INTERFACE), ("enum", ENUM)], CLASS), name, _visibility(line, PUBLIC), _heir_parts(line))


KOTLIN = Language(
    "kotlin", _kotlin, _kotlin_structure, Skipper(), ("try", "catch", "finally", "throw"), local=lambda x: has(x, "val ", "var ") and not has(x, "fun ", "class ", "interface ", "object "),
    also_ends=lambda x: "=" in x and "{" not in x and x.endswith(")"),
    property=lambda x, s: has(x, "val ", "var ") and not ("fun " in x and "(" in x) and (has(x, "public", "private", "protected", "internal") or not has(x, "fun ", "class ")),
    interface=lambda x, s: s.kind == INTERFACE and (("fun " in x and "(" in x) or has(x, "val ", "var ")), owner="last",
)

_DART_TYPES = ["void ", "Future<", "Stream<", "int ", "String ", "bool ", "double ", "List<", "Map<", "dynamic ", "var ", "final ", "const ", "static ", "async ", "sync "]


def _dart_is_function(line):
    if line.startswith(("//", "/*")) or "(" not in line:
        return False
    return has(line, *_DART_TYPES, "get ", "set ") or not has(line, "=", "if", "for", "while", "switch")


def _dart(line):
    if not _dart_is_function(line):
        return None
    name = next((n for n in (_dart_after(line, t) for t in _DART_TYPES) if n), None)
    if name is None and "=" not in line:
        name = next((n for n in (p.split("(", 1)[0] for p in line.split() if "(" in p) if word(n)), None)
    return name and Declared(name, arguments(inside(line, last=True), _NESTED), "static" not in line)


def _dart_after(line, text):
    """The name in front of a bracket after a type; generic types end at their first closing bracket."""
    at = line.find(text)
    if at < 0:
        return None
    rest = line[at:] if text.endswith("<") else line[at + len(text) :]
    if text.endswith("<"):
        if ">" not in rest:
            return None
        rest = rest.split(">", 1)[1]
    rest = rest.strip()
    name = rest.split("(", 1)[0].strip() if "(" in rest else ""
    return name if word(name) else None


def _dart_structure(line):
    name = None if line.startswith(("//", "/*")) else _declared_word(line, ["class", "abstract", "mixin", "enum", "extension"], ["<"])
    depth = (" extends " in line) + sum(len(after(line, w).split(",")) for w in (" implements ", " with ") if w in line)
    return name and (_kind(line, [("class", CLASS), ("abstract", CLASS), ("mixin", INTERFACE), ("enum", ENUM)], CLASS), name, PRIVATE if line.startswith("_") or " _" in line else PUBLIC, depth)


DART = Language(
    "dart", _dart, _dart_structure, Skipper(), ("try", "catch", "finally", "throw", "rethrow"), local=lambda x: has(x, "var ", "final ", "const ", "late ") and not has(x, "class ", "mixin "),
    also_ends=lambda x: "=>" in x and "{" not in x,
    property=lambda x, s: has(x, "final ", "var ", "const ", "late ", "static ") and not _dart_is_function(x) and not has(x, "class ", "mixin "),
    interface=lambda x, s: s.kind == INTERFACE and _dart_is_function(x), owner="last",
)

_OPEN = "()[]{}"


def _perl(line):
    if not line.startswith("sub "):
        return None
    name = up_to(first_word(line[4:]), "(", "{")
    text = inside(line, last=False)
    if text is None and line.find("(") < 0 or ")" not in line:
        count = int("@_" in line)
    else:
        count = arguments(text, _OPEN)
    return Declared(name, count) if word(name) else None


PERL = Language("perl", _perl, lambda x: None, Skipper(("#",), None), ("eval", "die", "warn"), local=lambda x: has(x, "my ", "our ", "local "))


def _r(line):
    if not has(line, "<-", "=") or "function(" not in line:
        return None
    for mark in ("<-", "="):
        if mark in line:
            name = line.split(mark, 1)[0].strip()
            if word(name, "_."):
                rest = after(line, "function(")
                return Declared(name, arguments(rest.split(")", 1)[0], _OPEN) if ")" in rest else 0)
    return None


R = Language(
    "r", _r, lambda x: None, Skipper(("#",), None), ("try(", "tryCatch(", "stop(", "warning("), local=lambda x: has(x, "<-", "=") and not has(x, "function(", "==", "!=", "<=", ">="), returns="return("
)


# ---- closing words ----------------------------------------------------------------------


def _is_end(line):
    return line == "end" or line.startswith("end ")


def _ruby_opens(line):
    return line.startswith(("def ", "class ", "module ")) or has(line, "if ", "while ", "for ", "case ", "begin ")


class Ruby:
    """Blocks open by words and close by ``end``; methods go to the structure named like the class being read."""

    def __init__(self):
        self.measures, self.declared = measures("ruby"), Memo(self.declares)

    @staticmethod
    def lines(lines):
        comment = False
        for i, raw in enumerate(lines):
            line = raw.strip()
            if line.startswith(("=begin", "=end")):
                comment = line.startswith("=begin")
            elif not comment and line and not line.startswith("#"):
                yield i, line

    @staticmethod
    def declares(line):
        if not line.startswith("def "):
            return None
        rest = line[4:].strip()
        name = up_to(rest, "(", " ")
        if not word(name, "_?!"):
            return None
        tail = line[4:]
        text = inside(tail, last=False)
        count = plain_arguments(text) if "(" in tail else max(0, len(tail.split()) - 1)
        return Declared(name, count, "self." not in line)

    @staticmethod
    def structure(line):
        if not line.startswith(("class", "module")):
            return None
        for w in ("class", "module"):
            rest = after(line, w)
            name = up_to(first_word(rest), "<") if rest else ""
            if word(name, "_:"):
                return CLASS if "class" in line else MODULE, name, PUBLIC, int("<" in line)
        return None

    def functions(self, lines):
        found, f, depth, nesting = [], None, 0, 0
        for i, line in self.lines(lines):
            declared = self.declared[line]
            if declared:
                f, depth, nesting = Function(declared.name, i + 1, i + 1, parameter_count=declared.parameters, is_method=declared.is_method), 0, 0
            if f is None:
                continue
            if _ruby_opens(line):
                depth, nesting = depth + 1, nesting + 1
            if _is_end(line):
                depth, nesting = depth - 1, max(0, nesting - 1)
            f.line_count, f.end_line = f.line_count + 1, i + 1
            f.nesting_depth = max(f.nesting_depth, nesting)
            branches, flat, deep = self.measures[line]
            f.cyclomatic += branches
            f.cognitive += flat + deep * max(nesting, 1)
            f.return_path_count += "return" in line
            f.has_recursion |= f.name in line and has(line, "(", " ")
            f.has_exception_handling |= has(line, "begin", "rescue", "ensure", "raise")
            f.local_variable_count += " = " in line and not has(line, "def ", "class ", "module ")
            if depth <= 0 and _is_end(line):
                found.append(f)
                f, nesting = None, 0
        return found

    def structures(self, lines):
        found, s, depth = [], None, 0
        for i, line in self.lines(lines):
            told = self.structure(line)
            if told:
                s, depth = Structure(told[1], told[0], i + 1, i + 1, inheritance_depth=told[3]), 0
            if s is None:
                continue
            depth += _ruby_opens(line) - _is_end(line)
            s.line_count, s.end_line = s.line_count + 1, i + 1
            s.properties += line.startswith("@") or (line[0].isupper() and " = " in line)
            s.properties += line.count(":") if has(line, "attr_reader", "attr_writer", "attr_accessor") else 0
            if depth <= 0 and _is_end(line):
                found.append(s)
                s = None
        current, depth = None, 0
        for line in map(str.strip, lines):
            told = self.structure(line)
            if told:
                current, depth = told[1], 0
            depth += line.startswith(("class ", "module "))
            if _is_end(line):
                depth -= 1
                current = current if depth > 0 else None
            if current and self.declared[line]:
                own = next((s for s in found if s.name == current), None)
                if own:
                    own.method_count += 1
        return found


class Erlang:
    """A function ends with a full stop before a blank line, a comment or a further declaration."""

    def __init__(self):
        self.measures, self.declared = measures("erlang"), Memo(self.declares)

    @staticmethod
    def declares(line):
        if not line or line.startswith(("%", "-")) or "->" not in line or "(" not in line:
            return None
        head = line.split("->", 1)[0].strip()
        name = up_to(head.split("(", 1)[0].strip(), " when ").strip() if "(" in head else ""
        return Declared(name, arguments(inside(line, last=False), _OPEN)) if word(name) else None

    @staticmethod
    def is_declaration(line):
        line = line.strip()
        return bool(line) and not line.startswith(("%", "-")) and "->" in line and "(" in line

    def functions(self, lines):
        found, f, nesting, stops = [], None, 0, 0
        for i, raw in enumerate(lines):
            line = raw.strip()
            if not line or line.startswith("%"):
                continue
            declared = self.declared[line]
            if declared:
                f, nesting, stops = Function(declared.name, i + 1, i + 1, parameter_count=declared.parameters), 0, 0
            if f is None:
                continue
            f.line_count, f.end_line = f.line_count + 1, i + 1
            nesting += has(line, "case ", "if ", "receive", "try ")
            nesting = max(0, nesting - ("end" in line))
            f.nesting_depth = max(f.nesting_depth, nesting)
            branches, flat, deep = self.measures[line]
            f.cyclomatic += branches
            f.cognitive += flat + deep * max(nesting, 1)
            f.return_path_count += "->" in line
            f.has_recursion |= f.name in line and "(" in line
            f.has_exception_handling |= has(line, "try", "catch", "throw", "exit", "error")
            f.local_variable_count += "=" in line and not has(line, "==", "=/=", "->")
            stops += line.endswith(".")
            follows = lines[i + 1].strip() if i + 1 < len(lines) else ""
            if stops and (not follows or follows.startswith("%") or self.is_declaration(follows)):
                found.append(f)
                f = None
        return found

    def structures(self, lines):
        module, behaviours = None, 0
        for i, line in enumerate(map(str.strip, lines)):
            if line.startswith("-module(") and line.endswith(").") and word(line[8:-2]):
                module = Structure(line[8:-2], CLASS, i + 1, i + 1)
            name = next((line[len(p) : -2] for p in ("-behaviour(", "-behavior(") if line.startswith(p) and line.endswith(").")), "")
            behaviours += word(name)
            if module and line.startswith("-") and not line.startswith(("-module(", "-behaviour(", "-behavior(")):
                module.properties += 1
        if module is None:
            return []
        module.end_line = module.line_count = len(lines)
        module.inheritance_depth = behaviours
        module.method_count = sum(self.declared[x.strip()] is not None for x in lines)
        return [module]


def _assigns(line):
    return "=" in line and not has(line, "==", "~=", "<=", ">=", "function ")


class Matlab:
    """A function ends at an ``end`` outside of its blocks; an unclosed one is dropped."""

    def __init__(self):
        self.measures, self.declared = measures("matlab"), Memo(self.declares)

    @staticmethod
    def declares(line):
        if not line.startswith("function "):
            return None
        rest = line[9:]
        if "=" in rest:
            rest = rest.split("=", 1)[1].strip()
            name = rest.split("(", 1)[0].strip() if "(" in rest else ""
        else:
            name = rest.split("(", 1)[0].strip() if "(" in rest else first_word(rest)
        return Declared(name, arguments(inside(line, last=False), _OPEN)) if word(name) else None

    def functions(self, lines):
        found, f, nesting, ended = [], None, 0, False
        for i, line in enumerate(map(str.strip, lines)):
            if not line or line.startswith("%"):
                continue
            declared = self.declared[line]
            if declared:
                f, nesting, ended = Function(declared.name, i + 1, i + 1, parameter_count=declared.parameters), 0, False
            if f is None:
                continue
            f.line_count, f.end_line = f.line_count + 1, i + 1
            nesting += has(line, "if ", "for ", "while ", "switch ", "try")
            if line == "end":
                ended = ended or nesting == 0
                nesting = max(0, nesting - 1)
            f.nesting_depth = max(f.nesting_depth, nesting)
            branches, flat, deep = self.measures[line]
            f.cyclomatic += branches
            f.cognitive += flat + deep * max(nesting, 1)
            f.return_path_count += "return" in line
            f.has_recursion |= f.name in line and "(" in line
            f.has_exception_handling |= has(line, "try", "catch", "error(", "warning(")
            f.local_variable_count += _assigns(line)
            if ended and nesting == 0:
                found.append(f)
                f = None
        return found

    def structures(self, lines):
        s, assigned, is_class = Structure("MATLAB_Script", CLASS, 1, len(lines), len(lines)), 0, False
        for line in map(str.strip, lines):
            if not line or line.startswith("%"):
                continue
            if line.startswith("classdef "):
                is_class = True
                s.name = first_word(line[9:]) or "UnknownClass"
            assigned += _assigns(line) and not is_class
            s.properties += is_class and line.startswith("properties")
            s.method_count += self.declared[line] is not None
        if not is_class:
            s.properties = assigned
        return [s]


# ---- search ahead -----------------------------------------------------------------------


def _bracketed(line):
    return plain_arguments(inside(line, last=False))


def _lua(line):
    line = line.strip()
    if not line or line.startswith("--"):
        return None
    rest = after(line, "function ")
    if rest is not None:
        name = up_to(rest, "(").strip()
        if word(name, "_.:"):
            return name
    if "=" in line:
        head, tail = line.split("=", 1)
        if tail.strip().startswith("function"):
            name = (head.split() or [""])[-1]
            if word(name, "_.:"):
                return name
    return None


def _lua_structure(line):
    line = line.strip()
    if "=" in line:
        head, tail = line.split("=", 1)
        names = head.split()
        if tail.strip().startswith("{") and names and word(names[-1], "_."):
            return names[-1]
    rest = after(line, "module(")
    if rest is not None and ")" in rest:
        return rest.split(")", 1)[0].strip().strip('"').strip("'") or None
    return None


LUA = Ahead(
    "lua", _lua, word_end(("function",), 1, ("function", "do", "if", "for", "while", "repeat"), until=("until",)), _bracketed, _lua_structure, table_end,
    lambda x: MODULE if "module(" in x else CLASS, lambda span: sum("=" in x and "function" not in x and not x.startswith("--") for x in map(str.strip, span)),
)


def _zig(line):
    line = line.strip()
    rest = None if line.startswith("//") else after(line, "fn ")
    name = up_to(rest, "(").strip() if rest else ""
    return name if word(name) else None


def _zig_structure(line):
    line = line.strip()
    if "=" in line:
        head, tail = line.split("=", 1)
        names = head.split()
        if tail.strip().startswith(("struct", "union", "enum", "packed struct")) and names and word(names[-1]):
            return names[-1]
    if "pub const" in line and has(line, "= struct", "= union", "= enum"):
        rest = after(line, "const ")
        name = rest.split("=", 1)[0].strip() if rest and "=" in rest else ""
        return name if word(name) else None
    return None


ZIG = Ahead(
    "zig", _zig, bracket_end(("fn ",), "{", "}", True), _bracketed, _zig_structure, bracket_end(("= struct", "= union", "= enum"), "{", "}", True),
    lambda x: STRUCT if has(x, "= struct", "= packed struct", "= union") else ENUM if "= enum" in x else CLASS,
    lambda span: sum(":" in x and not has(x, "fn", "if", "for") and not x.startswith("//") for x in map(str.strip, span)), lambda x: PUBLIC if "pub" in x else PRIVATE,
)


def _elixir(line):
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    rest = after(line, "def ")
    rest = after(line, "defp ") if rest is None else rest
    if rest is not None:
        name = up_to(rest.strip(), "(", ",", " do", " when").strip()
        if word(name, "_?!"):
            return name
    return "anonymous" if "fn " in line else None


def _elixir_parameters(line):
    if 0 <= line.find("(") < line.find(")"):
        return _bracketed(line)
    rest = after(line, "def ")
    rest = after(line, "defp ") if rest is None else rest
    return 0 if rest is None else plain_arguments(up_to(rest, " do", " when"))


def _elixir_structure(line):
    line = line.strip()
    for w in ("defmodule ", None, "defprotocol "):
        if w is None:
            if "defstruct " in line:
                return "struct"
            continue
        rest = after(line, w)
        name = first_word(rest) if rest else ""
        if word(name, "_."):
            return name
    return None


def _elixir_fields(span):
    count = 0
    for line in span:
        text = inside(line, False, "[", "]") if "defstruct " in line else None
        count += len(text.split(",")) if text is not None else 0
        count += line.strip().startswith("@")
    return count


ELIXIR = Ahead(
    "elixir", _elixir, word_end(("def ", "defp "), 0, (" do",), lambda x, depth: ", do:" in x and depth == 0), _elixir_parameters, _elixir_structure,
    word_end(("defmodule ", "defprotocol "), 0, (" do",)), lambda x: _kind(x, [("defmodule ", MODULE), ("defprotocol ", INTERFACE), ("defstruct ", STRUCT)], CLASS), _elixir_fields, owns_methods=True,
)


def _julia(line):
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    rest = after(line, "function ")
    if rest is not None:
        name = up_to(rest, "(", "{", " ").strip()
        if word(name, "_!?"):
            return name
    if "=" in line:
        head = line.split("=", 1)[0].strip()
        name = head.split("(", 1)[0].strip() if "(" in head else ""
        if word(name, "_!?"):
            return name
    return "anonymous" if has(line, "->", "function(") else None


_JULIA_OPENS = ("begin", "let", "for", "while", "if", "try")


def _julia_fields(span):
    kept = (x for x in map(str.strip, span) if x and not x.startswith(("function", "#")) and not has(x, "struct", "end"))
    return sum("::" in x or (":" in x and "if" not in x) for x in kept)


JULIA = Ahead(
    "julia", _julia, word_end(("function ",), 1, _JULIA_OPENS, lambda x, depth: "=" in x and "function" not in x and depth == 1), _bracketed,
    lambda x: _declared_word(x.strip(), ["struct", "mutable struct", "abstract type", "primitive type", "module"], ["{", "<"]),
    word_end(("struct ", "module ", "abstract type ", "primitive type "), 1, _JULIA_OPENS),
    lambda x: _kind(x, [("module ", MODULE), ("struct ", STRUCT), ("abstract type ", INTERFACE), ("primitive type ", STRUCT)], CLASS), _julia_fields,
)

_LISP_NAME = "-_?!*+"


def _clojure(line):
    line = line.strip()
    if not line or line.startswith(";"):
        return None
    rest = after(line, "(defn ")
    rest = after(line, "(defn- ") if rest is None else rest
    if rest is not None and word(first_word(rest), _LISP_NAME):
        return first_word(rest)
    rest = after(line, "(def ")
    if rest is not None and "(fn" in rest and word(first_word(rest), _LISP_NAME):
        return first_word(rest)
    return "anonymous" if "(fn " in line else None


def _clojure_structure(line):
    for w, extra in (("(ns ", "-_."), ("(defprotocol ", "-_"), ("(defrecord ", "-_"), ("(deftype ", "-_")):
        rest = after(line.strip(), w)
        name = first_word(rest) if rest else ""
        if word(name, extra):
            return name
    return None


def _square(line):
    text = inside(line, False, "[", "]")
    return len(text.split()) if text else 0


CLOJURE = Ahead(
    "clojure", _clojure, bracket_end(("(defn ", "(defn- ", "(def "), "(", ")", False), _square, _clojure_structure,
    bracket_end(("(ns ", "(defprotocol ", "(defrecord ", "(deftype "), "(", ")", False), lambda x: MODULE if "(ns " in x else INTERFACE if "(defprotocol " in x else CLASS,
    lambda span: sum(_square(x) for x in span if has(x, "defrecord", "deftype")),
)


def _haskell(line):
    line = line.strip()
    if not line or line.startswith("--"):
        return None
    if "::" in line:
        name = line.split("::", 1)[0].strip()
    else:
        name = first_word(line.split("=", 1)[0]) if "=" in line else ""
    if word(name, "_'") and name[0].islower():
        return name
    return "lambda" if "\\" in line and "->" in line else None


def _haskell_parameters(line):
    if "::" in line:
        return line.split("::")[1].count("->")
    return max(0, len(line.split("=", 1)[0].split()) - 1) if "=" in line else 0


def _haskell_structure(line):
    for w, extra in (("module ", "_."), ("data ", "_'"), ("newtype ", "_'"), ("type ", "_'"), ("class ", "_'")):
        rest = after(line.strip(), w)
        name = first_word(rest) if rest else ""
        if word(name, extra) and name[0].isupper():
            return name
    return None


def _haskell_fields(span):
    count = 0
    for line in span:
        count += line.count("::") if "data " in line else 0
        text = inside(line, False, "{", "}")
        count += text.count(",") + 1 if text is not None else 0
    return count


HASKELL = Ahead(
    "haskell", _haskell, indent_end(("::", "=")), _haskell_parameters, _haskell_structure, indent_end(("data ", "newtype ", "type ", "class ", "module ")),
    lambda x: _kind(x, [("module ", MODULE), ("data ", CLASS), ("type ", STRUCT), ("class ", INTERFACE)], CLASS), _haskell_fields,
)


# ---- whole-file structures --------------------------------------------------------------


def _perl_structures(lines: list[str]) -> list[Structure]:
    """Packages; the last one runs to the end of the file and gets all functions. Without one, ``main``."""
    found = []
    for i, line in enumerate(map(str.strip, lines)):
        if not line or line.startswith("#"):
            continue
        name = first_word(line[8:-1]) if line.startswith("package ") and line.endswith(";") else ""
        if word(name, "_:"):
            found.append(Structure(name, CLASS, i + 1, i + 1))
        if found and has(line, "our ", "use vars") and not line.startswith("sub "):
            found[-1].properties += 1
    methods = sum(PERL.told[x.strip()].declared is not None for x in lines)
    if not found:
        return [Structure("main", CLASS, 1, len(lines), len(lines), methods)]
    last = found[-1]
    last.end_line, last.line_count, last.method_count = len(lines), len(lines) - last.start_line + 1, methods
    return found


def _r_structures(lines: list[str]) -> list[Structure]:
    """One for the whole script, with its assignments and functions."""
    s = Structure("R_Script", CLASS, 1, len(lines), len(lines))
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            s.properties += has(line, "<-", "=") and not has(line, "function(", "==", "!=", "<=", ">=")
            s.method_count += R.told[line].declared is not None
    return [s]


_ruby, _erlang, _matlab = Ruby(), Erlang(), Matlab()
ANALYZERS = {
    "rust": (partial(strict_functions, RUST, own="self", opener="fn "), partial(strict_structures, RUST)),
    "javascript": (partial(strict_functions, JAVASCRIPT, own="this", opener="function "), partial(strict_structures, JAVASCRIPT)),
    "python": (partial(indented_functions, PYTHON), partial(indented_structures, PYTHON)),
    **{x.name: (partial(loose_functions, x), partial(loose_structures, x)) for x in (JAVA, CPP, GO, CSHARP, PHP, SWIFT, KOTLIN, DART)},
    "perl": (partial(loose_functions, PERL), _perl_structures),
    "r": (partial(loose_functions, R), _r_structures),
    "ruby": (_ruby.functions, _ruby.structures),
    "erlang": (_erlang.functions, _erlang.structures),
    "matlab": (_matlab.functions, _matlab.structures),
    **{x.name: (x.functions, x.structures) for x in (LUA, ZIG, ELIXIR, JULIA, CLOJURE, HASKELL)},
}


def analyze(content: bytes | None, extension: str, with_structures: bool = True) -> tuple[list[Function], list[Structure]]:
    """Functions and structures (if asked for) of a file; none for other extensions and for bytes that aren't UTF-8 (which have no lines)."""
    language = EXTENSIONS.get(extension)
    if language is None or content is None:
        return [], []
    try:
        lines = split_lines(content.decode())
    except UnicodeDecodeError:
        lines = []
    functions, structures = ANALYZERS[language]
    return functions(lines), structures(lines) if with_structures else []
