"""What counts in a line, by language: fixed values.

``BRANCHES`` are counted by substring, each on its own, for the cyclomatic number.  ``WEIGHTS``
are the rules of the cognitive number: (kind, texts, weight) or (kind, texts, weight, unless).
``any``: one of the texts occurs; ``all``: all do; ``each``: every occurrence counts.  A weight
"n" is the nesting, at least one.  Languages without weights use the cyclomatic number.
"""

from __future__ import annotations

N = "n"


def _any(*texts, w=N, unless=()):
    return ("any", texts, w, unless)


def _each(*texts, w=N):
    return [("each", (t,), w, ()) for t in texts]


def _all(*texts, w=1):
    return ("all", texts, w, ())


_ELSE = _any("else", w=1, unless=("else if",))

BRANCHES: dict[str, list[str]] = {
    "rust": ["if", "else if", "match", "while", "for", "loop", "&&", "||", "?"],
    "python": ["if", "elif", "while", "for", "and", "or", "except", "finally"],
    "javascript": ["if", "else if", "while", "for", "switch", "case", "catch", "finally", "&&", "||", "?"],
    "java": ["if", "else if", "while", "for", "do", "switch", "case", "catch", "&&", "||", "?"],
    "cpp": ["if", "else if", "while", "for", "do", "switch", "case", "catch", "&&", "||", "?"],
    "go": ["if", "else if", "for", "switch", "case", "select", "&&", "||", "go ", "defer"],
    "csharp": ["if", "else if", "for", "foreach", "while", "do", "switch", "case", "&&", "||", "?", "catch", "finally", "try", "throw", "using", "lock"],
    "php": ["if", "elseif", "else", "for", "foreach", "while", "do", "switch", "case", "&&", "||", "and", "or", "xor", "?", "catch", "finally", "try", "throw"],
    "ruby": ["if", "elsif", "else", "unless", "for", "while", "until", "case", "when", "&&", "||", "and", "or", "not", "?", "rescue", "ensure", "raise", "begin"],
    "swift": ["if", "else if", "else", "for", "while", "repeat", "switch", "case", "default", "&&", "||", "?", "catch", "try", "throw", "guard", "defer"],
    "kotlin": ["if", "else", "when", "for", "while", "do", "try", "catch", "finally", "&&", "||", "?:", "?.", "!!", "elvis", "safe", "throw", "suspend"],
    "dart": ["if", "else", "for", "while", "do", "switch", "case", "default", "try", "catch", "finally", "throw", "rethrow", "assert", "&&", "||", "?", "??", "?..", "await", "async", "sync*", "async*"],
    "erlang": ["if", "case", "receive", "try", "catch", "after", "when", "andalso", "orelse", "not", "and", "or", "xor", "throw", "exit", "error", "spawn", "spawn_link", "spawn_monitor"],
    "perl": ["if", "elsif", "else", "unless", "for", "foreach", "while", "until", "do", "given", "when", "default", "&&", "||", "and", "or", "not", "xor", "eval", "die", "warn", "next", "last", "redo", "goto"],
    "r": ["if", "else", "for", "while", "repeat", "switch", "ifelse", "&", "|", "&&", "||", "!", "any", "all", "which", "try", "tryCatch", "stop", "warning", "next", "break"],
    "matlab": ["if", "elseif", "else", "for", "while", "switch", "case", "otherwise", "&", "|", "&&", "||", "~", "any", "all", "find", "try", "catch", "error", "warning", "break", "continue", "return"],
    "elixir": ["if", "unless", "cond", "case", "when", "for", "while", "until", "&&", "||", "and", "or", "not", "try", "rescue", "catch", "after", "receive", "with", "else", "->", "|>", "spawn", "send"],
    "julia": ["if", "elseif", "else", "for", "while", "try", "catch", "finally", "&&", "||", "!", "?", ":", "begin", "let", "do", "break", "continue", "return", "throw", "rethrow"],
    "lua": ["if", "elseif", "else", "for", "while", "repeat", "until", "and", "or", "not", "break", "return", "goto", "pcall", "xpcall", "error", "assert"],
    "zig": ["if", "else", "for", "while", "switch", "and", "or", "orelse", "catch", "try", "defer", "errdefer", "break", "continue", "return", "unreachable"],
    "clojure": ["if", "if-not", "when", "when-not", "cond", "condp", "case", "and", "or", "not", "try", "catch", "finally", "throw", "loop", "recur", "for", "doseq", "dotimes", "while", "when-let", "if-let", "some->", "some->>", "->", "->>"],
    "haskell": ["if", "then", "else", "case", "of", "let", "in", "where", "do", "guard", " | ", "| ", "&&", "||", "not", "otherwise", "maybe", "either", "catch", "try", "throw", "error"],
}

WEIGHTS: dict[str, list[tuple]] = {
    "rust": [_any("if"), _any("else", w=1), _any("match"), _any("while"), _any("for"), _any("loop"), *_each("&&", "||"), _all("self.", "(")],
    "python": [
        _any("if "), _any("elif ", w=1), _any("else:", w=1), _any("while "), _any("for "), _any("try:"), _any("except", w=1), _any("finally", w=1), *_each(" and ", " or "),
        _all(" for ", ("[", "{")),
    ],
    "javascript": [
        _any("if"), _any("else", w=1), _any("while"), _any("for"), _any("switch"), _any("case", w=1), _any("catch", w=1), _any("finally", w=1), *_each("&&", "||", "?"), _any("()", w=1),
    ],
    "java": [
        _any("if "), _any("else if", w=1), _ELSE, _any("while "), _any("for "), _any("do "), _any("switch "), _any("case ", w=1), _any("catch "), _any("finally", w=1), *_each("&&", "||", "?"),
        _any("->", w=1),
    ],
    "cpp": [
        _any("if ", "if("), _any("else if", w=1), _ELSE, _any("while ", "while("), _any("for ", "for("), _any("do "), _any("switch ", "switch("), _any("case ", w=1), _any("catch ", "catch("),
        *_each("&&", "||", "?"), _any("goto ", w="2n"),
    ],
    "go": [
        _any("if "), _any("else if", w=1), _ELSE, _any("for "), _any("switch "), _any("case ", w=1), _any("select "), *_each("&&", "||"), _any("go ", w=1), _any("defer ", w=1), _any("panic(", w=2),
        _any("recover(", w=1), _any("<-", w=1),
    ],
    "csharp": [
        _any("if "), _any("else if", w=1), _ELSE, _any("for "), _any("foreach "), _any("while "), _any("do "), _any("switch "), _any("case ", w=1), *_each("&&", "||", "?"), _any("try "),
        _any("catch "), _any("finally ", w=1), _any("throw ", w=1), _any("async ", w=1), _any("await ", w=1), _any("yield ", w=2), _any("lock "), _all("using ", "("),
        _any(".Where(", ".Select(", ".Any(", ".All(", ".First(", ".Last(", w=1),
    ],
    "php": [
        _any("if "), _any("elseif ", w=1), _any("else", w=1, unless=("elseif",)), _any("for "), _any("foreach "), _any("while "), _any("do "), _any("switch "), _any("case ", w=1),
        *_each("&&", "||", " and ", " or ", " xor ", "?"), _any("try "), _any("catch "), _any("finally ", w=1), _any("throw ", w=1), _any("include ", "require ", w=1),
        _any("include_once ", "require_once ", w=1), _any("eval(", w=3), _any("goto ", w=2), _any("__construct", "__destruct", "__call", "__get", "__set", w=1),
    ],
    "ruby": [
        _any("if ", "if("), _any("elsif ", w=1), _any("else", w=1, unless=("elsif",)), _any("unless "), _any("for "), _any("while "), _any("until "), _any("case "), _any("when ", w=1),
        *_each("&&", "||", " and ", " or ", " not ", "?"), _any("begin "), _any("rescue "), _any("ensure ", w=1), _any("raise ", w=1), _any("yield", w=1), _any(".each", ".map", ".select", w=1),
        _any("lambda", "proc", "->", w=1), _any("eval", w=3), _any("define_method", "method_missing", w=2), _any("class_eval", "instance_eval", "module_eval", w=2),
    ],
    "swift": [
        _any("if "), _any("else if", w=1), _ELSE, _any("for "), _any("while "), _any("repeat "), _any("switch "), _any("case ", w=1), _any("default", w=1), *_each("&&", "||", "?"), _any("try ", w=1),
        _any("catch "), _any("throw ", w=1), _any("guard "), _any("defer ", w=1), _any("async ", w=1), _any("await ", w=1), *_each("??", "?.", "!.", w=1), _any("{ ", " in ", w=1),
    ],
    "kotlin": [
        _any("if ", "if("), _any("else if", w=1), _ELSE, _any("when ", "when("), _any("for ", "for("), _any("while ", "while("), _any("do "), _any("->", w=1, unless=("lambda",)), *_each("&&", "||"),
        *_each("?:", "?.", "!!", w=1), _any("try ", w=1), _any("catch "), _any("finally ", w=1), _any("throw ", w=1), _any("suspend ", w=1), _any("async ", w=1), _any("await ", w=1),
        _any("launch ", w=1), _any("runBlocking ", w=1), _any("{ ", " -> ", w=1), _any(".let ", ".apply ", ".run ", ".with ", ".also ", w=1), _any(".map ", ".filter ", ".reduce ", ".fold ", w=1),
    ],
    "dart": [
        _any("if ", "if("), _any("else if", w=1), _ELSE, _any("for ", "for("), _any("while ", "while("), _any("do "), _any("switch ", "switch("), _any("case ", w=1), _any("default:", w=1),
        *_each("&&", "||"), *_each("??", "?.", "?..", "?", w=1), _any("try ", w=1), _any("catch "), _any("finally ", w=1), _any("throw ", w=1), _any("rethrow", w=1), _any("async ", w=1),
        _any("await ", w=1), _any("sync*", w=1), _any("async*", w=1), _any("Stream<", w=1), _any("Future<", w=1), _any(".listen(", w=1), _any(".then(", w=1), _any(".catchError(", w=1),
        _any("Widget", "StatefulWidget", "StatelessWidget", w=1), _any("build(", w=1), _any("setState(", w=1), _any(".map(", ".where(", ".reduce(", ".fold(", w=1),
    ],
    "erlang": [
        _any("if "), _any("case "), _any("receive"), _any("try "), _any("catch "), _any("after ", w=1), _any("->", w=1, unless=("fun",)), _any(" when "),
        *_each("andalso", "orelse", " and ", " or ", " xor "), _any("throw ", w=1), _any("exit(", w=1), _any("error(", w=1), _any("spawn(", w=1), _any("spawn_link(", w=1),
        _any("spawn_monitor(", w=1), _any("!", w=1), _all("||", "["), _all("<=", "<<"), _any("fun ", w=1),
    ],
    "perl": [
        _any("if ", "if("), _any("elsif ", w=1), _any("else", w=1, unless=("elsif",)), _any("unless "), _any("for ", "for("), _any("foreach "), _any("while ", "while("), _any("until "), _any("do "),
        _any("given "), _any("when ", w=1), _any("default", w=1), *_each("&&", "||", " and ", " or ", " not ", " xor "), _any("eval ", w=1), _any("die ", w=1), _any("warn ", w=1), _any("next", w=1),
        _any("last", w=1), _any("redo", w=1), _any("goto", w=1), _any("=~", "!~", w=1), _any("m/", "s/", "tr/", w=1), _any("\\", w=1, unless=("\\n", "\\t")), _all("$", "->"),
        _any("@{", "%{", "${", w=1), _any("map ", "grep ", w=1), _any("sort ", w=1),
    ],
    "r": [
        _any("if ", "if("), _any("else", w=1), _any("for ", "for("), _any("while ", "while("), _any("repeat"), _any("switch("), _any("ifelse(", w=1), *_each("&&", "||"), *_each("&", "|", w=1),
        _any("try(", w=1), _any("tryCatch("), _any("stop(", w=1), _any("warning(", w=1), _any("next", w=1), _any("break", w=1), _any("apply(", "lapply(", "sapply(", "mapply(", w=1),
        _any("subset(", w=1), _any("merge(", w=1), _any("aggregate(", w=1), _any("lm(", "glm(", "aov(", "t.test(", w=1), _any("[[", "$", w=1),
    ],
    "matlab": [
        _any("if ", "if("), _any("elseif ", w=1), _any("else", w=1, unless=("elseif",)), _any("for ", "for("), _any("while ", "while("), _any("switch "), _any("case ", w=1), _any("otherwise", w=1),
        *_each("&&", "||"), *_each("&", "|", w=1), _any("try", w=1), _any("catch"), _any("error(", w=1), _any("warning(", w=1), _any("break", w=1), _any("continue", w=1), _any("return", w=1),
        _any("cellfun(", "arrayfun(", "structfun(", w=1), _any("*", ".*", "\\", "./", w=1), _any("(:", ":,", "end", w=1), _any("@", w=1),
    ],
}


def cyclomatic(language: str, line: str) -> int:
    return sum(map(line.count, BRANCHES[language]))


def has(line: str, *texts: str) -> bool:
    for t in texts:  # a loop, as a generator costs more than the search
        if t in line:
            return True
    return False


def cognitive_parts(language: str, line: str) -> tuple[int, int]:
    """What a line adds whatever its nesting is, and what it adds for each level."""
    flat = deep = 0
    for kind, texts, weight, unless in WEIGHTS[language]:
        if kind == "each":
            n = line.count(texts[0])
        elif kind == "any":
            n = has(line, *texts) and not has(line, *unless)
        else:
            n = all(has(line, *t) if isinstance(t, tuple) else t in line for t in texts)
        if not n:
            continue
        if weight == N:
            deep += n
        elif weight == "2n":
            deep += 2 * n
        else:
            flat += n * weight
    return flat, deep


def cognitive(language: str, line: str, nesting: int) -> int:
    flat, deep = cognitive_parts(language, line)
    return flat + deep * max(nesting, 1)


class Memo(dict):
    """What a function of one line alone told of lines up to ``LONGEST``; emptied when ``MOST`` are held, so its size is bounded."""

    MOST, LONGEST = 16_384, 200

    def __init__(self, tell):
        super().__init__()
        self.tell = tell

    def __missing__(self, line: str):
        told = self.tell(line)
        if len(line) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[line] = told
        return told


def measures(language: str) -> Memo:
    """Line -> (cyclomatic, flat and deep part of the cognitive number)."""
    return Memo(lambda line: (cyclomatic(language, line), *cognitive_parts(language, line)))


#: Extension -> language.
EXTENSIONS = {
    ext: language
    for language, exts in {
        "rust": "rs", "python": "py", "javascript": "js jsx ts tsx", "java": "java", "cpp": "cpp cc cxx c h hpp", "go": "go", "csharp": "cs", "php": "php", "ruby": "rb", "swift": "swift",
        "kotlin": "kt", "dart": "dart", "erlang": "erl hrl", "perl": "pl pm", "r": "r", "matlab": "m mlx", "elixir": "ex exs", "julia": "jl", "lua": "lua", "zig": "zig",
        "clojure": "clj cljs cljc edn", "haskell": "hs lhs",
    }.items()
    for ext in exts.split()
}
