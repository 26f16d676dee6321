"""Lookup tables of the analyzer, as data.

Everything here is a fixed value: marker tokens, names, patterns and thresholds that decide
results.  Functions and operators take them from here and hold none of their own.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Syntax:
    """Comment markers of a format. ``starts[i]`` is closed by ``ends[i]``, or by itself where no end is given."""

    line: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    doc: tuple[str, ...] = ()

    @property
    def blocks(self) -> tuple[tuple[str, str], ...]:
        return tuple((s, self.ends[i] if i < len(self.ends) else s) for i, s in enumerate(self.starts))


# Comment markers, then the keys (lower-case extensions or file names) that use them.
_C = Syntax(("//",), ("/*",), ("*/",), ("/**", "/*!"))
_JS = Syntax(("//",), ("/*",), ("*/",), ("/**", "//!"))
_JAVADOC = Syntax(("//",), ("/*",), ("*/",), ("/**",))
_TRIPLE_SLASH = Syntax(("//",), ("/*",), ("*/",), ("///", "/**"))
_HASH = Syntax(("#",), doc=("##",))
_XML = Syntax((), ("<!--",), ("-->",))
_FSHARP = Syntax(("//",), ("(*",), ("*)",), ("///", "(**"))
_PERL = Syntax(("#",), ("=pod",), ("=cut",), ("=pod",))
_PYTHON = Syntax(("#",), ('"""', "'''"), ('"""', "'''"), ('"""', "'''"))
_RUBY = Syntax(("#",), ("=begin",), ("=end",), ("##",))
_WEB = Syntax(("//",), ("<!--", "/*"), ("-->", "*/"), ("/**",))
_POWERSHELL = Syntax(("#",), ("<#",), ("#>",), ("<#",))
_PERCENT = Syntax(("%",), doc=("%%",))

SYNTAXES: list[tuple[str, Syntax]] = [
    ("rs", Syntax(("//",), ("/*",), ("*/",), ("///", "//!", "/**"))),
    ("js ts jsx tsx mjs cjs mts cts", _JS),
    ("py pyi", _PYTHON),
    ("java kt kts scala groovy mm less proto gradle jenkinsfile", _JAVADOC),
    ("c cpp cc cxx h hpp hxx", _C),
    ("cs swift dart", _TRIPLE_SLASH),
    ("php", Syntax(("//", "#"), ("/*",), ("*/",), ("/**",))),
    ("rb rake", _RUBY),
    ("go", Syntax(("//",), ("/*",), ("*/",), ("//",))),
    ("sh bash zsh fish yaml yml toml tf nix", _HASH),
    ("ini", Syntax((";", "#"), doc=(";;",))),
    ("json jsonc", Syntax(("//",), ("/*",), ("*/",))),
    ("xml html htm", _XML),
    ("css", Syntax((), ("/*",), ("*/",), ("/**",))),
    ("scss", Syntax(("//",), ("/*",), ("*/",), ("/**", "///"))),
    ("sass", Syntax(("//",), doc=("///",))),
    ("vue svelte", _WEB),
    ("md markdown", _XML),
    ("rst", Syntax(("..",))),
    ("adoc asciidoc", Syntax(("//",), ("////",), ("////",))),
    ("hs lhs", Syntax(("--",), ("{-",), ("-}",), ("-- |", "-- ^"))),
    ("elm", Syntax(("--",), ("{-",), ("-}",), ("{-|",))),
    ("ml mli", Syntax((), ("(*",), ("*)",), ("(**",))),
    ("fs fsx fsi", _FSHARP),
    ("clj cljs cljc", Syntax((";",), ("#_",), (), (";;",))),
    ("erl hrl", _PERCENT),
    ("ex exs", Syntax(("#",), doc=("@doc", "@moduledoc"))),
    ("jl", Syntax(("#",), ("#=",), ("=#",), ('"""',))),
    ("r", Syntax(("#",), doc=("#'",))),
    ("rmd", Syntax(("#",), ("<!--",), ("-->",))),
    ("m mlx", Syntax(("%",), ("%{",), ("%}",), ("%%",))),
    ("lua", Syntax(("--",), ("--[[",), ("]]",), ("---",))),
    ("pl pm pod", _PERL),
    ("ps1 psm1", _POWERSHELL),
    ("bat cmd", Syntax(("REM", "rem", "::"), doc=("REM",))),
    ("sql", Syntax(("--",), ("/*",), ("*/",), ("--",))),
    ("zig", Syntax(("//",), doc=("///", "//!"))),
    (
        "dockerfile containerfile makefile gnumakefile justfile rakefile gemfile podfile brewfile procfile vagrantfile "
        "berksfile fastfile appfile dockerignore gitignore gitattributes gitmodules npmignore prettierignore "
        "eslintignore codeowners editorconfig",
        _HASH,
    ),
    ("readme changelog contributing", _XML),
]
SYNTAX: dict[str, Syntax] = {key: syntax for keys, syntax in SYNTAXES for key in keys.split()}

# Formats whose ordinary lines are prose.
PROSE = ("md", "markdown", "rst", "adoc", "asciidoc", "readme", "changelog", "contributing")

# Interpreter of a "#!" line -> key.
SHEBANGS = {
    "sh": "sh", "bash": "sh", "dash": "sh", "ksh": "sh", "ash": "sh", "zsh": "zsh", "fish": "fish", "python": "py", "python-": "py",
    "node": "js", "deno": "js", "bun": "js", "ruby": "rb", "perl": "pl", "php": "php", "lua": "lua", "Rscript": "r", "pwsh": "ps1",
    "powershell": "ps1", "tclsh": "sh", "wish": "sh",
}

# Category -> language -> keys.
LANGUAGES: list[tuple[str, str, str]] = [
    ("code", "Rust", "rs"), ("code", "Go", "go"), ("code", "Zig", "zig"), ("code", "C", "c"), ("code", "C/C++ Header", "h"),
    ("code", "C++", "cpp cc cxx"), ("code", "C++ Header", "hpp hxx"), ("code", "Objective-C++", "mm"), ("code", "Swift", "swift"),
    ("code", "Dart", "dart"), ("code", "Python", "py"), ("code", "Python Stubs", "pyi"),
    ("code", "Ruby", "rb rake rakefile vagrantfile fastfile appfile berksfile"), ("code", "PHP", "php"), ("code", "Perl", "pl pm pod"),
    ("code", "Lua", "lua"), ("code", "Julia", "jl"), ("code", "R", "r"), ("code", "R Markdown", "rmd"), ("code", "MATLAB", "m mlx"),
    ("code", "JavaScript", "js mjs cjs"), ("code", "JavaScript (React)", "jsx"), ("code", "TypeScript", "ts mts cts"),
    ("code", "TypeScript (React)", "tsx"), ("code", "Vue", "vue"), ("code", "Svelte", "svelte"), ("code", "HTML", "html htm"),
    ("code", "CSS", "css"), ("code", "Sass", "scss sass"), ("code", "Less", "less"), ("code", "Textual CSS", "tcss"),
    ("code", "Java", "java"), ("code", "Kotlin", "kt kts"), ("code", "Scala", "scala"), ("code", "Groovy", "groovy"),
    ("code", "Gradle", "gradle"), ("code", "C#", "cs"), ("code", "F#", "fs fsx fsi"), ("code", "Haskell", "hs lhs"), ("code", "Elm", "elm"),
    ("code", "OCaml", "ml mli"), ("code", "Clojure", "clj cljs cljc"), ("code", "Scheme", "scm ss"), ("code", "Racket", "rkt"),
    ("code", "Lisp", "lisp"), ("code", "Emacs Lisp", "el"), ("code", "Erlang", "erl hrl"), ("code", "Elixir", "ex exs"),
    ("code", "Shell", "sh bash zsh"), ("code", "Fish", "fish"), ("code", "PowerShell", "ps1 psm1"), ("code", "Batch", "bat cmd"),
    ("code", "SQL", "sql"), ("code", "Protocol Buffers", "proto"), ("code", "Cap'n Proto", "capnp"), ("code", "Thrift", "thrift"),
    ("code", "GraphQL", "graphql gql"), ("code", "Rego", "rego"), ("code", "Cedar", "cedar cedarschema"), ("code", "CUE", "cue"),
    ("code", "Terraform", "tf"), ("code", "Nix", "nix"), ("code", "Makefile", "mk makefile gnumakefile"), ("code", "Justfile", "justfile"),
    ("code", "Dockerfile", "dockerfile containerfile"), ("code", "Jenkinsfile", "jenkinsfile"), ("code", "Jinja", "j2 jinja jinja2"),
    ("code", "Go Template", "tpl gotmpl"), ("code", "Handlebars", "hbs"), ("code", "EJS", "ejs"), ("code", "ERB", "erb"),
    ("code", "Mustache", "mustache"),
    ("config", "TOML", "toml"), ("config", "YAML", "yaml yml"), ("config", "INI", "ini cfg"), ("config", "Config", "conf"),
    ("config", "Properties", "properties"), ("config", "JSON5", "json5"), ("config", "JSON with Comments", "jsonc"), ("config", "HCL", "hcl"),
    ("config", "Terraform Vars", "tfvars"), ("config", "Property List", "plist entitlements xcprivacy"),
    ("config", "Xcode Test Plan", "xctestplan"), ("config", "Zig Object Notation", "zon"), ("config", "systemd Unit", "service"),
    ("config", "EditorConfig", "editorconfig"), ("config", "Git Config", "gitignore gitattributes gitmodules"),
    ("config", "Ignore Rules", "dockerignore npmignore prettierignore eslintignore"), ("config", "Code Owners", "codeowners"),
    ("config", "Brewfile", "brewfile"), ("config", "Gemfile", "gemfile"), ("config", "Podfile", "podfile"), ("config", "Procfile", "procfile"),
    ("config", "Environment", "env"),
    ("data", "JSON", "json"), ("data", "JSON Lines", "jsonl ndjson"), ("data", "CSV", "csv"), ("data", "TSV", "tsv"), ("data", "XML", "xml"),
    ("data", "Checksums", "sum"), ("data", "Lockfile", "lock"), ("data", "Dictionary", "dic dict"),
    ("docs", "Markdown", "md markdown mdc readme changelog contributing"), ("docs", "MDX", "mdx"), ("docs", "reStructuredText", "rst"),
    ("docs", "AsciiDoc", "adoc asciidoc"), ("docs", "Plain Text", "txt"), ("docs", "LaTeX", "tex"),
]
LANGUAGE_OF: dict[str, tuple[str, str]] = {key: (language, category) for category, language, keys in LANGUAGES for key in keys.split()}
NO_EXTENSION = "no_ext"
NO_EXTENSION_NAME = "Other (no extension)"

# Extensions of formats that aren't lines of text.
BINARY_EXTENSIONS = (
    "exe dll so dylib a lib o obj bin dat rlib pdb zip tar gz bz2 rar 7z dmg iso jpg jpeg png gif bmp tiff ico svg webp heic "
    "heif mp3 mp4 avi mov wmv flv wav flac m4a m4v aiff ttf otf woff woff2 eot pdf doc docx xls xlsx ppt pptx db sqlite "
    "sqlite3 class jar war ear pyc pyo pyd apk ipa aab dex whl egg gem nupkg snupkg phar"
).split()

# Noise patterns, unanchored, on the path below the root.
OS_NOISE = [
    r"\.DS_Store", r"Thumbs\.db", r"desktop\.ini", r"\.directory", r"\.Spotlight-V100", r"\.Trashes", r"\.VolumeIcon\.icns",
    r"\.AppleDouble", r"\.LSOverride", r"\.DocumentRevisions-V100", r"\.fseventsd", r"\.TemporaryItems",
    r"\.com\.apple\.timemachine\.donotpresent", r"\.AppleDB", r"\.AppleDesktop", r"Network Trash Folder", r"Temporary Items",
    r"\.apdisk", r"ehthumbs\.db", r"\._ ",
]
EDITOR_NOISE = [
    r"\.vscode/", r"\.idea/", r"\.vs/", r"\.sublime-", r"\.atom/", r"\.eclipse/", r"\.metadata/", r"\.settings/", r"\.spyproject/",
    r"\.nova/", r"\.zed/", r"\.brackets\.json", r"\.emacs\.d/", r"\.vim/", r"nbproject/", r"\.buildpath", r"\.project",
    r"\.classpath", r"\.aptana/", r"\.phpstorm\.meta\.php",
]
TEMPORARY_NOISE = [
    r"\.tmp$", r"\.temp$", r"\.swp$", r"\.swo$", r"~$", r"\.bak$", r"\.backup$", r"\.orig$", r"\.rej$", r"\.cache$", r"\.log$",
    r"\.out$", r"\.err$", r"\.pid$", r"\.lock$", r"\.lockb$", r"\.moved-aside", r"\._ ",
]
REPOSITORY_NOISE = [r"\.git/", r"\.svn/", r"\.hg/", r"\.bzr/", r"\.gitkeep"]

# Build and cache places by ecosystem, each from the start of a path segment.
BUILD_PLACES: dict[str, list[str]] = {
    "nodejs": [
        r"node_modules/", r"\.npm/", r"\.yarn/", r"\.pnpm-store/", r"\.bun/", r"\.next/", r"\.nuxt/", r"\.output/", r"\.svelte-kit/",
        r"\.astro/", r"\.remix/", r"\.vercel/", r"\.netlify/", r"\.firebase/", r"\.parcel-cache/", r"\.turbo/", r"\.webpack/",
        r"\.rollup\.cache/", r"\.vite/", r"\.swc/", r"\.esbuild/", r"\.nyc_output/", r"\.eslintcache", r"\.stylelintcache",
    ],
    "python": [
        r"__pycache__/", r"\.pytest_cache/", r"\.tox/", r"\.nox/", r"\.coverage", r"htmlcov/", r"\.mypy_cache/", r"\.pytype/",
        r"\.pyre/", r"\.ruff_cache/", r"\.ipynb_checkpoints/", r"\.eggs/", r"\.pip/",
    ],
    "rust": [r"\.cargo/", r"\.rustup/"],
    "java": [r"\.gradle/", r"\.m2/", r"\.mvn/", r"\.sbt/", r"\.ivy2/"],
    "go": [r"\.go/pkg/"],
    "cpp": [r"\.ccache/", r"\.sccache/", r"cmake-build-", r"CMakeFiles/"],
    "dotnet": [r"\.nuget/", r"TestResults/", r"\.publish/"],
    "php": [r"bootstrap/cache/", r"storage/framework/", r"storage/logs/", r"var/cache/", r"var/logs/", r"tmp/cache/", r"application/cache/"],
    "ruby": [r"\.bundle/", r"vendor/bundle/", r"\.gem/", r"\.yardoc/", r"\.sass-cache/", r"\.spring/"],
    "swift": [r"\.build/", r"\.swiftpm/", r"DerivedData/", r"Carthage/", r"[^/]*\.xcodeproj/", r"[^/]*\.xcworkspace/", r"[^/]*\.xcarchive/"],
}
# Further folder names that are never entered.
PRUNED_NAMES = ".git .svn .hg .bzr .vscode .idea .vs .atom .eclipse .metadata .settings .spyproject .nova .zed .emacs.d .vim nbproject .aptana".split()

# Folder names that mean build output in the right company: (name, files beside, files within).
CACHE_TAG = "CACHEDIR.TAG"
_DOTNET = "*.sln *.csproj *.fsproj *.vbproj"
_VENV = "pyvenv.cfg bin/activate Scripts/activate.bat"
AMBIGUOUS_DIRS: list[tuple[str, str, str]] = [
    ("packages", "*.sln *.csproj packages.config nuget.config", ""),
    ("bin", _DOTNET, ""),
    ("obj", _DOTNET, ""),
    ("publish", _DOTNET, ""),
    ("build", "CMakeLists.txt meson.build pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts", ""),
    ("target", "Cargo.toml pom.xml build.gradle build.gradle.kts", ".rustc_info.json"),
    ("dist", "package.json pyproject.toml setup.py setup.cfg", ""),
    ("out", "package.json tsconfig.json", ""),
    ("coverage", "package.json Gemfile pyproject.toml .coveragerc", ""),
    ("vendor", "go.mod composer.json Gemfile", "modules.txt autoload.php"),
    ("Pods", "Podfile", "Manifest.lock"),
    ("log", "Gemfile config.ru", ""),
    ("tmp", "Gemfile config.ru", ""),
    ("storage", "composer.json artisan", ""),
    ("env", "", _VENV),
    (".env", "", _VENV),
    ("venv", "", _VENV),
    (".venv", "", _VENV),
    ("virtualenv", "", _VENV),
]

# File names that tell generated files.
GENERATED_SUFFIXES = (
    ".min.js .min.mjs .min.css .bundle.js .bundle.css .js.map .css.map .pb.go .pb.gw.go .pb.cc .pb.h .pb.rs .pb.swift _pb2.py "
    "_pb2_grpc.py .pbobjc.h .pbobjc.m _pb.ts _pb.js _pb.d.ts _connect.ts _connect.d.ts _connectquery.ts _connectquery.d.ts "
    "_generated.go _generated.rs .gen.go .gen.ts .gen.rs .g.dart .g.cs .freezed.dart .designer.cs .tab.c .tab.h .yy.c _bindata.go"
).split()
GENERATED_NAMES = "package-lock.json npm-shrinkwrap.json pnpm-lock.yaml bun.lockb go.sum flake.lock bundle.js bundle.css vendor.js polyfills.js".split()
BOILERPLATE_STEMS = "license licence copying copyright notice patents authors contributors".split()
BOILERPLATE_EXTENSIONS = "md txt rst markdown".split()

# Documentation thresholds and score weights.
COMMENT_GOAL, DOC_GOAL, BLANK_MOST, COMMENT_TO_CODE_GOAL, DOC_TO_CODE_GOAL = 0.15, 0.10, 0.30, 0.20, 0.15
