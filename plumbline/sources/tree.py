"""A file tree as a data source: ``spark.read.format("source_tree").load(root)``.

Where the plan is made, folders are listed breadth first up to a bound; the files found are dealt
into runs of about equal bytes.  Folders beyond the bound are dealt out unlisted, and the tasks
that get them walk on, so neither the driver's time nor its memory grows with a large tree.

Ignore files (of the tree, of the folders above it, of the repository's ``info/exclude`` and the
user's own), hidden names, links, folders that build tools make, and ambiguous folders with
evidence beside or within are decided during the walk, so nothing below them is listed.  Zero-byte
files and names that start with an underscore are kept, which Hadoop's own listing drops.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from plumbline.functions.paths import glob_pattern, pruned_names
from plumbline.functions.tables import AMBIGUOUS_DIRS, CACHE_TAG

SCHEMA = StructType([StructField("path", StringType()), StructField("size", LongType()), StructField("mtime", LongType()), StructField("content", BinaryType())])
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 4000
#: Folders that are listed where the plan is made, and partitions into which the others are dealt.
PLANNED_FOLDERS, FOLDER_PARTITIONS = 2000, 1024


@dataclass
class IgnoreRules:
    """Rules of one ignore file; the last that matches decides, ``!`` takes back."""

    base: str
    rules: list[tuple[re.Pattern, bool, bool]] = field(default_factory=list)
    above: str = ""  # the way from the file's folder down to the root, if it lies above

    @staticmethod
    def parse(base: str, text: str) -> IgnoreRules:
        found = IgnoreRules(base)
        for raw in text.splitlines():
            line = raw.rstrip() if not raw.endswith("\\ ") else raw[:-2] + " "
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            only_dirs = line.endswith("/")
            try:
                pattern = glob_pattern(line)
            except ValueError:
                continue
            found.rules.append((re.compile(pattern.removesuffix("(?:/.*)?$") + "$"), keep, only_dirs))
        return found

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: taken back, None: not mentioned."""
        inner = f"{self.above}/{path}" if self.above else path[len(self.base) + 1 :] if self.base else path
        for pattern, keep, only_dirs in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.match(inner):
                return not keep
        return None


def is_build_folder(path: str, name: str) -> bool:
    """An ambiguous folder name with evidence on disk."""
    rule = next((r for r in AMBIGUOUS_DIRS if r[0] == name), None)
    if rule is None:
        return False

    def shows(folder: str, marker: str) -> bool:
        if not marker.startswith("*."):
            return os.path.exists(os.path.join(folder, marker))
        try:
            return any(n.lower().endswith(marker[1:].lower()) and len(n) > len(marker) - 1 for n in os.listdir(folder))
        except OSError:
            return False

    _, beside, within = rule
    return shows(path, CACHE_TAG) or any(shows(path, m) for m in within.split()) or any(shows(os.path.dirname(path), m) for m in beside.split())


#: Kinds of ignore files; of those that mention a path the first kind decides, and in a kind the deepest file.
OWN, GIT, EXCLUDE, GLOBAL = range(4)
Rules = tuple[tuple[IgnoreRules, ...], ...]


def _rules(folder: str, name: str, base: str, above: str = "") -> tuple[IgnoreRules, ...]:
    try:
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            found = IgnoreRules.parse(base, f.read())
    except OSError:
        return ()
    found.above = above
    return (found,)


def _global_ignores() -> str:
    """The user's own ignore file: as configured, else in its usual place."""
    home = os.path.expanduser("~")
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for place in (os.path.join(home, ".gitconfig"), os.path.join(config, "git", "config")):
        try:
            with open(place, encoding="utf-8", errors="replace") as f:
                found = re.search(r"(?im)^\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", f.read())
        except OSError:
            continue
        if found:
            return os.path.expanduser(found[1])
    return os.path.join(config, "git", "ignore")


@dataclass
class Walker:
    """Lists folders under a root: ``(folder, path within the root, depth, rules)`` gives files and further folders."""

    root: str
    hidden: bool = False
    gitignore: bool = True
    prune: bool = True
    max_depth: int | None = None
    ignore: tuple[str, ...] = ()

    def __post_init__(self):
        self.dropped = [re.compile(glob_pattern(g)) for g in self.ignore]
        self.never = set(pruned_names()) if self.prune else set()

    def start(self) -> tuple[str, str, int, Rules]:
        """The root itself, with the rules of what lies above it."""
        rules: Rules = ((), (), (), ())
        if self.gitignore:
            folder, above, repository = os.path.abspath(self.root), "", None
            while True:
                if repository is None and os.path.exists(os.path.join(folder, ".git")):
                    repository = folder, above
                parent = os.path.dirname(folder)
                if parent == folder:
                    break
                above = os.path.basename(folder) + (f"/{above}" if above else "")
                folder = parent
                rules = (_rules(folder, ".ignore", "", above) + rules[OWN], _rules(folder, ".gitignore", "", above) + rules[GIT], *rules[EXCLUDE:])
            exclude = _rules(os.path.join(repository[0], ".git", "info"), "exclude", "", repository[1]) if repository else ()
            rules = (rules[OWN], rules[GIT], exclude, _rules(*os.path.split(_global_ignores()), ""))
        return self.root, "", 1, self.within(self.root, "", rules)

    def within(self, folder: str, base: str, rules: Rules) -> Rules:
        """The rules with those of a folder's own files."""
        own = rules[OWN] + _rules(folder, ".ignore", base)
        git = rules[GIT] + (_rules(folder, ".gitignore", base) if self.gitignore else ())
        return (own, git, *rules[EXCLUDE:])

    def list(self, folder: str, base: str, depth: int, rules: Rules) -> tuple[list[tuple[str, int, int]], list[tuple[str, str, int, Rules]]]:
        files, below = [], []
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return files, below
        for entry in entries:
            path = f"{base}/{entry.name}" if base else entry.name
            if not self.hidden and entry.name.startswith("."):
                continue
            if any(p.search(path) for p in self.dropped):
                continue
            try:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name in self.never or (self.prune and is_build_folder(entry.path, entry.name)) or _ignored(path, True, rules):
                        continue
                    if self.max_depth is None or depth < self.max_depth:
                        below.append((entry.path, path, depth + 1, self.within(entry.path, path, rules)))
                elif entry.is_file(follow_symlinks=False) and not _ignored(path, False, rules):
                    info = entry.stat(follow_symlinks=False)
                    files.append((path, info.st_size, info.st_mtime_ns))
            except OSError:
                continue
        return files, below

    def below(self, folders: list[tuple[str, str, int, Rules]]) -> Iterator[tuple[str, int, int]]:
        """All files in and under the folders."""
        pending = list(reversed(folders))
        while pending:
            files, more = self.list(*pending.pop())
            yield from files
            pending += reversed(more)


def _ignored(path: str, is_dir: bool, rules: Rules) -> bool:
    for kind in rules:
        for held in reversed(kind):
            if (told := held.decide(path, is_dir)) is not None:
                return told
    return False


def walk(root: str, **options) -> Iterator[tuple[str, int, int]]:
    """(relative path, size, mtime in ns) of the regular files under ``root``, folders in order. A root that is a file is its only entry."""
    if os.path.isfile(root):
        info = os.stat(root)
        yield os.path.basename(root), info.st_size, info.st_mtime_ns
        return
    walker = Walker(root, **options)
    yield from walker.below([walker.start()])


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int, int]]
    folders: list[tuple[str, str, int, Rules]]

    def __init__(self, files: list[tuple[str, int, int]], folders: list[tuple[str, str, int, Rules]] | None = None):
        super().__init__(None)
        self.files, self.folders = files, folders or []


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        depth = options.get("maxdepth")
        self.walk = {
            "hidden": flag("hidden", "false"), "gitignore": flag("gitignore", "true"), "prune": flag("prune", "true"),
            "max_depth": int(depth) if depth else None, "ignore": tuple(x for x in options.get("ignore", "").split(",") if x),
        }
        self.content = flag("content", "true")

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.root):
            return [_Files(list(walk(self.root)))]
        walker = Walker(self.root, **self.walk)
        found, pending, listed = [], [walker.start()], 0
        while pending and listed < PLANNED_FOLDERS:
            files, more = walker.list(*pending.pop(0))
            found += files
            pending += more
            listed += 1
        runs, run, held = [], [], 0
        for entry in found:
            if run and (held + entry[1] > PARTITION_BYTES or len(run) >= PARTITION_FILES):
                runs.append(_Files(run))
                run, held = [], 0
            run.append(entry)
            held += entry[1]
        dealt = [pending[k::FOLDER_PARTITIONS] for k in range(min(len(pending), FOLDER_PARTITIONS))]
        return [*runs, _Files(run), *(_Files([], folders) for folders in dealt)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files = Walker(self.root, **self.walk).below(partition.folders) if partition.folders else partition.files
        for path, size, mtime in files:
            data = None
            if self.content:
                full = self.root if os.path.isfile(self.root) else os.path.join(self.root, path)
                try:
                    with open(full, "rb") as f:
                        data = f.read()
                except OSError:
                    pass  # unreadable files stay, without content
            yield path, size, mtime, data


class SourceTree(DataSource):
    """Options: hidden, gitignore, prune, maxdepth, ignore (comma-separated globs), content (false lists only)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(SourceTree)
