"""Settings from a TOML file. Every key has a default; an unknown key is an error."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Editor:
    """What an editor shows; 0 turns a limit off."""

    code_lens: bool = True
    max_file_lines: int = 800
    min_doc_ratio: float = 0.05
    documented_from_lines: int = 200


@dataclass(frozen=True)
class Output:
    default_format: str = "interactive"
    default_sort_by: str = "lines"
    show_progress: bool = True
    use_colors: bool = True


@dataclass(frozen=True)
class Config:
    default_max_depth: int | None = None
    default_include_hidden: bool = False
    default_ignore_gitignore: bool = False
    custom_ignore_patterns: tuple[str, ...] = ()
    language_extensions: dict[str, list[str]] = field(default_factory=dict)
    output_preferences: Output = field(default_factory=Output)
    lsp: Editor = field(default_factory=Editor)


def _read(kind, data: dict, where: str = ""):
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(data) - set(known)):
        raise ValueError(f"unknown setting {where}{unknown[0]}")
    values = {}
    for name, value in data.items():
        held = getattr(kind(), name)
        values[name] = _read(type(held), value, f"{where}{name}.") if is_dataclass(held) else tuple(value) if isinstance(held, tuple) else value
    return kind(**values)


def loads(text: str) -> Config:
    return _read(Config, tomllib.loads(text))


def load(path: str | Path) -> Config:
    """The settings of a file; the defaults where there is none."""
    path = Path(path)
    return loads(path.read_text()) if path.exists() else Config()


#: Output presets by name: what each turns on.
PRESETS = {
    "compact": {"compact_output": True, "no_color": True, "top_n": 10},
    "detailed": {"verbose": True, "show_complexity": True, "show_quality": True, "show_ratios": True, "show_size": True, "show_time_estimates": True, "show_function_details": True},
    "minimal": {"quiet": True, "summary_only": True, "no_color": True, "compact_output": True},
}


def preset(name: str | None) -> dict:
    """Settings of a preset, whatever the case; none for unknown names."""
    return dict(PRESETS.get((name or "").lower(), {}))
