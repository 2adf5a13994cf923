"""Project configuration: layered TOML, on the driver."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

CONFIG_FILE = "loomset.toml"


@dataclass(frozen=True)
class ExportProfile:
    threshold: float = 0.35
    shuffle: bool = False
    exclude_categories: tuple[str, ...] = ()
    category_prefixes: dict[str, str] = field(default_factory=dict)
    caption_prefixes: dict[str, str] = field(default_factory=dict)
    caption_suffixes: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TaggerProfile:
    repo: str = ""
    revision: str | None = None
    input_size: int = 448
    storage_threshold: float = 0.10


@dataclass(frozen=True)
class CaptionerProfile:
    kind: str = "onnx"
    repo: str = ""
    revision: str | None = None
    subdir: str = ""
    prompts: tuple[str, ...] = ()
    max_pixels: int = 589_824
    max_new_tokens: int = 512
    endpoint: str = ""
    model: str = ""
    api_key: str | None = None
    max_tokens: int = 512
    temperature: float | None = None
    max_edge: int = 1024
    jpeg_quality: int = 90
    timeout_secs: int = 600
    max_retries: int = 3


@dataclass(frozen=True)
class UpscalerProfile:
    base_url: str = "http://127.0.0.1:8188"
    upscale_model: str | None = None
    workflow_template: str | None = None
    max_edge: int = 2048
    timeout_secs: int = 600
    poll_interval_ms: int = 750


@dataclass(frozen=True)
class TagGroup:
    tags: tuple[str, ...] = ()


ANIMA = ExportProfile(category_prefixes={"artist": "@"})

#: Fixed value: the built-in prompt.
PROMPTS = {"default": "Describe this image in detail in 3-5 sentences (under 200 words)."}

_SECTIONS = {"export": ExportProfile, "tagger": TaggerProfile, "captioner": CaptionerProfile, "upscaler": UpscalerProfile, "tag_group": TagGroup}
_DEFAULTS = ("default_profile", "default_tagger", "default_captioner", "default_upscaler")


@dataclass
class Config:
    default_profile: str | None = "anima"
    default_tagger: str | None = None
    default_captioner: str | None = None
    default_upscaler: str | None = None
    export: dict[str, ExportProfile] = field(default_factory=lambda: {"anima": ANIMA, "plain": ExportProfile()})
    tagger: dict[str, TaggerProfile] = field(default_factory=dict)
    captioner: dict[str, CaptionerProfile] = field(default_factory=dict)
    upscaler: dict[str, UpscalerProfile] = field(default_factory=dict)
    tag_group: dict[str, TagGroup] = field(default_factory=dict)
    captioner_prompts: dict[str, str] = field(default_factory=dict)

    def overlaid(self, tree: dict) -> Config:
        """With a parsed file on top: scalars where set, and whole entries of tables by name."""
        out = replace(self, **{k: tree[k] for k in _DEFAULTS if tree.get(k) is not None})
        for section, kind in _SECTIONS.items():
            own = {f.name for f in fields(kind)}
            fresh = {name: kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items() if k in own}) for name, entry in tree.get(section, {}).items()}
            setattr(out, section, {**getattr(self, section), **fresh})
        out.captioner_prompts = {**self.captioner_prompts, **tree.get("captioner_prompts", {})}
        return out

    def validated(self) -> Config:
        empty = [k for k, g in self.tag_group.items() if not g.tags]
        if empty:
            raise ValueError(f"tag group {empty[0]!r} has no tags")
        return self

    def profile(self, name: str | None = None) -> ExportProfile:
        """Unknown names give a profile without prefixes."""
        return self.export.get(name or self.default_profile or "", ExportProfile())

    def _resolve(self, section: str, name: str | None, built_in: str):
        key = name or getattr(self, f"default_{section}")
        known = getattr(self, section)
        return (key, known[key]) if key in known else (built_in, _SECTIONS[section]())

    def resolve_tagger(self, name: str | None = None) -> tuple[str, TaggerProfile]:
        return self._resolve("tagger", name, "built-in")

    def resolve_captioner(self, name: str | None = None) -> tuple[str, CaptionerProfile]:
        return self._resolve("captioner", name, "built-in")

    def resolve_upscaler(self, name: str | None = None) -> tuple[str, UpscalerProfile]:
        return self._resolve("upscaler", name, "comfyui")

    def prompts(self, names: tuple[str, ...] = ()) -> list[tuple[str, str]]:
        """(name, text) in the order listed, once each; none listed: the default."""
        library = {**PROMPTS, **self.captioner_prompts}
        unknown = [n for n in names if n not in library]
        if unknown:
            raise KeyError(f"unknown prompt {unknown[0]!r}")
        return [(n, library[n]) for n in dict.fromkeys(names or ("default",))]

    def group(self, name: str) -> list[str]:
        if name not in self.tag_group:
            raise KeyError(f"unknown tag group {name!r}")
        return list(self.tag_group[name].tags)


def find(start: str | os.PathLike, legacy: tuple[str, ...] = ()) -> Path | None:
    """The nearest ancestor's file; in one folder the current name comes before legacy ones."""
    at = Path(start).resolve()
    return next((p for d in (at, *at.parents) for n in (CONFIG_FILE, *legacy) if (p := d / n).is_file()), None)


def user_file() -> Path:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.environ.get("HOME", "/"), ".config")
    return Path(base) / "loomset" / "config.toml"


def load(start: str | os.PathLike, legacy: tuple[str, ...] = ()) -> Config:
    """Defaults, under the user's file, under the project's."""
    out = Config()
    for path in (user_file(), find(start, legacy)):
        if path and path.is_file():
            out = out.overlaid(tomllib.loads(path.read_text()))
    return out.validated()


def to_toml(config: Config) -> str:
    """A file that loads to the same; names are trimmed, and empty or repeated ones refused."""
    text = lambda v: "true" if v is True else "false" if v is False else str(v) if isinstance(v, int | float) else "[" + ", ".join(map(text, v)) + "]" if isinstance(v, tuple) else "{ " + ", ".join(f"{quote(k)} = {text(x)}" for k, x in v.items()) + " }" if isinstance(v, dict) else quote(v)
    quote = lambda s: '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c) for c in s) + '"'
    lines = [f"{k} = {quote(getattr(config, k))}" for k in _DEFAULTS if getattr(config, k)]
    for section in _SECTIONS:
        names = [n.strip() for n in getattr(config, section)]
        if "" in names or len(set(names)) < len(names):
            raise ValueError(f"{section}: names must be present and differ")
        for name, entry in zip(names, getattr(config, section).values(), strict=True):
            lines += ["", f"[{section}.{quote(name)}]"] + [f"{f.name} = {text(v)}" for f in fields(entry) if (v := getattr(entry, f.name)) is not None]
    if config.captioner_prompts:
        lines += ["", "[captioner_prompts]"] + [f"{quote(k)} = {quote(v)}" for k, v in config.captioner_prompts.items()]
    return "\n".join(lines) + "\n"
