"""Configuration from files and the environment, read on the driver; rules and limits reach plans as literals."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that cannot be used."""


def find_upwards(start: Path, name: str, levels: int = 8) -> Path | None:
    """The file ``name`` in ``start`` or the nearest of the folders above it, at most ``levels`` up."""
    folder = start.resolve()
    for _ in range(levels + 1):
        if (folder / name).is_file():
            return folder / name
        if folder.parent == folder:
            return None
        folder = folder.parent
    return None


def default_config(name: str, *starts: Path) -> Path | None:
    """The first file found upwards from the working folder, then from ``starts``."""
    return next((p for p in (find_upwards(s, name) for s in (Path.cwd(), *starts)) if p), None)


@dataclass(frozen=True)
class Backend:
    """A model backend. Sizes are None where the file gives none."""

    name: str
    path: Path
    template_hint: str | None = None
    ctx_size: int | None = None
    threads: int | None = None
    gpu_layers: int | None = None
    batch_size: int | None = None
    ubatch_size: int | None = None
    offload_kqv: bool | None = None
    prompts: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    mode: str = "basic"
    translate_backend: str | None = None
    alt_translate_backend: str | None = None
    rewrite_backend: str | None = None
    controller_backend: str | None = None
    threads: int | None = None
    gpu_layers: int | None = None
    autosave_every: int = 10
    autosave_suffix: str = "_progress.docx"
    trace_dir: str | None = None
    trace_prompts: bool = False
    log_max_chars: int = 240
    docx_filter_rules: str | None = None
    max_tus: int | None = None


@dataclass(frozen=True)
class Config:
    path: Path
    pipeline: Pipeline
    backends: Mapping[str, Backend]
    prompts: Mapping[str, str]
    model_dir: Path | None = None


def _known(kind: type, data: Mapping) -> dict:
    """Values of the fields that ``kind`` has; others are passed over."""
    names = {f.name for f in fields(kind)}
    return {k: v for k, v in data.items() if k in names}


def load_config(path: Path) -> Config:
    try:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from None
    models = data.get("models", {})
    pipeline = Pipeline(**_known(Pipeline, data.get("pipeline", {})))
    if pipeline.mode not in ("basic", "full"):
        raise ConfigError(f"mode {pipeline.mode!r} is neither basic nor full")
    backends = {}
    for name, own in models.get("backends", {}).items():
        hint = (own.get("template_hint") or "").strip() or None
        rest = {k: v for k, v in _known(Backend, own).items() if k not in ("name", "path", "template_hint")}
        backends[name] = Backend(name, Path(own.get("path", "")), hint, **rest)
    model_dir = Path(models["model_dir"]) if models.get("model_dir") else None
    return Config(path, pipeline, backends, data.get("prompts", {}), model_dir)


def resolved_backend(config: Config, name: str, default_ctx: int = 4096, default_hint: str | None = None, *more: Path) -> Backend:
    """The backend with its file found: as given if absolute, else in the models' folder, the working folder, the
    configuration's folder or ``more``, in that order. Context and template fall back on the defaults."""
    if name not in config.backends:
        raise ConfigError(f"backend {name} is not configured")
    own, base = config.backends[name], config.path.parent
    folders = [*([base / config.model_dir] if config.model_dir else []), Path.cwd(), base, *more]
    places = [own.path] if own.path.is_absolute() else [d / own.path for d in folders]
    found = next((p for p in places if p.is_file()), None)
    if found is None:
        raise ConfigError(f"backend {name}: no file {own.path} in {', '.join(map(str, folders))}")
    return replace(own, path=found, ctx_size=own.ctx_size or default_ctx, template_hint=own.template_hint or default_hint)


def prompt_set(config: Config, defaults: Mapping[str, str], backend: str | None = None) -> dict[str, str]:
    """Templates by name: the defaults, then the files that the configuration names, then those of the backend."""
    out = dict(defaults)
    for names in (config.prompts, config.backends[backend].prompts if backend in config.backends else {}):
        for key, file in names.items():
            if key in out and file:
                place = Path(file) if Path(file).is_absolute() else config.path.parent / file
                try:
                    out[key] = place.read_text(encoding="utf-8-sig")
                except OSError as e:
                    raise ConfigError(f"prompt {key}: {e}") from None
    return out


@dataclass(frozen=True)
class FilterRules:
    """What filtering takes out of markup; runs merge in parts that match a pattern, or in all if there is none."""

    strip_attributes: tuple[str, ...] = ()
    drop_elements: tuple[str, ...] = ()
    drop_run_properties: tuple[str, ...] = ()
    preserve_whitespace_text_in: tuple[str, ...] = ()
    merge_adjacent_runs: bool = False
    merge_run_parts: tuple[str, ...] = ()

    def merges(self) -> list[str] | None:
        """Patterns for ``merged_runs``: none at all where merging is off."""
        return (list(self.merge_run_parts) or None) if self.merge_adjacent_runs else []


def load_rules(path: Path) -> FilterRules:
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    if data.get("version") != 1:
        raise ConfigError(f"filter rules of version {data.get('version')}, not 1")
    return FilterRules(**{k: tuple(v) if isinstance(v, list) else v for k, v in _known(FilterRules, data).items()})


@dataclass(frozen=True)
class Settings:
    """Settings of a run; every one can be given in the environment as its name in capitals behind a prefix."""

    source_lang_code: str | None = None
    target_lang_code: str | None = None
    target_style: str | None = None
    enable_context: bool = True
    enable_style_guide: bool = True
    enable_decision: bool = True
    enable_ape: bool = False
    enable_second_translator: bool = False
    enable_embeddings: bool = False
    decision_min_chars: int = 400
    embedding_top_k: int = 4
    embedding_max_chars: int = 1200
    embedding_min_sim: float = 0.0
    context_max_excerpts: int = 40
    glossary_max_terms: int = 40
    glossary_max_items_per_tu: int = 16
    checkpoint_every: int = 50
    hard_failure_repair_rounds: int = 6
    max_input_tokens: int = 1800
    max_new_tokens: int = 1024
    max_tus: int = 0
    log_tu_every: int = 20
    log_tu_max_chars: int = 120
    heartbeat_seconds: float = 8.0
    progress: bool = True


def settings_from(environment: Mapping[str, str] = os.environ, prefix: str = "TEXTLOOM_") -> Settings:
    """Settings with what the environment gives; values that cannot be read leave the default, numbers below 0 are 0."""
    given: dict = {}
    for f in fields(Settings):
        raw = environment.get(prefix + f.name.upper())
        if raw is None or not raw.strip():
            continue
        value = raw.strip()
        default = f.default
        try:
            if isinstance(default, bool):
                given[f.name] = value.lower() in ("1", "true", "yes", "on")
            elif isinstance(default, int):
                given[f.name] = max(0, int(value))
            elif isinstance(default, float):
                given[f.name] = max(0.0, float(value))
            else:
                given[f.name] = value
        except ValueError:
            continue
    found = Settings(**given)
    return replace(found, log_tu_every=max(1, found.log_tu_every))
