"""Layered search configuration and the embedding-model catalogue."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from typing import Any

# Model catalogue, globs and defaults that results depend on.
MODEL_CATALOGUE: tuple[tuple[str, int, bool], ...] = (
    ("Xenova/all-MiniLM-L6-v2", 384, True),
    ("Xenova/paraphrase-multilingual-MiniLM-L12-v2", 384, False),
    ("Xenova/multilingual-e5-small", 384, False),
    ("Xenova/paraphrase-multilingual-mpnet-base-v2", 768, False),
)
DEFAULT_INCLUDE = ("**/*.md", "**/*.txt", "**/*.html")
STATE_DIR = ".pagelode"
DEFAULT_EXCLUDE = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/site/**", "**/.git/**", "**/.pagelode/**", "**/.cache/**", "**/.next/**", "**/.nuxt/**",
    "**/coverage/**", "**/.svn/**", "**/.hg/**", "**/vendor/**",
)


@dataclass(frozen=True)
class ModelProfile:
    id: str
    dimensions: int
    recommended: bool = False


MODELS = tuple(ModelProfile(*m) for m in MODEL_CATALOGUE)


def default_model() -> ModelProfile:
    """The recommended model, or the first one."""
    return next((m for m in MODELS if m.recommended), MODELS[0])


def model_profile(model_id: str) -> ModelProfile:
    """The profile of ``model_id``; an unknown id gives the recommended model."""
    return next((m for m in MODELS if m.id == model_id), default_model())


@dataclass(frozen=True)
class SearchConfig:
    model: str = field(default_factory=lambda: default_model().id)
    chunk_size: int = 256
    chunk_overlap: int = 32
    include: tuple[str, ...] = DEFAULT_INCLUDE
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    out_dir: str = STATE_DIR
    incremental: bool = True
    top_k: int = 10

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be at least 1 and chunk_overlap at least 0")
        if self.top_k < 0:
            raise ValueError("top_k must not be negative")


#: Names of the settings as the JSON files spell them.
JSON_NAMES = {
    "model": "model", "chunk_size": "chunkSize", "chunk_overlap": "chunkOverlap", "include": "include",
    "exclude": "exclude", "out_dir": "outDir", "incremental": "incremental", "top_k": "topK",
}


def read_json(path: str) -> dict[str, Any] | None:
    """The object in ``path``; None when it is missing or is no JSON object."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


def write_json(path: str, value: Any) -> None:
    """Write through a temporary file and a rename, so readers see old or new, never half."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    tmp = f"{path}.tmp-{os.getpid()}"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)


def _layer(values: dict[str, Any] | None, only: tuple[str, ...] | None = None) -> dict[str, Any]:
    out = {}
    for name, spelled in JSON_NAMES.items():
        got = (values or {}).get(spelled)
        if got is not None and (only is None or name in only):
            out[name] = tuple(got) if isinstance(got, list) else got
    return out


def resolve_config(
    project: dict[str, Any] | None = None, user: dict[str, Any] | None = None, **overrides: Any
) -> SearchConfig:
    """Defaults, then the user's model, then the project's settings, then ``overrides``; None never wins."""
    merged = _layer(user, ("model",)) | _layer(project) | {k: v for k, v in overrides.items() if v is not None}
    return dataclasses.replace(SearchConfig(), **merged)


def load_project_config(root: str) -> dict[str, Any] | None:
    return read_json(os.path.join(root, STATE_DIR, "config.json"))


def load_user_config(home: str) -> dict[str, Any] | None:
    return read_json(os.path.join(home, STATE_DIR, "config.json"))


def save_user_config(home: str, values: dict[str, Any]) -> None:
    write_json(os.path.join(home, STATE_DIR, "config.json"), values)
