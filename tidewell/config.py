"""Settings: environment over file over defaults, checked."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_rows: int = 200
    send_row_data: bool = True
    pool_k: int = 50
    rrf_k: int = 60
    weight_sparse: float = 1.0
    weight_dense: float = 1.0
    version_match_bonus: float = 8.0
    nav_section_penalty: float = 12.0
    nav_file_penalty: float = 40.0
    default_retriever: str = "sparse"
    max_text_bytes: int = 8000
    rerank_mode: str = "auto"
    rerank_top_n: int = 30
    rerank_passage_chars: int = 500
    rerank_timeout: float = 3.0
    dims: int = 1024
    audit_days: int = 0
    confirm_seconds: int = 90

    def __post_init__(self):
        if self.max_rows < 1 or self.pool_k < 1 or self.rrf_k < 1 or self.rerank_top_n < 1 or self.dims < 1:
            raise ValueError("limits must be at least 1")
        if self.weight_sparse < 0 or self.weight_dense < 0 or self.weight_sparse + self.weight_dense <= 0:
            raise ValueError("weights must not be negative, and one must be positive")
        if self.default_retriever not in ("sparse", "dense", "hybrid"):
            raise ValueError(f"unknown retriever {self.default_retriever!r}")
        if self.rerank_mode not in ("auto", "off", "api"):
            raise ValueError(f"unknown re-ranking mode {self.rerank_mode!r}")


def boolean(text: str) -> bool:
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"not a truth value: {text!r}")


def _read(path: str) -> dict:
    with open(path) as f:
        if not path.endswith((".yaml", ".yml")):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML settings need the yaml package; JSON does without") from e
        return yaml.safe_load(f) or {}


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "TIDEWELL_") -> Settings:
    """Values of a JSON or YAML file, then the environment's (blank ones are ignored)."""
    env = dict(os.environ) if env is None else env
    out = Settings()
    given: dict = {}
    if path:
        given |= _read(path)
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper(), "").strip()
        if raw:
            kind = type(getattr(out, f.name))
            given[f.name] = boolean(raw) if kind is bool else kind(raw)
    unknown = set(given) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(out, **given)
