"""Settings in YAML files that may extend each other."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .operators.agent import Loop
from .operators.chunk import Chunking
from .operators.retrieve import Retrieval


@dataclass
class Generation:
    max_context_tokens: int = 3200
    max_output_tokens: int = 1400
    order: str = "u-shape"
    dedupe: bool = True
    require_citations: bool = True


@dataclass
class Web:
    enabled: bool = True
    backend: str = "auto"
    max_results: int = 6
    fetch_pages: bool = True
    prefer_snippet: bool = True
    min_snippet_chars: int = 160
    timeout: float = 12.0


@dataclass
class Settings:
    store: str = "data/index"
    embedder: str = "hashed"
    embed_dim: int = 512
    llm: str = "none"
    llm_base_url: str = ""
    llm_model: str = ""
    llm_wire_api: str = "chat"
    reranker: str = "heuristic"
    transform: str = "none"
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    agentic: Loop = field(default_factory=Loop)
    web: Web = field(default_factory=Web)

    @classmethod
    def from_dict(cls, raw: dict) -> Settings:
        """Unknown keys are left out; lists become tuples. ``agentic: true`` or false switches the loop."""
        known = {}
        for f in fields(cls):
            if f.name not in raw:
                continue
            value, default = raw[f.name], f.default_factory() if callable(f.default_factory) else None
            if default is None:
                known[f.name] = value
            elif isinstance(value, bool):
                default.enabled = value
                known[f.name] = default
            else:
                names = {x.name: getattr(default, x.name) for x in fields(default)}
                given = {k: tuple(v) if isinstance(names[k], tuple) and isinstance(v, list) else v for k, v in (value or {}).items() if k in names}
                known[f.name] = type(default)(**{**names, **given})
        return cls(**known)

    @classmethod
    def from_file(cls, path: str | Path) -> Settings:
        return cls.from_dict(load(Path(path)))

    def to_dict(self) -> dict:
        return asdict(self)


def merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``, section by section at any depth."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: Path, below: tuple[Path, ...] = ()) -> dict:
    import yaml

    here = path.resolve()
    if here in below:
        raise ValueError(f"circular extends: {here}")
    raw = yaml.safe_load(here.read_text("utf-8")) or {}
    parent = raw.pop("extends", None)
    return merge(load(here.parent / parent, (*below, here)), raw) if parent else raw
