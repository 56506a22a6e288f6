"""Settings and the three signatures that decide what has to be rebuilt."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, fields, replace

FORMATS = (".md", ".txt", ".pdf", ".docx", ".py", ".js", ".java")
CODE_FORMATS = {".py": "python", ".js": "javascript", ".java": "java"}


@dataclass(frozen=True)
class Settings:
    """All tunables; `from_env` reads LOOMGRAPH_<NAME> and an .env file."""

    raw_dir: str = "raw"
    out_dir: str = "out"
    llm_provider: str = "offline"
    llm_model: str = "offline"
    llm_api_key: str | None = None
    llm_base_url: str | None = None
    llm_max_retries: int = 6
    extract_concurrency: int = 4
    embed_concurrency: int = 4
    token_ranks: str | None = None
    llm_request_interval: float = 0.0
    llm_rate_limit_retries: int = 3
    embedding_provider: str = "offline"
    embedding_model: str = "offline"
    embedding_api_key: str | None = None
    embedding_base_url: str | None = None
    embedding_batch: int = 64
    enable_embed_cache: bool = True
    extractor_version: str = "1"
    chunk_max_tokens: int = 3000
    chunk_overlap_tokens: int = 200
    code_languages: tuple[str, ...] = ("python", "javascript", "java")
    concept_description_strategy: str = "last_write_wins"
    fallback_description_max_edges: int = 5
    leiden_symmetrize: str = "sum"
    leiden_seed: int = 42
    retrieval_hops: int = 2
    max_context_tokens: int = 4000
    enable_vector_recall: bool = True
    enable_community_recall: bool = True
    fuzzy_match_cutoff: float = 0.8
    min_hit_count: int = 3
    min_confidence_score: float = 0.3
    max_subgraph_edges: int = 0
    vector_metric: str = "l2"
    vector_index: str = ""
    graph_serialization: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, env_file: str | None = ".env", **given) -> Settings:
        found: dict[str, str] = {}
        if env_file and (path := find_env_file(env_file)):
            with open(path, encoding="utf-8") as f:
                found |= dict(x.strip().split("=", 1) for x in f if "=" in x and not x.startswith("#"))
        found |= os.environ if env is None else env
        values: dict = {}
        for f in fields(cls):
            if (raw := found.get(f"LOOMGRAPH_{f.name.upper()}")) is not None:
                kind = type(f.default)
                values[f.name] = tuple(json.loads(raw)) if kind is tuple else raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw) if f.default is not None else raw
        return replace(cls(), **(values | given))


def find_env_file(name: str = ".env", start: str | None = None) -> str | None:
    """The file of this name in the folder, or in the nearest one above it."""
    here = os.path.abspath(start or os.getcwd())
    while True:
        if os.path.isfile(path := os.path.join(here, name)):
            return path
        above = os.path.dirname(here)
        if above == here:
            return None
        here = above


def _signature(**payload) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def extraction_signature(s: Settings) -> str:
    """Of what decides the extracted triples and concepts."""
    return _signature(
        extractor_version=s.extractor_version,
        chunk_max_tokens=s.chunk_max_tokens,
        chunk_overlap_tokens=s.chunk_overlap_tokens,
        concept_description_strategy=s.concept_description_strategy,
        code_languages=sorted(s.code_languages),
        **({"token_ranks": os.path.basename(s.token_ranks)} if s.token_ranks else {}),
    )


def index_signature(s: Settings) -> str:
    """Of what decides fallback descriptions and communities."""
    return _signature(fallback_description_max_edges=s.fallback_description_max_edges, leiden_symmetrize=s.leiden_symmetrize)


def embedding_signature(s: Settings) -> str:
    """Of what decides the vectors."""
    return _signature(embedding_model=s.embedding_model, embedding_provider=s.embedding_provider)
