"""Settings; each can come from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    graph_path: str = ""
    functions_path: str = ""
    embedding_model: str = "hash-64"
    beam_width: int = 3
    top_k: int = 5
    depth: int = 1
    max_candidates: int = 10
    match_threshold: float = 0.70
    node_threshold: float = 0.35
    radius: int = 1
    max_path_length: int = 4
    batch_size: int | None = None
    verbose: bool = False

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        text = {f: env[k] for f, k in (("graph_path", "WEFTLINE_GRAPH"), ("functions_path", "WEFTLINE_FUNCTIONS"), ("embedding_model", "WEFTLINE_EMBEDDING")) if k in env}
        numbers = {f: int(env[k]) for f, k in (("beam_width", "WEFTLINE_BEAM"), ("top_k", "WEFTLINE_TOP_K"), ("depth", "WEFTLINE_DEPTH")) if k in env}
        return Config(**text, **numbers)
