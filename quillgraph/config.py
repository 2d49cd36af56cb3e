"""Every tunable of the engine in one place; operators take a Config, never the environment."""

from __future__ import annotations

from dataclasses import dataclass

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Config:
    """Defaults of retrieval, graph and memory operators."""

    topk: int = 8
    pool_factor: int = 8
    rrf_k: int = 60
    cutoff_ratio: float = 0.3
    personal_boost: float = 1.2
    per_record_cap: int = 2
    record_half_life_days: float = 60.0
    decay_floor: float = 0.5
    access_weight: float = 0.15
    stale_penalty: float = 0.5
    rerank_pool: int = 20
    memory_half_life_days: float = 30.0
    episode_half_life_days: float = 30.0
    hub: int = 60
    max_neighbours: int = 64
    ppr_alpha: float = 0.5
    ppr_iterations: int = 12
    ppr_hops: int = 3
    ppr_seeds: int = 16
    ppr_nodes: int = 256
    ppr_edges: int = 2048
    ppr_limit: int = 8
    walk_alpha: float = 0.85
    walk_iterations: int = 30
    mrl_prefix: int = 64
    mrl_factor: int = 8
    mrl_min_rows: int = 4000
    chunk_size: int = 512
    min_chunk: int = 80
    session_ttl_ms: int = DAY_MS
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    prf_docs: int = 5
    prf_terms: int = 8
    note_budget: int = 4000
    episode_floor: float = 0.15
    forget_floor: float = 0.6
    answer_floor: float = 0.55
    line_margin: float = 0.08
    max_document_bytes: int = 10_000_000


FUNCTIONAL = tuple(sorted("based_in born_in capital_of ceo_of current_role employed_by headquartered_in led_by lives_in located_in married_to member_of owned_by owns reports_to role_is status_is works_at".split()))
PERMANENT = tuple(sorted("born_in capital_of gender_of nationality_of native_of".split()))
STRUCTURAL = ("belongsTo", "inheritPermissions", "mentions", "permissions")
GENERIC = "relates_to"
