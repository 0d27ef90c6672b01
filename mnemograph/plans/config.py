"""Parameters of the query plans, with their defaults and ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.endswith("threshold") and not 0 <= value <= 1:
                raise ValueError(f"{f.name} must be in 0..1")
            if isinstance(value, int) and value < 0:
                raise ValueError(f"{f.name} must not be negative")


@dataclass(frozen=True)
class VectorConfig(_Checked):
    top_k: int = 20
    similarity_threshold: float = 0.4


@dataclass(frozen=True)
class KeywordConfig:
    top_k: int = 20
    least_score: float = 0.0


@dataclass(frozen=True)
class FastConfig(_Checked):
    entity_top_k: int = 20
    multi_top_k: int = 20
    similarity_threshold: float = 0.4
    max_sections: int = 10
    max_hops: int = 1
    max_events: int = 100
    seed_events: int = 20
    entity_events: int = 20


@dataclass(frozen=True)
class GraphConfig(_Checked):
    query_events: int = 20
    events_per_entity: int = 10
    score_threshold: float = 0.3
    max_hops: int = 1
    entities_per_hop: int = 15
    events_per_hop: int = 50
    event_threshold: float = 0.4
    seed_events: int = 15
    ranked_events: int = 100
    rrf_k: int = 60
    max_results: int = 10
    relation_multiplier: int = 3
    relation_threshold: float = 0.45
    rerank_top_k: int = 10
    fill_threshold: float = 0.3


@dataclass(frozen=True)
class ScopeConfig(GraphConfig):
    event_top_k: int = 1000
    #: most edges of a query's scope, 0 for all
    scope_edges: int = 0


@dataclass(frozen=True)
class PickConfig(_Checked):
    """Plans whose last choice is a model's: the atomic plan's values."""

    entity_top_k: int = 20
    entity_events: int = 20
    multi_top_k: int = 20
    similarity_threshold: float = 0.4
    max_hops: int = 1
    #: most events of a hop, 0 for all
    hop_events: int = 0
    max_events: int = 1000
    pick_top_k: int = 5
    max_sections: int = 10


PRECISE = PickConfig(entity_events=40, hop_events=2000, max_events=100)
