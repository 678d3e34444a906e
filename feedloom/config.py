"""Engine settings. Every job takes a ``Settings``; nothing is read from the process environment."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Event weights and the order in which candidate sources are reported.
EVENT_WEIGHTS: dict[str, float] = {
    "impression": 0.0,
    "view": 0.25,
    "watch": 0.25,
    "complete": 0.6,
    "like": 1.0,
    "skip": -0.5,
    "dislike": -1.0,
}
ACCEPTED_EVENT_TYPES: tuple[str, ...] = ("impression", "view", "complete", "like", "skip", "dislike")
SOURCE_ORDER: tuple[str, ...] = ("similar", "tag", "trending", "fresh", "explore")

# Ranking terms in summation order; fatigue is subtracted.
RANK_TERMS: tuple[str, ...] = (
    "affinity",
    "quality",
    "freshness",
    "popularity",
    "fatigue",
    "exploration",
    "creator_affinity",
)


@dataclass(frozen=True)
class Settings:
    """Policy values (fixed defaults below) and physical sizing knobs."""

    now: str = "2024-01-31 00:00:00"

    # profile
    halflife_days: float = 7.0
    cold_start_min: int = 5
    signal_epsilon: float = 1e-9

    # candidate sources
    source_limits: dict[str, int] = field(
        default_factory=lambda: {"similar": 200, "tag": 100, "trending": 100, "fresh": 50, "explore": 50}
    )
    preferred_tags: int = 8
    trending_window_hours: int = 72

    # ranking
    rank_weights: dict[str, float] = field(
        default_factory=lambda: {
            "affinity": 1.0,
            "quality": 0.15,
            "freshness": 0.2,
            "popularity": 0.25,
            "fatigue": 0.35,
            "exploration": 0.1,
            "creator_affinity": 0.2,
        }
    )
    freshness_halflife_hours: float = 168.0
    fatigue_window_items: int = 20
    fatigue_window_events: int = 100

    # diversity
    diversity_lambda: float = 0.3
    max_same_creator: int = 2
    max_same_tag: int = 3
    tag_cap_window: int = 10

    # feeds
    feed_size: int = 50
    feed_ttl_seconds: int = 3600
    feed_retention_factor: int = 2
    feed_generations_kept: int = 2
    refill_watermark: int = 10
    trending_feed_size: int = 100

    # frame sampling
    frame_tiers: tuple[tuple[float, int], ...] = ((30.0, 6), (60.0, 8), (120.0, 12))
    frame_tier_max: int = 16
    frame_cap: int = 16
    frame_floor: int = 3
    frame_trim: float = 0.05
    frame_long_edge: int = 768
    dedup_threshold: int = 6
    scene_snap_window: float = 1.5
    scene_offset: float = 0.15

    # ingest
    max_duration_s: float = 300.0
    min_duration_s: float = 1.0

    # cost inputs
    cost_target_items: int = 100_000
    cost_gpu_hour_usd: float = 0.6
    cost_gpu_hour_rub: float = 41.06
    cost_rub_per_usd: float = 0.0
    cost_optimistic_speedup: float = 12.0
    cost_storage_usd_gb_month: float = 0.023
    cost_features_bytes: int = 2_500
    cost_input_usd_mtok: float = 0.2
    cost_output_usd_mtok: float = 0.6
    cost_preprocess_s: float = 0.786
    cost_cpu_hour_usd: float = 0.04

    # physical sizing
    list_chunk: int = 128
    list_head: int = 4096
    broadcast_rows: int = 2_000_000
    block_items: int = 8192
    block_users: int = 32768
    max_pivots: int = 1024

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
