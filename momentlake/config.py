"""Every threshold of the moment pipeline in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Windows and scout
    window_seconds: float = 180.0
    window_hop: float = 160.0
    snap_seconds: float = 8.0
    pause_seconds: float = 0.6
    min_scout_words: int = 8
    scout_threshold: float = 36.0
    candidate_threshold: float = 32.0
    # Spans
    min_span: float = 8.0
    max_span: float = 90.0
    span_pad: float = 2.0
    # Grouping
    clip_threshold: float = 60.0
    merge_gap: float = 12.0
    merge_span: float = 120.0
    irl_gap: float = 7.0
    irl_span: float = 65.0
    topic_gap_factor: float = 1.8
    same_topic: float = 0.2
    compatible_delta: float = 15.0
    compatible_floor: float = 50.0
    peak_floor: float = 45.0
    very_high: float = 65.0
    very_high_floor: float = 50.0
    very_high_gap: float = 15.0
    irl_very_high_floor: float = 55.0
    irl_very_high_gap: float = 8.0
    peak_fallback: float = 55.0
    dilution: float = 20.0
    irl_dilution: float = 12.0
    # Suppression
    overlap_share: float = 0.45
    center_gap: float = 18.0
    # Ranking
    review_top: int = 10
    clips_per_hour: int = 8
    min_payoff: float = 3.0
    # Transcript
    min_confidence: float = 0.5
    chunk_seconds: float = 240.0
    chunk_overlap: float = 15.0
    # Live
    live_window: float = 75.0
    live_slide: float = 30.0
    quiet_seconds: float = 18.0
    max_wait_seconds: float = 90.0


DEFAULTS = Settings()
