"""Options of the engine, with their defaults."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Config:
    # voice activity
    frame_ms: int = 25
    hop_ms: int = 10
    floor_percentile: float = 0.10
    delta_factor: float = 0.40
    delta_min_db: float = 5.0
    delta_max_db: float = 18.0
    zcr_max: float = 0.60
    enter_frames: int = 3
    exit_frames: int = 8
    min_speech_ms: int = 200
    min_silence_ms: int = 300
    # units and segments
    max_unit_ms: int = 29000
    merge_gap_ms: int = 2500
    pad_ms: int = 200
    max_segment_ms: int = 30000
    # live
    live_exit_frames: int = 60
    live_min_speech_ms: int = 250
    live_max_segment_ms: int = 12000
    live_margin_ms: int = 3000
    live_gap_ms: int = 1000
    floor_rise_db: float = 0.15
    peak_fall_db: float = 0.05
    start_db: float = -60.0
    # text
    max_sentence_chars: int = 60
    comma_gap_ms: int = 350
    period_gap_ms: int = 800
    long_chars: int = 30
    very_long_chars: int = 60
    low_confidence: float = 0.45
    # ranking
    damping: float = 0.85
    epsilon: float = 1e-4
    max_iterations: int = 100
    window: int = 5
    top_keywords: int = 12
    alpha: float = 0.6
    min_word_chars: int = 2
    summary_ratio: float = 0.25
    summary_min: int = 3
    summary_max: int = 12
    summary_lambda: float = 0.7
    overview_sentences: int = 2
    topic_block: int = 3
    topic_sigma: float = 0.5
    topic_min_sentences: int = 3
    max_topics: int = 12
    max_decisions: int = 20
    max_actions: int = 30
    # speakers
    cluster_threshold: float = 0.35
    max_speakers: int = 8
    min_embed_ms: int = 300
    smooth_window: int = 3
    jump_ratio: float = 1.5

    def problems(self) -> list[str]:
        """What is out of range; reported, not corrected."""
        rules = {
            "frame_ms": self.frame_ms > 0, "hop_ms": 0 < self.hop_ms <= self.frame_ms, "floor_percentile": 0 <= self.floor_percentile <= 1,
            "max_unit_ms": self.max_unit_ms >= 0, "merge_gap_ms": self.merge_gap_ms >= 0, "summary_ratio": 0 < self.summary_ratio <= 1,
            "summary_lambda": 0 <= self.summary_lambda <= 1, "damping": 0 < self.damping < 1, "top_keywords": self.top_keywords > 0,
            "cluster_threshold": 0 <= self.cluster_threshold <= 2, "max_speakers": self.max_speakers >= 1, "alpha": 0 <= self.alpha <= 1,
        }
        return [f"{name} is out of range: {getattr(self, name)}" for name, fine in rules.items() if not fine]

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Known options of the right kind; the rest keep their defaults."""
        given: dict[str, Any] = json.loads(text)
        fit = {f.name: type(f.default)(given[f.name]) for f in dataclasses.fields(cls) if isinstance(given.get(f.name), (int, float)) and not isinstance(given.get(f.name), bool)}
        return cls(**fit)

    @classmethod
    def load(cls, spark, path: str) -> Config:
        """From a JSON file, wherever Spark reads it."""
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])


DEFAULT = Config()
