"""Detection parameters."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass

COLOR_RANKS = {"Blue": 0, "Yellow": 1, "Orange": 2, "Red": 3}


@dataclass(frozen=True)
class DetectConfig:
    """All knobs of one detection run. Times are seconds unless the name says otherwise."""

    fps: int = 12
    width: int = 1280
    thresh_pct: float = 92.0
    min_sep_s: float = 6.0
    merge_gap_s: float = 2.0
    max_win_s: float = 25.0
    max_big_win_s: float = 32.0
    big_color_min: str = "Orange"
    cooldown_s: float = 0.0
    replay_markers: bool = False
    replay_offset_s: float = 1.0
    timeline_fps: int = 60
    flow_weight: float = 0.8
    audio_weight: float = 0.2
    w_attack: float = 0.55
    w_rebound: float = 0.25
    w_drop: float = 0.20
    net_share: float = 0.7
    slot_share: float = 0.3
    pre_s: float = 7.0
    post_s: float = 6.0
    min_window_s: float = 0.5
    segment_s: float = 300.0
    floor_pct: float = 70.0

    def __post_init__(self) -> None:
        if self.big_color_min not in ("Yellow", "Orange", "Red"):
            raise ValueError(f"big_color_min must be Yellow, Orange or Red, not {self.big_color_min!r}")
        if self.fps < 1 or self.timeline_fps < 1:
            raise ValueError("fps and timeline_fps must be positive")
        total = self.w_attack + self.w_rebound + self.w_drop
        if abs(total - 1.0) > 0.01:
            warnings.warn(f"scoring weights sum to {total:.3f}, expected about 1.0", stacklevel=3)

    @classmethod
    def live(cls, **changes) -> "DetectConfig":
        """The preset of the production run: stricter peaks, cooldown, replay markers, no audio."""
        preset = dict(thresh_pct=95.0, min_sep_s=12.0, merge_gap_s=0.0, max_win_s=20.0,
                      cooldown_s=12.0, replay_markers=True, audio_weight=0.0)
        return cls(**{**preset, **changes})

    def replace(self, **changes) -> "DetectConfig":
        return dataclasses.replace(self, **changes)

    @property
    def smooth_win(self) -> int:
        return max(1, round(0.5 * self.fps))

    @property
    def segment_samples(self) -> int:
        """Samples per threshold segment; the series operators also use it as their chunk."""
        return max(1, round(self.segment_s * self.fps))

    @property
    def peak_distance(self) -> int:
        return max(1, round(self.min_sep_s * self.fps))

    @property
    def rebound_distance(self) -> int:
        return max(1, int(0.7 * self.fps))

    @property
    def drop_samples(self) -> int:
        return int(2.0 * self.fps)

    @property
    def big_rank(self) -> int:
        return COLOR_RANKS[self.big_color_min]
