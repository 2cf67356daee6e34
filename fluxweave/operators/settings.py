"""Settings of a sort, checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class SortSettings:
    sigma: float = 4.0
    clip_width: tuple[float, float] = (-15e-4, 15e-4)
    p_cut: float = 0.01
    segment_duration: float | None = 600.0
    segment_overlap: float | None = 120.0
    do_branch_pca: bool = True
    filter_band: tuple[float, float] = (300.0, 8000.0)
    do_filter: bool = True
    do_zca: bool = True
    check_components: int | None = 100
    max_components: int | None = 5
    min_firing_rate: float = 0.0
    n_cov_samples: int = 100_000
    sigma_noise: float = 3.719
    sigma_ci: float | None = None
    refractory: float = 1e-3
    remove_artifacts: bool = False
    artifact_channels: float = 1.0
    artifact_tolerance: float = 0.0
    artifact_cushion: tuple[float, float] = (2e-3, 2e-3)
    wiener: bool = True
    wiener_smoothing: float | None = 100.0
    same_wiener: bool = False
    max_mua: float = 0.2
    min_snr: float = 1.5
    overlap_reach: int = 0
    match_cluster_size: bool = False
    check_splits: bool = False
    seed: int = 0

    def __post_init__(self):
        for name in ("sigma", "p_cut", "n_cov_samples", "sigma_noise", "refractory"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("segment_duration", "check_components", "max_components"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive or None")
        object.__setattr__(self, "clip_width", (-abs(self.clip_width[0]), abs(self.clip_width[1])))
        object.__setattr__(self, "segment_overlap", None if self.segment_overlap is None or self.segment_overlap <= 0 else self.segment_overlap)
        object.__setattr__(self, "min_firing_rate", max(0.0, self.min_firing_rate))

    @classmethod
    def of(cls, **options) -> SortSettings:
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**options)

    @property
    def ci_multiplier(self) -> float:
        return math.inf if self.sigma_ci is None else self.sigma_ci
