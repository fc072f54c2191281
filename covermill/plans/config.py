"""Settings of a selection run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Typed settings with their defaults. A budget of 0 is no limit."""

    rcuts: tuple[float, ...] = (2.7, 3.0)
    centers: tuple[str, ...] = ("Fe", "C")
    filter_coeff: float = 0.8
    bond_tolerance: float = 0.05
    angle_tolerance: float = 5.0
    feature_share: float = 0.5
    feature_samples: int = 5
    topology_similarity: float = 1.0
    rare_overlap: float = 0.85
    common_overlap: float = 0.70
    size_band: float = 0.25
    two_tier: bool = True
    rare_most: int = 5
    common_pct: float = 85.0
    post_overlap: float = 0.85
    post_band: float = 0.25
    initial_budget: int = 0
    initial_pct: float = 100.0
    supplement_budget: int = 20_000
    protect_probe_only: bool = True
    prefer_phase2: bool = True
    prune_probe_first: bool = True
