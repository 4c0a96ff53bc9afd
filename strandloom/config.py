"""Parameters of a comparison, their checks, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from strandloom.functions import statistics as st

MODES = ("window", "exact", "minmer")
MODELS = ("poisson", "binomial")


@dataclass(frozen=True)
class Config:
    """window: minimizers by window changes; exact: one row for each minimizer's first window; minmer: bottom-s intervals."""

    kmer: int = 16
    fragment: int = 3000
    min_identity: float = 80.0
    min_fraction: float = 0.2
    p_value: float = 1e-3
    reference_size: int = 5_000_000
    window: int | None = None
    ignore_top_percent: float = 0.0
    seed: int = 42
    hash: str = "splitmix"
    mode: str = "window"
    model: str = "poisson"
    optimal_chain: bool = False
    diagonal_bin: int = 1000
    diagonal_band: int = 500
    max_predecessors: int = 96
    max_gap: int = 5000
    diagonal_tolerance: int = 1200

    def checked(self) -> Config:
        """self, or a ValueError that names the parameter."""
        positive = ("diagonal_bin", "diagonal_band", "max_predecessors", "max_gap", "diagonal_tolerance")
        rules = {
            "kmer must be 1 to 32": 0 < self.kmer <= 32,
            "fragment must be longer than kmer": self.fragment > self.kmer,
            "min_identity must be 0 to 100": 0 <= self.min_identity <= 100,
            "min_fraction must be 0 to 1": 0 <= self.min_fraction <= 1,
            "ignore_top_percent must be 0 to 100": 0 <= self.ignore_top_percent <= 100,
            f"mode must be one of {MODES}": self.mode in MODES,
            f"model must be one of {MODELS}": self.model in MODELS,
        } | {f"{name} must be positive": getattr(self, name) > 0 for name in positive}
        for rule, kept in rules.items():
            if not kept:
                raise ValueError(rule)
        if self.fragment < self.kmer + self.resolved_window() - 1:
            raise ValueError("fragment must hold a whole window")
        return self

    def resolved_window(self) -> int:
        w = self.window or st.recommended_window(self.p_value, self.kmer, self.min_identity, self.fragment, self.reference_size, self.model)
        return st.odd_span_window(self.kmer, w) if self.mode == "window" else w

    def minmer_sketch(self) -> int:
        return st.recommended_minmer_sketch(self.p_value, self.kmer, self.min_identity, self.fragment, self.reference_size, self.model)
