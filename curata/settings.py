"""Settings and constants of curation, routing and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds, caps and seeds that results depend on.
SEED = 42
MAX_CHARS, MAX_TOKENS, OVERLAP = 30_000, 8_192, 256
TIER_CAPS = ((5, 3), (15, 2), (30, 1), (75, 0))
ELIGIBILITY_FLOOR, F1_FLOOR, SIBLING_SHARE = 20, 0.65, 0.10
BAND_LOW, BAND_HIGH = 0.88, 0.97
WILSON_Z = 1.96
SWEEP_LOW, SWEEP_STEPS, SWEEP_MIN_ROWS, SWEEP_RISK, SWEEP_BAND_ECE = 60, 40, 30, 0.02, 0.05
# Bin edges as numpy.linspace(0, 1, 11) gives them: three differ from the decimal fractions.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


@dataclass(frozen=True)
class Gate:
    """Thresholds of the conjunctive fast-path gate; all are inclusive."""

    doc_confidence: float = 0.9
    subclass_confidence: float = 0.85
    agreement: float = 0.75
    margin: float = 0.1
    min_support: int = 5
    max_chars: int = MAX_CHARS
    max_tokens: int = MAX_TOKENS
