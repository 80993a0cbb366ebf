"""Thresholds and options of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Sensitivity:
    """Where warnings and critical findings begin, and how fast baselines move."""

    warning_z: float = 3.0
    critical_z: float = 4.5
    warning_jsd: float = 0.10
    critical_jsd: float = 0.25
    ewma_alpha: float = 0.05
    shift_delta: float = 0.02
    shift_lambda: float = 75.0


# fixed values
PRESETS = {
    "strict": Sensitivity(2.5, 3.5, 0.07, 0.18, 0.08, 0.01, 50.0),
    "balanced": Sensitivity(3.0, 4.5, 0.10, 0.25, 0.05, 0.02, 75.0),
    "relaxed": Sensitivity(4.0, 6.0, 0.16, 0.38, 0.03, 0.04, 110.0),
}
NUMERIC = ("latencyMs", "costUsd", "inputTokens", "outputTokens", "totalTokens", "contextTokens", "contextSnr", "retrievalChunks", "turnIndex", "toolCallCount", "toolFailureRate", "errorRate")
CATEGORICAL = ("toolSelection", "finishReason")
RATES = ("toolFailureRate", "errorRate")
RECOVERY_STREAK, OPEN_STREAK, RECOVERY_BAND, Z_CAP = 5, 2, 0.7, 50.0
TREND_POINTS, TREND_T, HORIZON_HOURS = 8, 4.0, 24.0
SCORE_ALPHA, FORGETTING = 0.2, 0.999
LEAST_DEVIATION, MOST_ATTRIBUTIONS = 0.25, 5
SEVERITIES = ("none", "info", "warning", "critical")


def sensitivity(choice: str | dict | Sensitivity | None = None) -> Sensitivity:
    """A preset by name, changes over ``balanced``, or as it is; an unknown name is an error."""
    if choice is None:
        return PRESETS["balanced"]
    if isinstance(choice, Sensitivity):
        return choice
    if isinstance(choice, str):
        if choice not in PRESETS:
            raise ValueError(f"unknown sensitivity {choice!r}: one of {', '.join(PRESETS)}")
        return PRESETS[choice]
    return replace(PRESETS["balanced"], **choice)


@dataclass(frozen=True)
class AlertPolicy:
    """Which alerts go out."""

    cooldown_ms: int = 300_000
    min_severity: str = "warning"
    canary: bool = False
    notify_recovery: bool = True
    notify_forecast: bool = True


@dataclass(frozen=True)
class Config:
    """Options of a run."""

    warmup: int = 50
    window: int = 50
    max_agents: int = 1000
    sensitivity: Sensitivity = field(default_factory=Sensitivity)
    alerts: AlertPolicy = field(default_factory=AlertPolicy)

    def __post_init__(self):
        if self.warmup < 1 or self.window < 5 or self.max_agents < 1:
            raise ValueError("warmup and max_agents must be at least 1, window at least 5")
