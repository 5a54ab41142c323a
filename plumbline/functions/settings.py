"""Host-side settings: layered merge, overrides from the environment, scanner registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Two levels of settings; the second wins, sections are merged (UDF-6, TXT-7)."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


# Settings and what they are when nobody sets them.
DEFAULTS: dict[str, Any] = {
    "version": "1.0",
    "scanners": {
        "deprecated_apis": {"enabled": True, "severity": "high", "libraries": ["pandas", "numpy", "requests", "django", "flask"], "custom_patterns": [], "exclude": ["migrations/**", "vendor/**"]},
        "todo_comments": {"enabled": True, "max_age_days": 90, "patterns": ["TODO", "FIXME", "HACK", "XXX"], "languages": ["py", "go", "cs", "js", "ts", "java"]},
        "code_smells": {"enabled": True, "cyclomatic_complexity": 10, "function_length": 50, "nesting_depth": 4, "max_parameters": 5, "file_length": 500},
        "security_patterns": {"enabled": True, "detect_hardcoded_secrets": True, "detect_weak_crypto": True, "detect_sql_injection": True, "detect_command_injection": True, "languages": ["py", "go", "cs", "js", "ts", "java"]},
        "type_coverage": {"enabled": True, "target_coverage": 80, "strict_mode": False},
        "dependency_upgrades": {"enabled": True, "tracked_files": ["requirements.txt", "requirements-dev.txt", "requirements-test.txt", "pyproject.toml", "uv.lock", "poetry.lock"]},
    },
    "behavior": {"max_prs_per_run": 5, "require_human_review": True, "confidence_threshold": 7, "max_files_per_pr": 5, "max_lines_per_pr": 500, "auto_split_prs": True, "proposal_mode_threshold": 5, "enable_alternatives": True},
    "notifications": {"channels": [], "severity_threshold": "medium", "events": ["pr_created", "pipeline_failed"]},
    "advanced": {"backup_retention_days": 7, "cache_ttl": 3600, "exclude_paths": ["vendor/**", "node_modules/**", "*.min.js", "migrations/**", ".venv/**", "build/**", "dist/**"]},
    "budget": {"monthly_budget": 500.0, "alert_thresholds": [50, 80, 90, 100], "hard_limit": True},
    "approval": {"require_plan_approval": False, "require_pr_approval": True, "approved_repos": [], "sensitive_paths": ["**/auth/**", "**/payments/**", "**/security/**"]},
    "sla": {"enabled": True, "failure_spike_threshold": 10.0},
    "learning": {"enabled": True, "target_success_rate": 0.9, "auto_adjust_confidence": True},
    "business_impact": {"enabled": True, "usage_weight": 100.0, "criticality_weight": 50.0, "change_frequency_weight": 30.0, "velocity_impact_weight": 40.0, "regulatory_risk_weight": 80.0},
    "forecasting": {"enabled": True, "forecast_horizon_days": 90, "min_snapshots": 3},
    "onboarding": {"auto_detect_language": True, "auto_detect_ci": True},
    "migrations": {"enabled": False, "pr_strategy": "staged", "max_files_per_stage": 10, "playbooks": {}},
}
# The ranges that numbers must keep to, None for no bound.
RANGES = {
    "behavior.confidence_threshold": (1, 10),
    "behavior.proposal_mode_threshold": (1, 10),
    "behavior.max_files_per_pr": (1, None),
    "behavior.max_lines_per_pr": (1, None),
    "budget.monthly_budget": (0, None),
    "sla.failure_spike_threshold": (0, None),
    "learning.target_success_rate": (0, 1),
    "business_impact.usage_weight": (0, None),
    "business_impact.criticality_weight": (0, None),
    "business_impact.change_frequency_weight": (0, None),
    "business_impact.velocity_impact_weight": (0, None),
    "business_impact.regulatory_risk_weight": (0, None),
    "forecasting.forecast_horizon_days": (7, None),
    "forecasting.min_snapshots": (2, None),
    "migrations.max_files_per_stage": (1, None),
}


def settings(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """The defaults with layers over them, the last one first in rank; ranges and kinds of values are checked (UDF-5, UDF-6).

    Sections that only services need (repository host, chat, cloud) pass through unread.
    """
    out = merged({}, DEFAULTS)
    for layer in layers:
        out = merged(out, layer)
    for name, (low, high) in RANGES.items():
        section, key = name.split(".")
        value = out[section][key]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or (low is not None and value < low) or (high is not None and value > high):
            raise ValueError(f"{name} must be a number from {low} to {high if high is not None else 'any'}, not {value!r}")
    Thresholds(out["behavior"]["confidence_threshold"], out["behavior"]["proposal_mode_threshold"])
    return out


def coerced(text: str) -> Any:
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def from_environment(environment: Mapping[str, str], prefix: str) -> dict[str, Any]:
    """``PREFIX_SECTION__KEY=value`` as nested settings; names of other shapes are left out (TXT-8)."""
    out: dict[str, Any] = {}
    for name, value in environment.items():
        parts = name.removeprefix(f"{prefix}_").lower().split("__")
        if name.startswith(f"{prefix}_") and len(parts) == 2:
            out.setdefault(parts[0], {})[parts[1]] = coerced(value)
    return out


@dataclass(frozen=True)
class Thresholds:
    """Confidence limits; proposals start at or below the confidence that is asked for (TXT-43)."""

    confidence: int = 7
    proposal: int = 5

    def __post_init__(self):
        if not 1 <= self.proposal <= self.confidence <= 10:
            raise ValueError("limits must be 1 <= proposal <= confidence <= 10")


@dataclass
class Registry:
    """Scanners by name: functions from a table of files to findings (UDF-1, UDF-2, FIL-5, SET-1)."""

    scanners: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, name: str, scan: Callable[[DataFrame], DataFrame]) -> None:
        self.scanners[name] = scan

    def enabled(self) -> list[str]:
        return [n for n in self.scanners if n not in self.disabled]

    def scan(self, files: DataFrame, names: list[str] | None = None) -> DataFrame | None:
        """The union of the chosen scanners' findings; an unknown name is an error.

        A scanner that fails while its plan is made gives one row that says so, in the column ``scan_error``;
        ``checked`` looks for failures while it runs.
        """
        chosen = names or self.enabled()
        if unknown := [n for n in chosen if n not in self.scanners]:
            raise KeyError(f"unknown scanners: {', '.join(unknown)}")
        out = None
        for n in chosen:
            part = self.checked(n, files)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def checked(self, name: str, files: DataFrame) -> DataFrame:
        """What one scanner finds, or a row with ``scanner`` and ``scan_error``: its result is written before others see it."""
        from ..operators.graph import cut

        try:
            return cut(self.scanners[name](files))
        except Exception as e:  # any scanner's own failure, whatever it is
            return files.sparkSession.createDataFrame([(name, f"{type(e).__name__}: {e}"[:500])], "scanner string, scan_error string")
