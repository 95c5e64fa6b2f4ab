"""Change in the conduct of autonomous agents, found in their records with Spark.

The names below are the library's; each is imported when it is first used."""

from __future__ import annotations

import importlib

_EXPORTS = {
    "schema": ("RECORD", "CONTENT", "GOAL_SPEC", "ALARM", "BadRecord"),
    "operators.baseline": ("Baseline", "freeze", "by_run", "presence", "error_rates"),
    "operators.distributions": ("tool_distribution", "entropy", "kl_divergence", "js_divergence", "mean_surprisal", "leave_one_out"),
    "operators.channels": ("Divergence", "Cusum", "numbered", "window_scores", "windows_scores", "smoothed", "cusum_scores", "scored", "swept", "calibrated", "patience", "first_alarms", "regimes", "two_regime", "persistence"),
    "operators.detectors": ("context_decay", "version_drift", "omission", "goal_persistence"),
    "operators.selection": ("picked", "medians"),
    "operators.pairs": ("js_of_all_pairs",),
    "operators.skew": ("joined_apart",),
    "sources.files": ("documents", "read_ledger", "write_ledger", "write_table", "write_manifest", "aligned"),
    "sources.corpora": ("Corpus", "injection_runs", "coding_runs", "terminal_runs", "exported_trajectories", "span_traces", "blamed_runs", "chat_sessions", "hallucination_runs"),
    "sources.datasource": ("corpus", "write_documents"),
}
_WHERE = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_WHERE[name]}", __name__), name)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
