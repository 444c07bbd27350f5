"""Ordering domains and weights as map expressions and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_SCORE = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4, "info": 0.2}
EXPLOITABILITY_SCORE = {"exploitable": 1.0, "likely": 0.7, "possible": 0.5, "unlikely": 0.3, "not_exploitable": 0.0, "confirmed": 1.0, "potential": 0.5, "safe": 0.0}
ENGINE_SCORE_WEIGHT = {"opencode_agent": 1.2, "agent": 1.2, "codeql": 1.0, "semgrep": 0.8}
ENGINE_MERGE_WEIGHT = {"agent": 1.0, "codeql": 0.9, "semgrep": 0.8}
EXPLOITABILITY_LEVEL = {"exploitable": 4, "confirmed": 4, "likely": 3, "possible": 2, "unlikely": 1, "not_exploitable": 0, "safe": 0, "unknown": 2}
STATUS_LEVEL = {"exploitable": 3, "confirmed": 3, "conditional": 2, "informational": 1, "not_exploitable": 0, "safe": 0}
REPORT_PRIORITY = {"exploitable": 4, "conditional": 3, "informational": 2, "suppressed": 1}
RISK_WEIGHT = {"critical": 100, "high": 50, "medium": 20, "low": 5, "info": 1}
SUPPRESSING_FILTERS = ("finding_budget", "rule_gating", "ast_validator", "file_filter")


def lookup(key: Column, table: dict, default=None) -> Column:
    """The value of ``table`` for ``key``; ``default`` for null or unknown keys."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info; 5 for anything else."""
    return lookup(F.lower(severity), {s: k for k, s in enumerate(SEVERITIES)}, 5)
