"""Coded errors and the status that each code stands for."""

from __future__ import annotations

#: Codes, and the statuses that their first words stand for.
BLOCKED_ARTIFACT = "BLOCKED_ARTIFACT_INTEGRITY"
BLOCKED_PROJECTION = "BLOCKED_PROJECTION_INTEGRITY"
BLOCKED_BINDING = "BLOCKED_SOURCE_BINDING"
BLOCKED_MISMATCH = "BLOCKED_SOURCE_MISMATCH"
BLOCKED_CATALOG = "BLOCKED_ACCEPTED_CATALOG"
UNAVAILABLE_GRADE = "UNAVAILABLE_EVIDENCE_GRADE"
UNKNOWN = "UNKNOWN"


class PlinthError(ValueError):
    """An error with a stable code; nothing falls back silently."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

    @property
    def status(self) -> str:
        for prefix in ("BLOCKED", "UNAVAILABLE", "DEGRADED"):
            if self.code.startswith(prefix + "_"):
                return prefix
        return "ERROR"
