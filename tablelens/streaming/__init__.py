"""Structured Streaming forms of scoring and profiling (same fitted state, no re-fit)."""

from .profile import running_missing  # noqa: F401
from .scoring import score_stream, start_scoring  # noqa: F401
