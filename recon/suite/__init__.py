"""Checks that run the operators on the given tables."""

from recon.suite import aggregates, differences, matching, selection, sources  # noqa: F401
from recon.suite import history, normal, profiles, schemas, segments, streams, timelines  # noqa: F401
from recon.suite.registry import CHECKS

__all__ = ["CHECKS"]
