"""Spark-native table evaluation and annotation conversion."""

from gridweft.session import get_session, materialize, scratch_path

__all__ = ["get_session", "materialize", "scratch_path"]
