"""Batch evaluation of model outputs as Spark DataFrame jobs."""

from gradeloom.session import build_session, configure, scratch_path

__all__ = ["build_session", "configure", "scratch_path"]
