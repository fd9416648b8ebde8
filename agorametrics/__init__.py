"""Engagement analytics for social-media tables, written for Spark."""

from agorametrics.session import configure, shared_dir

__all__ = ["configure", "shared_dir"]
