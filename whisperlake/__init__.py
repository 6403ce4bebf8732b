"""Spark-native analytics over archives and live feeds of signed message events."""

from whisperlake.session import configure_session, work_dir

__all__ = ["configure_session", "work_dir"]
