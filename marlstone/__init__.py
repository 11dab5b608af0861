"""Marlstone: a Spark-native engine for detection-data analytics."""

from marlstone.session import build_session

__all__ = ["build_session"]
