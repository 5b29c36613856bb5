"""Batch log analytics and supervised anomaly detection as Spark DataFrame jobs."""

from logtide.runtime import get_spark

__all__ = ["get_spark"]
