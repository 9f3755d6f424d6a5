"""Spark-native table reconciliation: keyed, positional and multiset diffs,
run history, per-key activity limits and text audits, as DataFrame jobs."""

from evenkeel.spec import CompareSpec

__all__ = ["CompareSpec"]
