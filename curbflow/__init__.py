"""Trip analytics around a policy change, written as Spark DataFrame jobs."""

from curbflow.spec import NYC_CONGESTION_PRICING, PolicySpec, TripRules

__all__ = ["NYC_CONGESTION_PRICING", "PolicySpec", "TripRules"]
