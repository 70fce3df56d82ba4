"""Stream-anomaly analytics on Spark DataFrames."""

from .config import DEFAULT, AuditConfig, features_for

__all__ = ["DEFAULT", "AuditConfig", "features_for"]
