"""holdfast: customer-retention analytics as Spark DataFrame operators."""

from holdfast.session import build_session, tune

__all__ = ["build_session", "tune"]
