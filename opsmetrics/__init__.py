"""opsmetrics: operations analytics as lazy PySpark DataFrame operators.

Every public operator takes a DataFrame and returns a DataFrame. Nothing is
collected to the driver; plans stay declarative so Catalyst and AQE choose
the physical strategy.
"""

from opsmetrics.session import build_session, checkpoint_dir, cluster_settings

__all__ = ["build_session", "checkpoint_dir", "cluster_settings"]
