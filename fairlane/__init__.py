"""fairlane: decision-data quality, features, metrics and fairness audits on Spark.

Every public operator takes a DataFrame and returns a DataFrame. Fit-style
operators (imputers, encoders, splits with exact strata) run one aggregate
action and bring back a handful of constants; everything else stays lazy so
Catalyst can prune, push down and fuse the whole chain.
"""

from fairlane.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
