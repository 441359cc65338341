"""tidewater: order, demand and route analytics as Spark DataFrame jobs.

Every job takes DataFrames and returns a DataFrame; no job performs an
action except the iterative ones (routes, fitted Q, recursive forecast) and
the model fits, which need a driver loop over rounds (never over rows).
"""

from tidewater.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
