"""Named jobs (Spark) and their DuckDB oracles; importing this package registers all of them."""

from tidewater.plans import (core_plans, decision_plans, demand_plans, model_plans, policy_plans,  # noqa: F401
                             route_plans, stream_plans)
from tidewater.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
