"""Column expressions shared by the jobs (all built-in, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.constants import EARTH_RADIUS_KM, SHIPPING_MODE_ENC


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def bin_index(c: Column | str, edges: list) -> Column:
    """Index of the left-closed bin ``c`` falls in; above the last edge -> last bin.

    Below the first edge the reference's index is -1, which numpy then wraps
    to the last bin; we clamp it to 0 instead (documented departure).
    """
    x = col(c)
    expr = F.lit(0)
    for i, e in enumerate(edges):
        if i == 0:
            continue
        expr = F.when(x >= F.lit(e), F.lit(i)).otherwise(expr)
    return expr


def risk_class(delay_gap: Column | str) -> Column:
    """<=0 LOW(0), <=2 MEDIUM(1), otherwise HIGH(2); a null gap falls through to 2."""
    g = col(delay_gap)
    return F.when(g <= 0, 0).when(g <= 2, 1).otherwise(2)


def shipping_mode_enc(mode: Column | str) -> Column:
    """Ordinal of the shipping mode, unknown or null -> 0."""
    m = col(mode)
    expr = None
    for name, code in SHIPPING_MODE_ENC.items():
        expr = (F.when(m == name, code) if expr is None else expr.when(m == name, code))
    return expr.otherwise(0)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance with R = 6371 km."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dphi = F.radians(col(lat2) - col(lat1))
    dlam = F.radians(col(lon2) - col(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlam / 2), 2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def arith_hash(*cols, seed: int = 42) -> Column:
    """Small deterministic integer mix of integer key columns, reproducible in any SQL engine.

    Stays far below 2^63 for keys below 2^40, so ANSI overflow checks never fire.
    """
    expr = F.lit(seed)
    for i, c in enumerate(cols):
        expr = F.pmod(expr * F.lit(1_000_003) + col(c) * F.lit(7919 + 2 * i), F.lit(2_147_483_647))
    return expr


def round_half_up(c: Column | str, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: one rounding rule that every engine evaluates with the same
    IEEE operations (built-in ``round`` differs between engines on exact half-way values)."""
    k = float(10 ** digits)
    return F.floor(col(c) * k + 0.5) / k
