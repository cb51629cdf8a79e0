"""Who may see a row: the only place where roles are interpreted. Apply it before ranking and limits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERNAL_ROLES = ["researcher", "analyst", "manager"]


def may_see(level: Column, allowed: Column, roles: list[str]) -> Column:
    """Admins see all and everyone sees public rows; internal rows need an internal role, one of the allowed if any are named; other
    rows need an allowed role. Unknown levels and nulls are closed."""
    if "admin" in roles:
        return F.lit(True)
    mine = F.array(*[F.lit(r) for r in roles]).cast("array<string>")
    named = F.coalesce(allowed, F.array().cast("array<string>"))
    internal = F.array(*[F.lit(r) for r in roles if r in INTERNAL_ROLES]).cast("array<string>")
    inside = (F.size(internal) > 0) & ((F.size(named) == 0) | F.arrays_overlap(named, internal))
    return F.coalesce((level == "public") | F.when(level == "internal", inside).otherwise(F.arrays_overlap(named, mine)), F.lit(False))
