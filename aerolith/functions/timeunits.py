"""Timestamps of unknown unit, and which readings are usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ns(ts: Column) -> Column:
    """Nanoseconds from a bigint in s, ms, us or ns, told apart by size.

    Fixed limits: more than 1e18 is ns, more than 1e15 us, more than 1e12 ms, else s. Null stays
    null, and a number of seconds that does not fit in 64 bits as ns becomes null.
    """
    return (
        F.when(ts > 1_000_000_000_000_000_000, ts)
        .when(ts > 1_000_000_000_000_000, ts * 1_000)
        .when(ts > 1_000_000_000_000, ts * 1_000_000)
        .otherwise(F.try_multiply(ts, F.lit(1_000_000_000)))
        .cast("bigint")
    )


TO_NS_SQL = (
    "(CASE WHEN {0} > 1000000000000000000 THEN {0} WHEN {0} > 1000000000000000 THEN {0} * 1000 "
    "WHEN {0} > 1000000000000 THEN {0} * 1000000 ELSE {0} * 1000000000 END)"
)


def usable_reading(sensor: Column, v: Column) -> Column:
    """True if a reading's ``v`` is complete: imu 6 or 10 values, gps 3, the first 6 or 3 of them
    neither null nor NaN. False for null ``v``, other lengths and other sensors."""
    def clean(n: int) -> Column:
        return F.forall(F.slice(v, 1, n), lambda x: x.isNotNull() & ~F.isnan(x))

    return F.coalesce(
        F.when((sensor == "imu") & F.size(v).isin(6, 10), clean(6)).when((sensor == "gps") & (F.size(v) == 3), clean(3)),
        F.lit(False),
    )


def usable_sql(sensor: str, v: str) -> str:
    """The same rule as text that DuckDB runs."""
    def clean(n: int) -> str:
        return f"len(list_filter({v}[1:{n}], lambda x: x IS NULL OR isnan(x))) = 0"

    return f"coalesce(CASE WHEN {sensor} = 'imu' AND len({v}) IN (6, 10) THEN {clean(6)} WHEN {sensor} = 'gps' AND len({v}) = 3 THEN {clean(3)} END, false)"
