"""Column expressions for alert rules. All native (codegen-able), no UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertforge import schemas as S


def col_or_lit(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind."""
    return F.regexp_replace(col_or_lit(c), r"(?U)^\s+|\s+$", "")


def clean_severity(c: str | Column = "severity") -> Column:
    """Lower-cased, stripped severity; null becomes the text ``none``."""
    return F.coalesce(strip_ws(F.lower(col_or_lit(c))), F.lit("none"))


def severity_weight(clean: str | Column = "severity") -> Column:
    """Weight of a cleaned severity (see ``SEVERITY_WEIGHTS``), default 1."""
    c = col_or_lit(clean)
    expr = None
    for name, weight in S.SEVERITY_WEIGHTS.items():
        expr = (F.when(c == name, F.lit(float(weight))) if expr is None
                else expr.when(c == name, F.lit(float(weight))))
    return expr.otherwise(F.lit(S.DEFAULT_SEVERITY_WEIGHT))


def is_critical(clean: str | Column = "severity") -> Column:
    return (col_or_lit(clean) == "critical").cast("int")


def floor_time(ts: str | Column, seconds: int) -> Column:
    """Floor a timestamp to a fixed bucket of ``seconds`` (epoch aligned, UTC)."""
    micros = F.unix_micros(col_or_lit(ts))
    step = F.lit(int(seconds) * 1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros, step))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """(end - start) in minutes as double, from exact microseconds."""
    return (F.unix_micros(col_or_lit(end)) - F.unix_micros(col_or_lit(start))) / F.lit(60_000_000.0)


def hours_between(start: str | Column, end: str | Column) -> Column:
    """(end - start) in hours as double, from exact microseconds."""
    return (F.unix_micros(col_or_lit(end)) - F.unix_micros(col_or_lit(start))) / F.lit(3_600_000_000.0)


def avg_minutes(start: str | Column, end: str | Column) -> Column:
    """Mean of (end - start) in minutes as an aggregate.

    Sums whole microseconds (an exact integer sum), so the result does not
    depend on the order in which partitions are combined.
    """
    micros = F.unix_micros(col_or_lit(end)) - F.unix_micros(col_or_lit(start))
    return F.try_divide(F.try_divide(F.sum(micros).cast("double"), F.count(micros).cast("double")),
                        F.lit(60_000_000.0))


def contains_any(text: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens])


def incident_type(alert_type: str | Column, description: str | Column) -> Column:
    """Ordered substring rules over ``lower(alert_type || ' ' || description)``."""
    signal = F.lower(F.concat_ws(" ", col_or_lit(alert_type), col_or_lit(description)))
    expr = None
    for name, tokens in S.INCIDENT_TYPE_RULES:
        hit = contains_any(signal, tokens)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr.otherwise(F.lit(S.OTHER_INCIDENT_TYPE))


def mode_or_unknown(c: str | Column, unknown: str = S.UNKNOWN) -> Column:
    """Most frequent non-null value, ties to the smallest; all null -> unknown."""
    return F.coalesce(F.mode(col_or_lit(c), deterministic=True), F.lit(unknown))


def silver_severity(c: str | Column) -> Column:
    """Vendor severity -> HIGH / MEDIUM / LOW (null and the rest -> LOW)."""
    low = F.lower(col_or_lit(c))
    return (F.when(contains_any(low, S.SILVER_HIGH_MARKERS), F.lit("HIGH"))
            .when(contains_any(low, S.SILVER_MEDIUM_MARKERS), F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def silver_event_state(c: str | Column) -> Column:
    """Vendor state -> resolved if a known clear state, else triggered."""
    low = F.lower(col_or_lit(c))
    return F.when(low.isin(S.RESOLVED_STATES), F.lit("resolved")).otherwise(F.lit("triggered"))


def parse_timestamp(c: str | Column, dtype: str | None = None) -> Column:
    """Coerce to timestamp: strings that do not parse become null (ANSI safe)."""
    col = col_or_lit(c)
    if dtype is not None and dtype.startswith("timestamp"):
        return col.cast("timestamp")
    if dtype is not None and dtype == "date":
        return col.cast("timestamp")
    return F.try_to_timestamp(col.cast("string"))
