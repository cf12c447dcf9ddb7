"""Column expressions shared by the operators.

All of them are JVM-side built-ins (they stay inside whole-stage codegen).
Spark 4 runs with ANSI mode on, where ``x / 0`` raises, so every division in
the library goes through :func:`safe_div` (NULL on a zero divisor) and every
logarithm through :func:`safe_ln` (NULL for non-positive input).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """``num / den``; NULL when ``den`` is 0 or NULL."""
    return F.try_divide(_c(num), _c(den))


def safe_ln(x) -> Column:
    """Natural log; NULL for ``x <= 0`` or NULL."""
    x = _c(x)
    return F.when(x > 0, F.ln(x))


def pct_change(new, old) -> Column:
    """``(new - old) / old * 100``; NULL when ``old`` is 0 or NULL."""
    return safe_div(_c(new) - _c(old), _c(old)) * 100


def ladder(cases: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """First matching ``(condition, value)`` wins, like SQL ``CASE WHEN``."""
    (cond, val), *rest = cases
    out = F.when(cond, val)
    for cond, val in rest:
        out = out.when(cond, val)
    return out if otherwise is None else out.otherwise(otherwise)


def fixed_round(x, decimals: int) -> Column:
    """Round half away from zero as ``round(x * 10^d) / 10^d`` (+ 0.0 to drop -0.0).

    Spark's ``round(x, d)`` decides a tie such as 246192.26375 on the exact
    binary value of ``x``; other engines multiply first. Written this way the
    result depends only on the IEEE product ``x * 10^d``, so any engine
    computing the same ``x`` rounds it to the same double.
    """
    scale = float(10**decimals)
    return F.round(_c(x) * scale, 0) / scale + 0.0


def month_name(month) -> Column:
    """English month name for a month number 1..12."""
    return F.date_format(F.make_date(F.lit(2000), _c(month), F.lit(1)), "MMMM")


# Fixed values that must equal the reference's: unit thresholds and suffixes
# of its compact money format, largest first: 1e12 "T", 1e9 "B", 1e6 "M";
# below 1e6 the whole amount with thousands separators.
_MONEY_UNITS = ((1e12, "T"), (1e9, "B"), (1e6, "M"))


def humanize_amount(x) -> Column:
    """``$1.2B``-style label (one decimal) for amounts >= 1e6, else ``$1,234``.

    The scaled value is rounded first so that the printed digit never
    depends on how a formatter breaks exact binary ties.
    """
    x = _c(x).cast("double")
    cases = [
        (
            x >= limit,
            F.concat(F.lit("$"), F.format_string("%.1f", F.round(x / limit, 1)), F.lit(suffix)),
        )
        for limit, suffix in _MONEY_UNITS
    ]
    return ladder(cases, F.concat(F.lit("$"), F.format_number(F.round(x, 0), 0)))
