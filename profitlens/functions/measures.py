"""Money, ratio and share expressions.

Conventions (one place, used by the Spark plans and mirrored by the oracle SQL):

* money columns are ``DECIMAL(12,2)``; totals are exact sums of integer cents (``sum_cents``),
  reported in currency units as ``double`` (``dollars``).  Cents are summed in two ``long`` parts
  (millions of cents and the rest), which stay on Spark's fixed-width aggregation fast path, and
  are joined as ``decimal(38,0)`` after the aggregate: a part holds 9e18 / 1e6 = 9e12 rows of any
  12-digit amount, with ANSI mode on or off;
* a ratio of sums is the quotient of two integers (cents, counts, hundredths), rounded once, half away
  from zero, by quotient and remainder on ``decimal(38,0)`` (``half_up``); no double takes part before the
  rounded whole number is scaled back;
* division by zero yields NULL (``nullif``), never an ANSI error;
* averages of margins are exact sums of integer hundredths divided by the count, so they do not
  depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
WHOLE = "decimal(38,0)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _safe_div(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def half_up(part, whole, up: int, down: int) -> Column:
    """``part * 10**up / whole`` as a whole number, rounded half away from zero, over ``10**down`` (double).

    ``part`` and ``whole`` are integers of any width up to 31 digits; NULL on a zero ``whole``.  A quotient
    beyond 32 digits, which a double can't tell from its neighbours, is divided as doubles."""
    n, d = _col(part).cast(WHOLE), _col(whole).cast(WHOLE)
    twice = F.abs(n) * F.lit(2 * 10**up).cast("decimal(7,0)") + F.abs(d)
    step = F.nullif(F.abs(d) * F.lit(2), F.lit(0).cast(WHOLE))
    even = twice - twice % step
    size = F.coalesce(F.try_divide(even, step).cast("double"), even.cast("double") / step.cast("double")) / F.lit(float(10**down))
    return F.when((n < 0) != (d < 0), -size).otherwise(size)


def pct(part, whole) -> Column:
    """``round(100 * part / nullif(whole, 0), 2)`` of two integers in one unit (guarded margin / share, V4/V5)."""
    return half_up(part, whole, 4, 2)


def ratio(part, whole) -> Column:
    """``part / whole`` of two integers in one unit, to 6 decimals, NULL on a zero divisor (V2/V3)."""
    return half_up(part, whole, 6, 6)


def per_unit(amount_cents, units) -> Column:
    """Currency units per unit, to 6 decimals, from cents and a count."""
    return half_up(amount_cents, units, 4, 6)


def average(total_hundredths, n) -> Column:
    """``round(total / n, 2)`` of a total held in whole hundredths (cents, margins)."""
    return half_up(total_hundredths, n, 0, 2)


def unrounded(part, whole) -> Column:
    """``part / whole`` as double, NULL on a zero divisor: what rankings by a ratio order by."""
    return _safe_div(_col(part), _col(whole))


def cents(c) -> Column:
    """A DECIMAL(12,2) amount as an exact integer number of cents (double round trip is exact
    far beyond the 12-digit range)."""
    return F.floor(_col(c).cast("double") * F.lit(100.0) + F.lit(0.5))


def sum_cents(c) -> Column:
    """Exact sum of a money column, in cents (``decimal(38,0)``), free of overflow at any table size."""
    x, part = cents(c), F.lit(1_000_000)
    high, low = F.sum(F.call_function("div", x, part)), F.sum(x % part)
    return (high.cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)") + low.cast("decimal(31,0)")).cast("decimal(38,0)")


def dollars(c) -> Column:
    """Cents → currency units as double (same value as ``cast(decimal_sum as double)``)."""
    return _col(c).cast("double") / F.lit(100.0)


def money_sum(c) -> Column:
    """``round(sum(x), 2)`` over DECIMAL(12,2) money, reported as double."""
    return dollars(sum_cents(c))


def avg_money(c) -> Column:
    """``round(avg(x), 2)`` of a money column (exact sum / count)."""
    return average(sum_cents(c), F.count(_col(c)))


def hundredths(x) -> Column:
    """A double that carries two decimals (a margin) as an exact integer number of hundredths."""
    return F.floor(_col(x) * F.lit(100.0) + F.lit(0.5))


def avg_pct(m) -> Column:
    """``round(avg(margin), 2)``; margins carry 2 decimals, so they are summed exactly as
    integer hundredths (order-independent), then divided by the count."""
    m = _col(m)
    return average(F.sum(hundredths(m)), F.count(m))
