"""Column expressions shared by every operator.

Null policy (applied everywhere): NULL means "missing"; +/-Infinity is allowed
only in ratio and index columns; a column never holds NaN.  All helpers are
plain Catalyst expressions, so they stay inside whole-stage codegen and work
with ANSI mode on (where a bare ``x / 0`` raises even for doubles).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NINF = float("-inf")

# Money is summed exactly: each value is rounded to whole micro-units, the
# units are summed as decimal(38,0), and the total is turned back into a
# double.  The result does not depend on the partitioning or on the order in
# which partial sums are merged.  Decimals hold 38 digits, so values up to
# LARGEST are safe with room for 1e6 rows of that size; a sum over a value
# beyond it, or over an infinite one, is NULL rather than a wrong number.
MICRO = 1e6
SUM_DECIMAL = "decimal(38,0)"
LARGEST = 1e26


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c) -> Column:
    """NaN -> NULL (NaN never survives into a column)."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def ieee_div(n, d) -> Column:
    """IEEE-style division that never raises and never yields NaN.

    x/0 is +inf or -inf by the sign of x, 0/0 and anything with NULL is NULL,
    inf/inf is NULL.
    """
    n, d = col(n).cast("double"), col(d).cast("double")
    q = n / d
    return (
        F.when(d == 0, F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(NINF)))
        .otherwise(F.when(F.isnan(q), F.lit(None).cast("double")).otherwise(q))
    )


def finite(c) -> Column:
    """+/-inf -> NULL (feature columns must be finite)."""
    c = col(c)
    return F.when(F.abs(c) == F.lit(INF), F.lit(None).cast("double")).otherwise(no_nan(c))


def to_number(c) -> Column:
    """Coerce to double; unparsable text becomes NULL."""
    return no_nan(col(c).try_cast("double"))


def clip(c, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; a missing value stays missing (never the bound)."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def pct_change(x, prev) -> Column:
    """(x / prev - 1), the way a pandas ``pct_change`` computes it."""
    return ieee_div(x, prev) - F.lit(1.0)


def index100(x, prev) -> Column:
    """Base-100 index ``(1 + pct_change) * 100``."""
    return no_nan((F.lit(1.0) + pct_change(x, prev)) * F.lit(100.0))


def growth_pct(x, prev) -> Column:
    """Growth in percent ``pct_change * 100``."""
    return no_nan(pct_change(x, prev) * F.lit(100.0))


def rate100(n, d) -> Column:
    return no_nan(ieee_div(n, d) * F.lit(100.0))


def exact_sum(c) -> Column:
    """Order-independent sum of a money / volume column; 0.0 when all missing, NULL beyond LARGEST.

    Built as one SQL expression for a named column (one round trip instead
    of one per function call when the plan is constructed).
    """
    if isinstance(c, str):
        name = c.replace("`", "``")
        return F.expr(f"case when coalesce(bool_or(abs(`{name}`) > {LARGEST!r}D), false) then null else coalesce(cast("
                      f"sum(try_cast(rint(`{name}` * 1000000.0D) as {SUM_DECIMAL})) as double) / 1000000.0D, 0.0D) end")
    units = F.rint(col(c) * F.lit(MICRO)).try_cast(SUM_DECIMAL)
    total = F.coalesce(F.sum(units).cast("double") / F.lit(MICRO), F.lit(0.0))
    return F.when(~F.coalesce(F.bool_or(F.abs(col(c)) > F.lit(LARGEST)), F.lit(False)), total)


# Several measures of a grouping are summed exactly without decimals: the micro-units of a value are cut
# into two limbs (LIMB_BITS bits, not negative, and what lies above), which are summed as longs.  The lower
# sums hold 2^35 rows of a group, the upper one totals up to 2e21; a total that runs over is NULL, as is
# one over a value beyond LIMB_LARGEST.  A flag per measure tells of such values, so a measure that nobody
# reads is not carried along.
LIMB_BITS = 28
LIMB_LARGEST = 1e21


def _limb(measure: str, k: int) -> str:
    return f"_{measure}_limb{k}"


def with_limbs(df, measures: Sequence[str]):
    """``df`` with both limbs of every measure and its flag of a value beyond LIMB_LARGEST."""
    base = f"{float(1 << LIMB_BITS)!r}D"
    name = lambda m: m.replace("`", "``")
    units = {f"_{m}_units": F.expr(f"case when abs(`{name(m)}`) <= {LIMB_LARGEST!r}D then rint(`{name(m)}` * 1000000.0D) "
                                   "else 0.0D end") for m in measures}
    beyond = {f"_{m}_beyond": F.expr(f"coalesce(abs(`{name(m)}`) > {LIMB_LARGEST!r}D, false)") for m in measures}
    df = df.withColumns({**units, **beyond})
    df = df.withColumns({_limb(m, 1): F.expr(f"floor(`_{name(m)}_units` / {base})") for m in measures})
    return df.withColumns({_limb(m, 0): F.expr(f"cast(`_{name(m)}_units` - `{_limb(name(m), 1)}` * {base} as bigint)")
                           for m in measures})


def limb_sums(measures: Sequence[str]) -> list[Column]:
    """The aggregates that ``limb_totals`` takes."""
    return [F.try_sum(_limb(m, k)).alias(_limb(m, k)) for m in measures for k in range(2)] + [
        F.bool_or(f"_{m}_beyond").alias(f"_{m}_beyond") for m in measures]


def limb_totals(measures: Sequence[str]) -> list[Column]:
    """The sums as doubles, under the measures' names."""
    out = []
    for m in measures:
        low, high = (f"cast(`{_limb(m, k)}` as {SUM_DECIMAL})" for k in range(2))
        total = f"cast({high} * {1 << LIMB_BITS}BD + {low} as double) / 1000000.0D"
        out.append(F.expr(f"case when not `_{m}_beyond` then {total} end").alias(m))
    return out


def exact_sums(df, keys: Sequence[str], measures: Sequence[str], *others: Column):
    """One row per group: ``keys``, the exact sums of ``measures`` and the aggregates ``others``."""
    g = with_limbs(df, measures).groupBy(*keys).agg(*limb_sums(measures), *others)
    held = {*(f"_{m}_beyond" for m in measures), *(_limb(m, k) for m in measures for k in range(2))}
    return g.select(*keys, *limb_totals(measures), *[c for c in g.columns if c not in held and c not in set(keys)])


def fiscal_year(d) -> Column:
    """Fiscal year starting in July: calendar year if month >= 7 else year - 1."""
    d = col(d)
    return (F.year(d) - F.when(F.month(d) >= 7, F.lit(0)).otherwise(F.lit(1))).cast("int")


def quarter_start(d) -> Column:
    """First day of the calendar quarter (as a date)."""
    return F.trunc(col(d), "quarter")


def month_id_to_date(c) -> Column:
    """'yyyyMM' text -> first day of that month."""
    return F.to_date(F.concat(col(c).cast("string"), F.lit("01")), "yyyyMMdd")


def all_not_null(cols: Iterable) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & col(c).isNotNull()
    return cond


def any_null(cols: Iterable) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | col(c).isNull()
    return cond


def count_true(conds: Iterable[Column]) -> Column:
    total = F.lit(0)
    for c in conds:
        total = total + F.when(c, F.lit(1)).otherwise(F.lit(0))
    return total
