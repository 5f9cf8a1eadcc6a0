"""Column expressions used by all operators. Everything stays in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """False for NULL, NaN and both infinities (NaN sorts above infinity)."""
    return F.coalesce(F.abs(col(c).cast("double")) < F.lit(INF), F.lit(False))


def finite_or(c: str | Column, default: float | None) -> Column:
    """The value as DOUBLE, or ``default`` where it is not finite."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < F.lit(INF), x).otherwise(F.lit(default).cast("double"))


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def unit_clip(c: str | Column) -> Column:
    """Missing values become 0, then the value is held within [0, 1]."""
    return clip(finite_or(c, 0.0), 0.0, 1.0)


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b, or 0 where the divisor is within 1e-12 of zero."""
    return F.when(F.abs(col(b)) <= 1e-12, F.lit(0.0)).otherwise(col(a) / col(b))


def level(c: str | Column, levels: Sequence[tuple[str, float]], base: str) -> Column:
    """Name of the highest level whose lower bound the value reaches."""
    x = col(c)
    out: Column | None = None
    for name, bound in reversed(levels):
        cond = x >= F.lit(float(bound))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(base))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Correlation as an aggregate; NULL when either side is flat."""
    spread = F.stddev_pop(col(x)) * F.stddev_pop(col(y))
    n = F.count(F.lit(1)).cast("double")
    return F.when(spread * n * n > 1e-12, F.covar_pop(col(x), col(y)) / spread)


def label_map(c: str | Column, mapping: dict[str, object], default: object) -> Column:
    """Value looked up by label in a fixed dictionary."""
    out: Column | None = None
    for key, value in mapping.items():
        cond = col(c) == F.lit(key)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def contains_any(c: str | Column, tokens: Iterable[str]) -> Column:
    """True when the text contains at least one token."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(col(c), F.lit(t))
    return out


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Left-to-right sum across columns, non-finite entries counted as 0."""
    out = F.lit(0.0)
    for c in cols:
        out = out + finite_or(c, 0.0)
    return out


def row_std(cols: Sequence[str | Column]) -> Column:
    """Population standard deviation across columns, from their pairwise differences."""
    xs = [col(c) for c in cols]
    total = F.lit(0.0)
    for i, a in enumerate(xs):
        for b in xs[i + 1:]:
            total = total + (a - b) * (a - b)
    return F.sqrt(total) / float(len(xs))


def fmt(template: str, *cols: str | Column) -> Column:
    """printf-style text; see ``fixed`` for numbers."""
    return F.format_string(template, *[col(c) for c in cols])


def fixed(c: str | Column, decimals: int) -> Column:
    """Number as text with a fixed count of decimals; halves round up.

    The small addend keeps values that are halves but for rounding noise on the same side.
    """
    unit = float(10 ** decimals)
    return F.format_string(f"%.{decimals}f", F.floor(col(c).cast("double") * unit + 0.500000001) / unit)


def normalized(weights: dict[str, float]) -> dict[str, float]:
    """Weights scaled to sum to one; negative or all-zero weights are errors."""
    if any(w < 0 for w in weights.values()):
        raise ValueError(f"negative weight in {weights}")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights sum to zero")
    return {k: w / total for k, w in weights.items()}


def hash_rank(keys: Sequence[str | Column], seed: int) -> Column:
    """Reproducible pseudo-random text per row: same keys and seed, same text."""
    parts = [col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
