"""Column functions: bucketing, quality scores, cleaning, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that the value is below; NULL falls to `otherwise`."""
    out = None
    for bound, label in bounds:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(otherwise)


def quality_score(checks: Sequence[Column]) -> Column:
    """Mean of validity flags; NULL counts as false."""
    flags = [F.when(c, 1.0).otherwise(0.0) for c in checks]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return total / len(flags)


def parse_date(text: Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd")) -> Column:
    """The first format that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def clean_text(value: Column, allowed: Sequence[str] | None = None, unknown: str = "UNKNOWN") -> Column:
    """Trimmed upper case; blank, NULL or outside `allowed` gives `unknown`."""
    v = F.upper(F.trim(value))
    ok = v.isNotNull() & (v != "")
    return F.when(ok & v.isin(list(allowed)) if allowed else ok, v).otherwise(unknown)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def int_or_default(value: Column, low: int, high: int, default: int) -> Column:
    """The value as int if it is one within low and high, else the default."""
    v = value.try_cast("int")
    return F.when(v.between(low, high), v).otherwise(default)


def digits(value: Column) -> Column:
    """The digits of a text as int; none gives NULL."""
    return F.regexp_replace(value, "[^0-9]", "").try_cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where a norm is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, e: s + e.cast("double") * e.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(x) * norm(y)), zero)


def chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Overlapping chunks of `size` characters; an empty text has none."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step)))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))
