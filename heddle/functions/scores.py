"""Scores and labels of the workload's silver and gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def additive_score(checks: Sequence[Column], each: float = 0.2) -> Column:
    """So much for each check that is true; NULL counts as false."""
    return reduce(lambda a, b: a + b, [F.when(c, each).otherwise(0.0) for c in checks])


def risk_weighted(risk: Column) -> Column:
    """(1 - risk / 100) * 0.7 + 0.3."""
    return (1 - risk / 100) * 0.7 + 0.3


def points(rules: Sequence[tuple[Column, float]]) -> Column:
    """Sum of the points of the rules that hold: a maintenance score from aggregates, for one."""
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in rules])


def label(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for c, name in reversed(rules):
        out = F.when(c, name).otherwise(out)
    return out


def weighted_level(value: Column, weights: dict[str, float]) -> Column:
    """A level's weight, 0 where it has none: for an average of levels."""
    return F.coalesce(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])[value], F.lit(0.0))


def utilisation(events: Column, machines: Column, days: int = 30) -> Column:
    """Events as a percentage of the hours of all machines over so many days."""
    return F.try_divide(events * 100.0, machines * days * 24)


def season(day: Column) -> Column:
    """Winter from December, and so on by quarters."""
    m = F.month(day)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise("Fall")


def weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def share_of(text: Column) -> Column:
    """'8/10' as 0.8; other texts as numbers; NULL where neither."""
    parts = F.split(text, "/")
    return F.coalesce(F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")), text.try_cast("double"))


def money(text: Column) -> Column:
    """A number out of a text with currency signs and thousands separators."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def grade(text: Column) -> Column:
    """A to F out of a grade's first letter, else of a mark by 90, 80, 70, 60; NULL stays."""
    mark, letter = text.try_cast("double"), F.upper(F.substring(F.trim(text), 1, 1))
    by_mark = F.when(mark >= 90, "A").when(mark >= 80, "B").when(mark >= 70, "C").when(mark >= 60, "D").otherwise("F")
    return F.when(mark.isNotNull(), by_mark).when(letter.isin("A", "B", "C", "D", "F"), letter)


def classify(text: Column, kinds: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first kind whose word the text holds, without case."""
    return label([(F.contains(F.lower(F.trim(text)), F.lit(w.lower())), name) for w, name in kinds], otherwise)


def binary_units(x: Column) -> Column:
    """A double in units of 2**-59, a whole number for 0 and sizes from 2**-7 to 16: sums of these are those of the doubles themselves, exact in any order."""
    return (x * F.lit(2.0**59)).cast("bigint").cast("decimal(19,0)")


def mean_of_decimals(x: Column) -> Column:
    """The mean, to 18 digits, of what the doubles of a group stand for, to ten digits each; the same in any order of rows."""
    return F.sum(x.cast("decimal(20,10)")) / F.count(x)
