"""JDBC reads whose tasks have about as many rows each, however the values of the partition column lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .readers import jdbc_options

BUCKETS, MOST_ROUNDS = 512, 8


def _ask(spark: SparkSession, options: dict[str, str], sql: str) -> list:
    """The few rows of a query that the database aggregates."""
    return spark.read.format("jdbc").options(**{**options, "dbtable": f"({sql}) q"}).load().collect()


def quantile_cuts(spark: SparkSession, options: dict[str, str], table: str, column: str, num: int, where: str | None = None) -> tuple[list[float], int, int]:
    """(cuts, rows, nulls): the values that part a numeric column into `num` ranges of about as many rows.

    `table`, `column` and `where` are as the database writes them, in quotes where it needs them.

    The database counts by buckets of equal width; buckets that hold more than a quarter of a range are counted again by narrower ones,
    so that a far outlier or a crowd of near values costs a round or two more. At most 4 * num buckets are counted again a round, so what
    reaches the driver does not grow with the table. A value that more rows share than a range should hold stays whole.
    """
    only = f" WHERE {where}" if where else ""
    low, high, rows, there = _ask(spark, options, f"SELECT MIN({column}) AS a, MAX({column}) AS b, COUNT(*) AS n, COUNT({column}) AS k FROM {table}{only}")[0]
    if not there or num < 2:
        return [], rows, rows - there
    counts: list[tuple[float, float, int]] = []  # from, width, rows
    rounds, asked = 0, [(float(low), float(high))]
    share = there / num
    while asked:
        rounds, again = rounds + 1, []
        for a, b in asked:
            width = (b - a) / BUCKETS
            if width <= 0 or a + width == a:
                counts.append((a, 0.0, int(_ask(spark, options, f"SELECT COUNT(*) AS n FROM {table} WHERE {column} >= {a!r} AND {column} <= {b!r}" + (f" AND ({where})" if where else ""))[0][0])))
                continue
            last = b == float(high)
            inside = f"{column} >= {a!r} AND {column} {'<=' if last else '<'} {b!r}" + (f" AND ({where})" if where else "")
            got = _ask(spark, options, f"SELECT bucket, COUNT(*) AS n FROM (SELECT FLOOR((CAST({column} AS DOUBLE) - ({a!r})) / {width!r}) AS bucket FROM {table} WHERE {inside}) x GROUP BY bucket")
            for bucket, n in got:
                k = min(int(bucket), BUCKETS - 1)
                if n > share / 4 and rounds < MOST_ROUNDS:
                    again.append((a + k * width, b if k == BUCKETS - 1 else a + (k + 1) * width))
                else:
                    counts.append((a + k * width, width, int(n)))
        asked = again
    counts.sort()
    cuts, held, done = [], 0, 0
    for start, _, n in counts:
        share = (there - done) / (num - len(cuts))  # of what is left
        if held and held + n / 2 >= share and len(cuts) < num - 1:  # the cut nearer to a full share
            cuts.append(start)
            held, done = 0, done + held
        held += n
    return cuts, rows, rows - there


def predicates(column: str, cuts: Sequence[float], nulls: bool) -> list[str]:
    """A condition a range; every row, NULL included, meets exactly one."""
    cuts = [repr(int(c)) if float(c).is_integer() else repr(float(c)) for c in sorted(set(cuts))]
    if not cuts:
        return ["1 = 1"]
    out = [f"{column} < {cuts[0]}", *[f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])], f"{column} >= {cuts[-1]}"]
    return out + [f"{column} IS NULL"] * nulls


def read_even(spark: SparkSession, kind: str, host: str, port: int, database: str, table: str, column: str, num: int, where: str | None = None, fetch_size: int = 10_000, **login) -> DataFrame:
    """A table of a database read in `num` ranges of a numeric column with about as many rows each, rows without a value in one of their own.

    Filters and columns of later steps reach the database beside the ranges. Cuts are taken when the frame is made; rows that come later
    are read all the same, since the outer ranges are open.
    """
    options = jdbc_options(kind, host, port, database, table=table, fetch_size=fetch_size, **login)
    cuts, _, nulls = quantile_cuts(spark, options, table, column, num, where)
    source = f"(SELECT * FROM {table} WHERE {where}) q" if where else table
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], source, predicates=predicates(column, cuts, nulls > 0), properties=rest)
