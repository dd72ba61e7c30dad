"""Small building blocks for Column expressions shared by all operators.

Money is DECIMAL(18,2) at the edges and an exact integer number of cents inside an operator, so sums, averages and
ratios are exact and do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: Column | str = "amount") -> Column:
    return (col(c) * 100).cast("long")


def money(c: Column | str) -> Column:
    """Cents (long) back to DECIMAL(18,2)."""
    return (col(c) / F.lit(100)).cast(MONEY)


def idiv(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def round_ratio(num: Column | str, den: Column | str, scale: int = 1) -> Column:
    """round(num * scale / den) to a whole number, ties to even, in exact integer arithmetic; NULL when den is 0."""
    num, den = col(num).cast("long"), F.nullif(col(den).cast("long"), F.lit(0).cast("long"))
    top = F.abs(num) * F.lit(scale).cast("long")
    q, r = idiv(top, den), top % den
    up = (r * 2 > den) | ((r * 2 == den) & (q % 2 == 1))
    sign = F.when(num < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return sign * (q + up.cast("long"))


def percent(num: Column | str, den: Column | str, digits: int = 0) -> Column:
    """100 * num / den rounded to `digits` decimals (0 when the base is 0), as double."""
    scaled = round_ratio(num, den, 100 * 10**digits)
    return F.coalesce(scaled, F.lit(0).cast("long")) / F.lit(10**digits)


def dollars(c: Column | str) -> Column:
    """Cents to whole-dollar text with thousands separators, sign dropped: $1,235."""
    return F.concat(F.lit("$"), F.format_number(round_ratio(F.abs(col(c)), F.lit(100)), 0))


def dollars_plain(c: Column | str) -> Column:
    """Cents to whole-dollar text without separators: $1235."""
    return F.concat(F.lit("$"), round_ratio(F.abs(col(c)), F.lit(100)).cast("string"))


def sample_stddev(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from exact mergeable moments (count, sum, sum of squares as DECIMAL(38,0))."""
    big = "decimal(38,0)"
    spread = n.cast(big) * squares.cast(big) - total.cast(big) * total.cast(big)
    pairs = (n * (n - 1)).cast("double")
    return F.when(n > 1, F.sqrt(spread.cast("double") / pairs))


def squares(c: Column | str) -> Column:
    """Sum of squares of an integer column, wide enough for any ledger."""
    c = col(c).cast("decimal(18,0)")
    return F.sum((c * c).cast("decimal(38,0)"))


def any_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def contains_any(text: Column | str, words: Iterable[str]) -> Column:
    """One regex alternation instead of a chain of contains()."""
    return col(text).rlike("|".join(re.escape(w) for w in words))


def first_match(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """Ordered rule table to a single CASE: the first true condition wins."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def lookup(c: Column | str, table: dict[str, str]) -> Column:
    """Constant dictionary lookup; NULL when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))


def month_key(d: Column | str = "transaction_date") -> Column:
    return F.date_format(col(d), "yyyy-MM")


def month_index(ym: Column | str) -> Column:
    """year*12 + month-1, so calendar-consecutive months differ by one."""
    ym = col(ym)
    return F.substring(ym, 1, 4).cast("int") * 12 + F.substring(ym, 6, 2).cast("int") - 1


def month_from_index(idx: Column) -> Column:
    year = idiv(idx.cast("long"), F.lit(12).cast("long")).cast("string")
    return F.concat(year, F.lit("-"), F.lpad((idx % 12 + 1).cast("string"), 2, "0"))


def month_long(ym: Column | str) -> Column:
    return F.date_format(F.to_date(F.concat(col(ym), F.lit("-01"))), "MMMM yyyy")


def month_short(ym: Column | str) -> Column:
    return F.date_format(F.to_date(F.concat(col(ym), F.lit("-01"))), "MMM yy")


def title_case(c: Column | str) -> Column:
    """Capitalise every run of letters (also after punctuation), lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def squash(c: Column | str) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def tokens(c: Column | str) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group. row_number() <= n lets Spark cut each partition to n rows before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def floor_div(a: Column, b: Column) -> Column:
    """Integer division rounding towards minus infinity (b > 0)."""
    return idiv(a - F.pmod(a, b), b)


def round_ratio_up(num: Column | str, den: Column | str, scale: int = 1) -> Column:
    """round(num * scale / den) with halves going up (the web client's rounding)."""
    num, den = col(num).cast("long"), F.nullif(col(den).cast("long"), F.lit(0).cast("long"))
    return floor_div(num * (2 * scale) + den, den * 2)


def distinct_texts(rows: DataFrame, c: str, name: str = "description") -> DataFrame:
    """Distinct values of a text column, spread over all tasks.

    The values are few bytes but expensive to work on; an explicit partition count keeps adaptive execution from
    coalescing them into one task. (Spark leaves out a repartition by the values themselves: `distinct` already put them so.)
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(F.col(c).alias(name)).distinct().repartition(n, F.xxhash64(name))


def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a one-row generator.

    Filters on them are not pushed below the generator, so an expensive parse is evaluated once per row instead of once
    per reference in every pushed-down predicate.
    """
    item = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.explode_outer(F.array(item)).alias("_staged")).select("*", "_staged.*").drop("_staged")
