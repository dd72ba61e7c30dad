"""Registered queries: a Spark callable plus, where SQL can say the same, the reference SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.adapter import ledger_sql, star_ledger

AS_OF = dt.date(2001, 6, 15)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ledger(self) -> DataFrame:
        return star_ledger(self.spark, self.dir)


def presentable(df: DataFrame) -> DataFrame:
    """Stable result types: decimals as double, dates and timestamps as text, every integer as long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may use a `ledger` relation, which is prepended when it is mentioned."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: presentable(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_ledger(sql)
        return fn

    return wrap


def with_ledger(sql: str) -> str:
    sql = sql.strip().rstrip(";")
    if "ledger" not in sql:
        return sql
    recursive = "recursive " if sql.lower().startswith("with recursive ") else ""
    head = f"with {recursive}ledger as ({ledger_sql()})"
    return f"{head}, {sql[4:].lstrip().removeprefix(recursive)}" if sql[:4].lower() == "with" else f"{head}\n{sql}"


def rr(num: str, den: str, scale: int = 1) -> str:
    """SQL text of an exact half-even integer rounding of num*scale/den."""
    a, d = f"(abs({num})*{scale})::hugeint", f"({den})::hugeint"
    return (
        f"((case when ({num}) < 0 then -1 else 1 end) * (({a}) // ({d}) + case when 2*(({a}) % ({d})) > ({d})"
        f" or (2*(({a}) % ({d})) = ({d}) and (({a}) // ({d})) % 2 = 1) then 1 else 0 end))::bigint"
    )


def pct(num: str, den: str, digits: int = 0) -> str:
    return f"(coalesce({rr(num, den, 100 * 10**digits)}, 0) / {10**digits}.0)::double"


def usd(c: str) -> str:
    """SQL text of whole dollars with thousands separators."""
    return f"('$' || format('{{:,}}', {rr(f'abs({c})', '100')}))"


def usd_plain(c: str) -> str:
    return f"('$' || {rr(f'abs({c})', '100')})"


def title(c: str) -> str:
    """SQL text of capitalising every letter run."""
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'),"
        " lambda w: upper(w[1:1]) || w[2:]), '')"
    )


SPEND = "transaction_type = 'expense' and cents < 0"
LIVE = f"{SPEND} and exclusion_reason is null"
