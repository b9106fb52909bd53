"""How registered queries shape their results, and pieces of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources.adapter import AS_OF, derived, traces, with_derived, with_traces

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, arrays of strings joined, times and dates as text, counts as long."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)  # a little up, so that exact halves round alike everywhere
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries of one area with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def on_traces(self, name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        """A query over the canonical traces; its SQL reads them as ``tr``."""
        self.queries[name] = lambda spark, sf_dir: tidy(build(traces(spark, sf_dir)))
        if sql:
            self.sql[name] = with_traces(sql)

    def on_derived(self, name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        """A query over a telemetry table; its SQL reads it by its name."""
        self.queries[name] = lambda spark, sf_dir: tidy(build(derived(spark, sf_dir, source)))
        if sql:
            self.sql[name] = with_derived(sql, source)

    def on_several(self, name: str, sources: tuple[str, ...], build: Callable[..., DataFrame], sql: str | None = None) -> None:
        """A query over several derived tables; its SQL reads them by their names, and traces as ``tr``."""
        self.queries[name] = lambda spark, sf_dir: tidy(build(*[traces(spark, sf_dir) if s == "tr" else derived(spark, sf_dir, s) for s in sources]))
        if sql:
            self.sql[name] = with_derived(with_traces(sql) if "tr" in sources else sql, *[s for s in sources if s != "tr"])

    def on_table(self, name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: tidy(build(table(spark, sf_dir, source)))
        if sql:
            self.sql[name] = sql


def r(expression: str) -> str:
    """A double of the SQL as ``tidy`` shows it."""
    return f"round(cast({expression} as double) + 1e-9, 6) + 0.0"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def second(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def last(days: int, ts: str = "ts") -> str:
    return f"{ts} >= timestamp '{AS_OF}' - interval {days} day and {ts} <= timestamp '{AS_OF}'"


def newest5(order: str = "ts", what: str = "trace_id") -> str:
    return f"array_to_string(list_slice(list({what} order by {order} desc, {what} desc), 1, 5), ',')"
