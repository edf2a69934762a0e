"""Driver tables in the roles the operators name, and the catalogue's registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.session import table


def registrar(catalog: dict) -> Callable:
    """A decorator that registers a query under its function's name, with its oracle."""

    def query(sql: str | None = None) -> Callable:
        def add(function: Callable) -> Callable:
            catalog[function.__name__] = (function, sql)
            return function

        return add

    return query


def micros(name: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value and t in seconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (micros("ts") / 1e6).alias("t"))


def days(name: str) -> Column:
    return (micros(name) / 86_400_000_000).alias("day")


EVENTS_SQL = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"
