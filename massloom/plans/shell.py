"""The interactive commands: select, explain and export over registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from massloom.session import table
from massloom.sources.writers import write_table


class Shell:
    def __init__(self, spark: SparkSession, sf_dir: str, tables: list[str]):
        self.spark = spark
        for name in tables:
            table(spark, sf_dir, name).createOrReplaceTempView(name)

    def select(self, sql: str) -> DataFrame:
        return self.spark.sql(sql if sql.lstrip().lower().startswith(("select", "with")) else f"SELECT {sql}")

    def explain(self, sql: str) -> str:
        return "\n".join(r[0] for r in self.spark.sql(f"EXPLAIN FORMATTED {sql}").collect())

    def export(self, sql: str, path: str) -> None:
        write_table(self.select(sql), path)
