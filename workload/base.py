"""Query registry and the helpers queries and SQL twins share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from creditloom.session import pin_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` names the stand-in tables its SQL twin reads."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_settings(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = with_tables(sql, ctes)
        return fn

    return register


def with_tables(sql: str, ctes: Sequence[str]) -> str:
    """Put the SQL of the named stand-ins (and of those they need) in front of a statement."""
    from workload.standins import NEEDS, TABLE_SQL

    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        add(name)
    if not ordered:
        return sql.strip()
    body = ",\n".join(f"{n} AS ({TABLE_SQL[n].strip()})" for n in ordered)
    text = sql.strip()
    if text[:4].upper() == "WITH" and text[4:5].isspace():
        return f"WITH {body},\n{text[5:]}"
    return f"WITH {body}\n{text}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores before work that is heavy per row; always a shuffle, whatever the size."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
