"""The registered queries, each with an independent SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.session import prepare

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places and give timestamps as UTC wall-clock values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(plan(prepare(spark), sf_dir))

        PLANS[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return plan

    return add
